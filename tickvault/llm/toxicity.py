"""Toxicity by multiple-instance learning.

A document is a bag of sentences; sentence probabilities (logistic, word
features) combine by noisy-or, so the model is trained from document labels
alone and then points at the sentences that make a document toxic.

Training reads at most :data:`MAX_TRAIN_DOCS` labelled documents (those with
the smallest hash of doc_id) whose crc32(doc_id as text) mod 5 is not 0, and
keeps at most :data:`MAX_FEATURES` words; both bounds are parameters. Scoring
covers every whole text.

A text is not toxic for its length: a sentence no likelier toxic than one
without feature words adds nothing to the score, and the others combine within
:data:`PASSAGE` consecutive sentences; the score is that of the worst such
passage. An offending sentence therefore gives 0.5 or more wherever it stands,
while faint evidence further apart never adds up.

Defined results: a null or empty text has no sentences and scores 0; repeated
rows score alike and all stay; without labels of both classes every document
scores near 0; input columns named like the output column are replaced.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickvault.llm.common import table

MAX_TRAIN_DOCS = 20_000
MAX_FEATURES = 1_000
MIN_DOCS = 5
FOLDS = 5
#: Consecutive sentences whose probabilities combine.
PASSAGE = 100

_SENTENCE = re.compile(r"[^.!?\n]*[^.!?\s][^.!?\n]*")
_WORD = re.compile(r"[^\W_]+")


@dataclass
class Model:
    bias: float = -9.0
    weights: dict[str, float] = field(default_factory=dict)

    def sentence(self, text: str) -> float:
        """Log-odds of one sentence."""
        held = self.weights.keys() & set(_WORD.findall(text.lower()))
        return self.bias + sum(self.weights[w] for w in sorted(held))


def held_out(doc_id: Column) -> Column:
    """The fold that labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_labels(labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """(doc_id, toxic) of the training sample, one row a document."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)


def _sentences(text: str | None) -> list[re.Match]:
    return list(_SENTENCE.finditer(text)) if text else []


def _terms(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: sorted(set(_WORD.findall(t.lower()))) if t else [])


def _select_words(sample: DataFrame, max_features: int) -> list[str]:
    """The words whose document frequencies differ most between the classes."""
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return []
    terms = sample.select("toxic", F.explode(F.pandas_udf(_terms, "array<string>")("text")).alias("word"))
    counts = terms.groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    share = F.col("n") / F.lit(float(n[0] + n[1]))
    spread = F.sqrt(share * (1 - share) * F.lit(1 / n[0] + 1 / n[1]))
    z = F.abs(F.col("t") / F.lit(float(n[1])) - (F.col("n") - F.col("t")) / F.lit(float(n[0]))) / F.greatest(spread, F.lit(1e-9))
    best = counts.filter(F.col("n") >= MIN_DOCS).orderBy(z.desc(), "word").limit(max_features)
    return [r["word"] for r in best.select("word").collect()]


def _bags(sample: DataFrame, words: list[str]) -> pd.DataFrame:
    """Per document: label, number of sentences without a feature word, and the
    feature ids of the others (-1 ends a sentence)."""
    index = {w: i for i, w in enumerate(words)}

    def bags(texts: pd.Series) -> pd.DataFrame:
        plain, ids = [], []
        for t in texts:
            n, flat = 0, []
            for m in _sentences(t):
                held = index.keys() & set(_WORD.findall(m[0].lower()))
                if held:
                    flat += sorted(index[w] for w in held)
                    flat.append(-1)
                else:
                    n += 1
            plain.append(n)
            ids.append(flat)
        return pd.DataFrame({"plain": plain, "ids": ids})

    udf = F.pandas_udf(bags, "plain int, ids array<int>")
    rows = sample.select("doc_id", "toxic", udf("text").alias("b")).select("doc_id", "toxic", "b.*")
    return rows.toPandas().sort_values("doc_id")


def fit(toxic: np.ndarray, plain: np.ndarray, ids: list, n_words: int, rounds: int = 600) -> tuple[float, np.ndarray]:
    """Noisy-or likelihood by full-batch Adam; deterministic."""
    flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in ids] or [np.zeros(0, np.int64)])
    doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    sent = np.cumsum(np.concatenate([[0], (flat[:-1] == -1).astype(int)])) if len(flat) else np.zeros(0, int)
    n_sent = int(sent[-1]) + 1 if len(flat) else 0
    owner = doc[flat == -1]
    keep = flat >= 0
    word, at = flat[keep], sent[keep]
    theta = np.zeros(n_words + 1)
    theta[-1] = -4.0
    m = v = np.zeros_like(theta)
    for k in range(1, rounds + 1):
        z = theta[-1] + np.bincount(at, theta[word], n_sent)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + math.exp(-theta[-1]))
        none = np.bincount(owner, np.logaddexp(0, z), len(toxic)) + plain * math.log1p(math.exp(theta[-1]))
        q = np.exp(-none)  # probability that no sentence is toxic
        pull = np.where(toxic == 1, -q / np.maximum(1 - q, 1e-9), 1.0)
        g = pull[owner] * p
        grad = np.append(np.bincount(word, g[at], n_words), g.sum() + (pull * plain).sum() * p0) / len(toxic)
        grad[:-1] += 3e-5 * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return float(theta[-1]), theta[:-1]


def train(
    docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, max_features: int = MAX_FEATURES
) -> Model:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    # at most max_docs narrow rows: the bound of the broadcast
    chosen = F.broadcast(training_labels(labels.select("doc_id", "toxic"), max_docs))
    sample = docs.select("doc_id", "text").join(chosen, "doc_id")
    words = _select_words(sample, max_features)
    if not words:
        return Model()
    bags = _bags(sample, words)
    bias, w = fit(bags["toxic"].to_numpy(), bags["plain"].to_numpy(float), list(bags["ids"]), len(words))
    return Model(bias, {x: float(k) for x, k in zip(words, w, strict=True) if abs(k) > 0.02})


def _worst(doubts: list[tuple[int, float]]) -> float:
    """The largest sum over :data:`PASSAGE` consecutive sentences; ``doubts``
    are (sentence number, -log of the probability that it is clean)."""
    worst = total = 0.0
    first = 0
    for k, doubt in doubts:
        while doubts[first][0] <= k - PASSAGE:
            total -= doubts[first][1]
            first += 1
        total = max(total, 0.0) + doubt
        worst = max(worst, total)
    return worst


def score_udf(model: Model):
    """Pandas UDF text -> (score, sentences: offending (start, end, probability))."""

    def score(texts: pd.Series) -> pd.DataFrame:
        scores, found = [], []
        for t in texts:
            doubts, bad = [], []
            for k, m in enumerate(_sentences(t)):
                z = model.sentence(m[0])
                if z > model.bias:
                    doubts.append((k, z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))))
                if z >= 0:
                    bad.append({"start": m.start(), "end": m.end(), "probability": 1 / (1 + math.exp(-z))})
            scores.append(-math.expm1(-_worst(doubts)))
            found.append(bad)
        return pd.DataFrame({"score": scores, "sentences": found})

    return F.pandas_udf(score, "score double, sentences array<struct<start:int,end:int,probability:double>>")


def detect(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with the struct column ``out``: score and offending sentences."""
    return docs.withColumn(out, score_udf(model)(docs[text_col]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = detect(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"),
        F.size("toxicity.sentences").cast("long").alias("n_offending"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: toxic documents go."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(score_udf(model)(docs["text"])["score"] < 0.5)
