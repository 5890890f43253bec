"""Secret scans: fixed patterns plus a character Markov model, DataFrame only.

Base rules find assignments, access keys and long hex runs. The method adds
runs of key characters that look random: two character bigram models (random
strings, ordinary identifiers) are trained from samples the base rules label
in the corpus itself (values of base matches; long plain words outside them),
and a run is a secret if its log-likelihood ratio exceeds :data:`MIN_RATIO`. Of
a run that holds base spans, each part outside them, however short, is judged
in the same way.
Counting covers every document; the model is at most 66 x 66 numbers a class,
whatever the input size.

Defined results: a null or empty text has no spans; repeated rows are scanned
alike and all stay; an empty table trains uniform models; input columns named
like the output column are replaced by it. Offsets count code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickvault.llm.common import let, table

# Fixed patterns. A run shorter than its minimum can hold no longer run of the
# same class, so for access and hex the minimum stands in the pattern itself.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_ASSIGN_VALUE = 12

KINDS = ["assign", "access", "hex", "markov"]

#: Characters of a candidate run, and its least length.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
RUN = r"[A-Za-z0-9+/_-]{20,}"
#: Plain words of this form outside base matches are the identifier samples.
IDENTIFIER = r"[A-Za-z][A-Za-z0-9_-]{11,}"
MIN_RATIO = 10.0
SPAN = "struct<start:int,end:int,kind:int,value:string>"


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _span(start: Column, end: Column, kind: int, value: Column) -> Column:
    return F.struct(
        start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(kind).alias("kind"), value.alias("value")
    )


def _matches(t: Column, pattern: str, kind: int) -> Column:
    """Spans of all matches, leftmost first: the texts between matches and the
    matches themselves, laid end to end."""
    parts = F.filter(
        F.zip_with(
            F.split(t, pattern, -1),
            F.regexp_extract_all(t, F.lit(pattern), F.lit(0)),
            lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")),
        ),
        lambda x: x["m"].isNotNull(),
    )
    zero = F.struct(F.lit(0).alias("pos"), _none().alias("out"))

    def step(a, x):
        start = a["pos"] + x["gap"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("pos"), F.concat(a["out"], F.array(_span(start, end, kind, x["m"]))).alias("out"))

    return F.when(t.rlike(pattern), F.aggregate(parts, zero, step)["out"]).otherwise(_none())


def base_spans(t: Column) -> Column:
    """Spans of the base rules of one kind after the other."""
    value = lambda x: F.regexp_extract(x["value"], ASSIGN, 2)
    assign = F.filter(_matches(t, ASSIGN, 0), lambda x: F.length(value(x)) >= MIN_ASSIGN_VALUE)
    return F.concat(assign, _matches(t, ACCESS, 1), _matches(t, HEX, 2))


def _outside(spans: Column, base: Column) -> Column:
    return F.filter(
        spans, lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    )


def _rests(spans: Column, base: Column) -> Column:
    """What base spans leave of each span: the parts before, between and after them."""

    def part(run: Column, start: Column, end: Column) -> Column:
        value = F.substring(run["value"], start - run["start"] + 1, end - start)
        return F.when(start < end, F.array(_span(start, end, 3, value))).otherwise(_none())

    def cut(run: Column) -> Column:
        inside = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
        zero = F.struct(run["start"].alias("pos"), _none().alias("out"))

        def step(a, b):
            return F.struct(
                F.greatest(a["pos"], b["end"]).alias("pos"),
                F.concat(a["out"], part(run, a["pos"], b["start"])).alias("out"),
            )

        last = lambda a: F.concat(a["out"], part(run, a["pos"], run["end"]))
        return F.when(F.size(inside) > 0, F.aggregate(F.array_sort(inside), zero, step, last)).otherwise(F.array(run))

    return F.flatten(F.transform(spans, cut))


def _bigrams(value: Column) -> Column:
    return let(
        F.split(value, ""),
        lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.concat(a, b)),
    )


def bigram_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(random, bigram, n): bigrams of both kinds of labelled samples."""
    t = F.coalesce(texts[text_col], F.lit(""))

    def samples(base: Column) -> Column:
        secret = F.transform(
            base,
            lambda x: F.struct(
                F.lit(True).alias("random"),
                F.when(x["kind"] == 0, F.regexp_extract(x["value"], ASSIGN, 2)).otherwise(x["value"]).alias("value"),
            ),
        )
        plain = F.transform(
            _outside(_matches(t, IDENTIFIER, 3), base),
            lambda x: F.struct(F.lit(False).alias("random"), x["value"].alias("value")),
        )
        return F.concat(secret, plain)

    found = texts.select(F.explode(let(base_spans(t), samples)).alias("s"))
    pairs = found.select("s.random", F.explode(_bigrams(F.col("s.value"))).alias("bigram"))
    return pairs.groupBy("random", "bigram").agg(F.count("*").alias("n"))


def train(texts: DataFrame, text_col: str = "text") -> dict[str, float]:
    """Log-likelihood ratio (random over identifier) of each bigram, add-one
    smoothed over the alphabet. At most 2 x 66 x 66 rows reach the driver."""
    inside = F.col("bigram").rlike(r"^[A-Za-z0-9+/_-]{2}$")
    rows = bigram_counts(texts, text_col).filter(inside).collect()
    n = {(r["random"], r["bigram"]): r["n"] for r in rows}
    total: dict = {}
    for (kind, pair), k in n.items():
        total[kind, pair[0]] = total.get((kind, pair[0]), 0) + k

    def log_p(kind: bool, pair: str) -> float:
        return math.log((n.get((kind, pair), 0) + 1) / (total.get((kind, pair[0]), 0) + len(ALPHABET)))

    return {a + b: log_p(True, a + b) - log_p(False, a + b) for a in ALPHABET for b in ALPHABET}


def ratio(value: Column, model: dict[str, float]) -> Column:
    """Log-likelihood ratio of one run; the model is one array literal."""
    size = len(ALPHABET)
    flat = F.split(F.lit(",".join(repr(model[a + b]) for a in ALPHABET for b in ALPHABET)), ",").cast("array<double>")

    def total(codes: Column) -> Column:
        steps = F.zip_with(
            F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: F.get(flat, a * size + b)
        )
        return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)

    return let(_codes(value), total)


def _codes(value: Column) -> Column:
    # position of each character in ALPHABET, from its code
    at = {ord(c): i for i, c in enumerate(ALPHABET)}
    lookup = F.split(F.lit(",".join(str(at.get(i, 0)) for i in range(128))), ",").cast("array<int>")
    return F.transform(F.split(value, ""), lambda c: F.get(lookup, F.ascii(c)))


def find_secrets(text: Column, model: dict[str, float]) -> Column:
    """All spans of one text, by start, then kind; kinds index :data:`KINDS`."""

    def both(t: Column, base: Column) -> Column:
        runs = _rests(_matches(t, RUN, 3), base)
        return F.array_sort(F.concat(base, F.filter(runs, lambda x: ratio(x["value"], model) > MIN_RATIO)))

    return let(F.coalesce(text, F.lit("")), lambda t: let(base_spans(t), lambda b: both(t, b)))


def scan(docs: DataFrame, model: dict[str, float], text_col: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with the array column ``out`` of spans (start, end, kind, value)."""
    return docs.withColumn(out, find_secrets(docs[text_col], model))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every (possibly overlapping) span replaced by ``mark``."""

    def step(t: Column):
        def one(a, x):
            kept = F.substring(t, a["pos"] + 1, F.greatest(x["start"] - a["pos"], F.lit(0)))
            fresh = x["start"] >= a["pos"]
            return F.struct(
                F.greatest(a["pos"], x["end"]).alias("pos"),
                F.when(fresh, F.concat(a["out"], kept, F.lit(mark))).otherwise(a["out"]).alias("out"),
            )

        return one

    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    whole = lambda t, a: F.concat(a["out"], F.substring(t, a["pos"] + 1, F.length(t)))
    done = let(text, lambda t: let(F.aggregate(spans, zero, step(t)), lambda a: whole(t, a)))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def _joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string")),
        ),
        ",",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs["text"], train(docs))

    def digest(s: Column) -> Column:
        n = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long")
        return F.struct(
            n(0).alias("n_assign"),
            n(1).alias("n_access"),
            n(2).alias("n_hex"),
            F.sha2(_joined(F.filter(s, lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
            _joined(s).alias("spans"),
        )

    return docs.select("doc_id", let(found, digest).alias("d")).select("doc_id", "d.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets are replaced by a mark; all documents stay."""
    model = train(docs)
    clean = let(find_secrets(docs["text"], model), lambda s: redact(docs["text"], s))
    out = docs.withColumn("text", clean)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)
