"""Quality rules: a threshold table compiled into one projection.

Every rule is a row ``(ratio, lowest, highest)`` of :data:`THRESHOLDS`; the
table is compiled into one struct expression of built-in functions (no user
functions, no shuffle). A document passes if every ratio lies in its range.

Defined results: a null text counts as empty; a text without words has ratios
null and fails; repeated rows are judged alike and all stay; columns of the
input are carried through untouched, except one named like the output column,
which is replaced. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickvault.llm.common import let, table, words

#: Stop words of the four languages of the corpus (ASCII, so that case folding is plain).
STOP_WORDS = {
    "en": "the of and to in is that for it with as was on by be this are or an at from",
    "fr": "de la le et les des un une que qui dans par pour sur est du en au avec",
    "de": "der die und das den von zu mit sich des auf ist im dem nicht ein eine als",
    "es": "de la que el en y los se del las un por con una su para al lo",
}

#: (ratio, lowest, highest); None leaves a side open.
THRESHOLDS = [
    ("mean_word_chars", 3.0, 10.0),
    ("symbols_per_word", None, 0.1),
    ("stop_word_share", 0.03, None),
    ("dup_line_share", None, 0.4),
]

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _stop_words() -> list[str]:
    return sorted({w for v in STOP_WORDS.values() for w in v.split()})


def _covered(starts: Column) -> Column:
    # words covered by windows of three at the given ascending starts
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, p: F.struct(
        (a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n"), (p + 3).alias("end")
    )
    return F.aggregate(starts, zero, step)["n"]


def _repeat_words(w: Column) -> Column:
    """Words lying in a 3-word window that occurs at least twice.

    Windows are compared by a 64-bit hash. Texts without an equal pair end at
    a set-size test; a few repeated windows are looked up by value, many by one
    sort of (hash, position), so the cost stays n log n for any text.
    """
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    twin = lambda s, x, j: F.coalesce(F.get(s, j + 1) == x, F.lit(False))

    def repeated(h: Column) -> Column:
        return F.array_distinct(let(F.sort_array(h), lambda s: F.filter(s, lambda x, j: twin(s, x, j))))

    def looked_up(h: Column, d: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), n - 3), lambda i: F.array_contains(d, F.get(h, i)))

    def by_sort(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        same = lambda s, x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])
        marked = lambda s: F.filter(s, lambda x, j: F.coalesce(same(s, x, j), F.lit(False)))
        return F.array_sort(F.transform(let(pairs, marked), lambda x: x["p"]))

    def count(h: Column) -> Column:
        starts = lambda d: F.when(F.size(d) <= 32, looked_up(h, d)).otherwise(by_sort(h))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            _covered(let(repeated(h), starts))
        )

    return F.when(n < 4, F.lit(0)).otherwise(let(hashes, count))


def _dup_lines(t: Column) -> Column:
    # (lines with a word, of these the ones equal to an earlier line)
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        lines,
        lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")),
    )


def measure(text: Column) -> Column:
    """Struct of counts of one text; ``get`` and lambdas only, one evaluation."""
    stops = _stop_words()

    def counts(t: Column, w: Column, ln: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            ln["dup"].cast("long").alias("n_dup_lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(stops))).cast("long").alias("n_stop_words"),
            ln["n"].cast("long").alias("n_lines"),
        )

    return let(
        F.coalesce(text, F.lit("")),
        lambda t: let(words(t), lambda w: let(_dup_lines(t), lambda ln: counts(t, w, ln))),
    )


def _ratios(m: Column) -> dict[str, Column]:
    return {
        "mean_word_chars": F.try_divide(m["word_chars"].cast("double"), m["n_words"].cast("double")),
        "symbols_per_word": F.try_divide(m["n_symbols"].cast("double"), m["n_words"].cast("double")),
        "stop_word_share": F.try_divide(m["n_stop_words"].cast("double"), m["n_words"].cast("double")),
        "dup_line_share": F.try_divide(m["n_dup_lines"].cast("double"), m["n_lines"].cast("double")),
    }


def _passes(value: Column, low: float | None, high: float | None) -> Column:
    ok = F.lit(True)
    if low is not None:
        ok = ok & (value >= F.lit(low))
    if high is not None:
        ok = ok & (value <= F.lit(high))
    return F.coalesce(ok, F.lit(False))


def compile_rules(
    text: Column,
    thresholds=THRESHOLDS,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
) -> Column:
    """The rule table as one struct column: counts, ratios, ``base_failed``,
    ``failed`` (names of broken rules) and ``kept``."""

    def judged(m: Column) -> Column:
        ratios = _ratios(m)
        base = (m["n_words"] < min_words) | (F.lit(100) * m["n_repeat_words"] > F.lit(max_repeat_percent) * m["n_words"])
        rules = [(name, _passes(ratios[name], low, high)) for name, low, high in thresholds]
        verdict = F.lit(True)
        for _, ok in rules:
            verdict = verdict & ok
        failed = F.filter(
            F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules] or [F.lit(None).cast("string")]),
            lambda x: x.isNotNull(),
        )
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines"]
        return F.struct(
            *[m[n].alias(n) for n in names],
            *[v.alias(k) for k, v in ratios.items()],
            base.alias("base_failed"),
            failed.alias("failed"),
            (~base & verdict).alias("kept"),
        )

    return let(measure(text), judged)


def quality_rules(docs: DataFrame, text_col: str = "text", out: str = "quality", **rules) -> DataFrame:
    """``docs`` with the struct column ``out`` (see :func:`compile_rules`)."""
    return docs.withColumn(out, compile_rules(docs[text_col], **rules))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cols = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept n_stop_words".split()
    return judged.select("doc_id", *[f"quality.{c}" for c in cols])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that break a rule go."""
    return docs.filter(compile_rules(docs["text"])["kept"])


_SQL_LIST = ", ".join(f"'{w}'" for w in _stop_words())


def oracle(docs: str = "documents") -> str:
    """DuckDB statement for :func:`query` over the relation ``docs``."""
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {docs}
), s AS (
  SELECT rid, doc_id, t,
         list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d
), g AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM s)
), r AS (
  SELECT rid, count(DISTINCT p) AS n
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1)
  GROUP BY rid
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: list_contains([{_SQL_LIST}], lower(x))))::BIGINT AS n_stop_words
  FROM s LEFT JOIN r USING (rid)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(NOT base_failed AND word_chars / n_words >= 3.0 AND word_chars / n_words <= 10.0
                AND n_symbols / n_words <= 0.1 AND n_stop_words / n_words >= 0.03
                AND n_dup_lines / n_lines <= 0.4, false) AS kept,
       n_stop_words
FROM b"""
