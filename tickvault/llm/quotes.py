"""Chat formatting by quotation linking, DataFrame functions only.

A message's lines are parsed into quote levels (leading ``>`` marks). Quoted
passages and their lines are normalised, hashed, and joined to the first
message of the conversation that says the same in its own words; the message
whose level-one quotes match best is what it replies to. Output: the messages
without quotes, in reply order (by the thread's first turn, then turn), each
with its parent, thread root and depth.

Originals are reduced to one row per (conversation, hash) before the join, and
positions come from a range sort, so neither a conversation nor a sentence that
holds a third of all rows meets in one task.

Defined results: a null text is empty; a quote that no earlier message of the
conversation says is dropped from the text but links nothing; rows of the same
(conv_id, turn) are one message for linking and all stay; rows without conv_id
or turn link with nothing; an empty table gives no rows. Columns other than
conv_id, turn, role and text are left behind, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickvault.llm.common import let, table, written

MARKS = r"^((?:[ \t]{0,3}>)+)"
QUOTING = r"(?m)^[ \t]{0,3}>"
#: Lines that announce a quote ("... wrote:"), in the four languages of the corpus.
ANNOUNCES = r"^.{0,200}\b(?:wrote|schrieb|a écrit|escribió)\s?:\s*$"


def _norm(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def _lines(text: Column) -> Column:
    """Array of (level, content) of a text's lines."""

    def line(x: Column) -> Column:
        mark = F.regexp_extract(x, MARKS, 1)
        content = F.when(mark == "", x).otherwise(F.trim(F.substring(x, F.length(mark) + 1, F.length(x))))
        return F.struct(
            (F.length(mark) - F.length(F.replace(mark, F.lit(">"), F.lit("")))).alias("level"), content.alias("content")
        )

    return F.transform(F.split(text, "\n", -1), line)


def _passages(lines: Column) -> Column:
    """Runs of lines of one quote level: array of (level, text), level > 0."""
    none = F.array().cast("array<struct<level:int,text:string>>")
    zero = F.struct(F.lit(0).alias("level"), F.lit("").alias("text"), none.alias("out"))

    def closed(a: Column) -> Column:
        run = F.array(F.struct(a["level"].alias("level"), F.trim(a["text"]).alias("text")))
        return F.when(a["level"] > 0, F.concat(a["out"], run)).otherwise(a["out"])

    def step(a: Column, x: Column) -> Column:
        same = a["level"] == x["level"]
        said = _norm(x["content"])
        return F.struct(
            x["level"].alias("level"),
            F.when(same, F.concat_ws(" ", a["text"], said)).otherwise(said).alias("text"),
            F.when(same, a["out"]).otherwise(closed(a)).alias("out"),
        )

    return F.aggregate(lines, zero, step, closed)


def parse(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, clean, said, quoted): text without quotes; its own
    normalised units; quoted units as (level, text)."""
    text = F.coalesce(messages["text"], F.lit(""))

    def own(lines: Column) -> Column:
        return F.transform(
            F.filter(lines, lambda x: (x["level"] == 0) & ~x["content"].rlike(ANNOUNCES)), lambda x: x["content"]
        )

    def units(texts: Column) -> Column:
        each = F.transform(texts, _norm)
        return F.filter(
            F.array_distinct(F.concat(each, F.array(F.trim(F.regexp_replace(F.array_join(each, " "), r"\s+", " "))))),
            lambda x: x != "",
        )

    def quotes(lines: Column) -> Column:
        by_line = F.transform(
            F.filter(lines, lambda x: x["level"] > 0),
            lambda x: F.struct(x["level"].alias("level"), _norm(x["content"]).alias("text")),
        )
        return F.filter(F.array_distinct(F.concat(_passages(lines), by_line)), lambda x: x["text"] != "")

    def with_quotes(t: Column) -> Column:
        return let(
            _lines(t),
            lambda ls: F.struct(
                F.regexp_replace(F.array_join(own(ls), "\n"), r"^\n+|\n+$", "").alias("clean"),
                units(own(ls)).alias("said"),
                quotes(ls).alias("quoted"),
            ),
        )

    def plain(t: Column) -> Column:
        return F.struct(
            t.alias("clean"),
            units(F.split(t, "\n", -1)).alias("said"),
            F.array().cast("array<struct<level:int,text:string>>").alias("quoted"),
        )

    parsed = let(text, lambda t: F.when(t.rlike(QUOTING), with_quotes(t)).otherwise(plain(t)))
    return messages.select("conv_id", "turn", "role", parsed.alias("p")).select("conv_id", "turn", "role", "p.*")


def _hash(x: Column) -> Column:
    return F.sha2(x, 256)


def links(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, level, original, units): which earlier message the quotes
    of each level come from."""
    quoted = parsed.select("conv_id", "turn", F.explode("quoted").alias("q")).select(
        "conv_id", "turn", F.col("q.level").alias("level"), _hash(F.col("q.text")).alias("unit")
    )
    quoted = quoted.distinct()
    # one row per conversation and unit, of conversations that quote at all
    said = parsed.join(quoted.select("conv_id").distinct(), "conv_id", "left_semi")
    said = said.select("conv_id", "turn", F.explode("said").alias("u"))
    first = said.groupBy("conv_id", _hash(F.col("u")).alias("unit")).agg(F.min("turn").alias("original"))
    met = quoted.join(first, ["conv_id", "unit"]).filter("original < turn")
    return met.groupBy("conv_id", "turn", "level", "original").agg(F.count("*").alias("units"))


def parents(found: DataFrame) -> DataFrame:
    """(conv_id, turn, parent): best matched level-one original, the latest of equals."""
    best = F.max(F.struct("units", "original")).alias("b")
    return found.filter("level = 1").groupBy("conv_id", "turn").agg(best).select(
        "conv_id", "turn", F.col("b.original").alias("parent")
    )


def threads(spark: SparkSession, parent: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, root, depth) of replies, by pointer doubling."""
    now = written(
        spark, parent.select("conv_id", "turn", "parent", F.col("parent").alias("root"), F.lit(1).alias("depth")), "threads"
    )
    while True:
        up = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        moved = now.join(up, ["conv_id", "root"], "left")
        if moved.filter("above is not null").isEmpty():
            return now
        now = written(
            spark,
            moved.select(
                "conv_id",
                "turn",
                "parent",
                F.coalesce("above", "root").alias("root"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            ),
            "threads",
        )


def conversations(spark: SparkSession, messages: DataFrame) -> DataFrame:
    """(conv_id, position, turn, role, parent_turn, root_turn, depth, message)."""
    parsed = parse(messages)
    replies = threads(spark, parents(links(parsed)))
    rows = parsed.select("conv_id", "turn", "role", "clean").join(replies, ["conv_id", "turn"], "left")
    rows = rows.select(
        "conv_id",
        "turn",
        "role",
        F.col("parent").alias("parent_turn"),
        F.coalesce("root", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.col("clean").alias("message"),
    )
    keys = ["conv_id", "root_turn", "turn", "role", "message"]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # the high part of the id is the range, the low part the row in it
    at = F.monotonically_increasing_id()
    dealt = written(spark, dealt.withColumn("part", F.shiftright(at, 33)).withColumn("row", at.bitwiseAND((1 << 33) - 1)), "sorted")
    parts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = dealt.join(parts, "part").withColumn("at", F.col("before") + F.col("row"))
    first = placed.groupBy(F.col("conv_id").alias("c")).agg(F.min("at").alias("first"))
    return placed.join(first, placed["conv_id"].eqNullSafe(first["c"])).select(
        "conv_id",
        (F.col("at") - F.col("first")).alias("position"),
        "turn",
        "role",
        "parent_turn",
        "root_turn",
        "depth",
        "message",
    )


def quoting(messages: DataFrame) -> DataFrame:
    """Mail-style replies: every turn quotes its predecessor (level 1) and what
    that one quoted (level 2), then adds its own text."""

    def marked(c: str, mark: str) -> Column:
        return F.array_join(F.transform(F.split(F.col(c), "\n", -1), lambda x: F.concat(F.lit(mark), x)), "\n")

    text = F.coalesce(F.col("text"), F.lit(""))
    one = messages.groupBy("conv_id", "turn").agg(F.min(text).alias("t"))
    back = lambda k: one.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("t").alias(f"t{k}"))
    rows = messages.select("conv_id", "turn", "role", text.alias("text"))
    rows = rows.join(back(1), ["conv_id", "turn"], "left").join(back(2), ["conv_id", "turn"], "left")
    parts = F.concat_ws("\n", marked("t2", "> > "), marked("t1", "> "), F.col("text"))
    return rows.select("conv_id", "turn", "role", parts.alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's conversations, and (``form`` 'replies') mail-style replies
    derived from all of them, since the table's own turns seldom quote."""
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    plain = conversations(spark, messages).withColumn("form", F.lit("table"))
    return plain.unionByName(conversations(spark, quoting(messages)).withColumn("form", F.lit("replies")))


#: DuckDB statement for :func:`query`.
SQL = r"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
), one AS (
  SELECT conv_id, turn, min(text) AS t FROM base GROUP BY conv_id, turn
), messages AS (
  SELECT 'table' AS form, conv_id, turn, role, text FROM base
  UNION ALL
  SELECT 'replies', b.conv_id, b.turn, b.role, concat_ws(chr(10),
         array_to_string(list_transform(string_split(p2.t, chr(10)), lambda x: '> > ' || x), chr(10)),
         array_to_string(list_transform(string_split(p1.t, chr(10)), lambda x: '> ' || x), chr(10)), b.text)
  FROM base b
  LEFT JOIN one p1 ON p1.conv_id = b.conv_id AND p1.turn + 1 = b.turn
  LEFT JOIN one p2 ON p2.conv_id = b.conv_id AND p2.turn + 2 = b.turn
), m AS (
  SELECT row_number() OVER () AS mid, *, regexp_matches(text, '(^|\n)[ \t]{0,3}>') AS quoting FROM messages
), cut AS (
  SELECT mid, form, conv_id, turn, quoting, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS idx
  FROM m
), marked AS (
  SELECT *, CASE WHEN quoting THEN regexp_extract(line, '^((?:[ \t]{0,3}>)+)', 1) ELSE '' END AS mark FROM cut
), lines AS (
  SELECT mid, form, conv_id, turn, quoting, idx, content, length(mark) - length(replace(mark, '>', '')) AS level,
         trim(regexp_replace(lower(content), '\s+', ' ', 'g')) AS said
  FROM (SELECT *, CASE WHEN mark = '' THEN line ELSE trim(substr(line, length(mark) + 1)) END AS content FROM marked)
), own AS (
  SELECT * FROM lines
  WHERE level = 0 AND NOT (quoting AND regexp_matches(content, '^.{0,200}\b(?:wrote|schrieb|a écrit|escribió)\s?:\s*$'))
), clean AS (
  SELECT m.mid, CASE WHEN any_value(m.quoting)
                     THEN coalesce(trim(string_agg(own.content, chr(10) ORDER BY own.idx), chr(10)), '')
                     ELSE any_value(m.text) END AS message
  FROM m LEFT JOIN own ON own.mid = m.mid GROUP BY m.mid
), said AS (
  SELECT form, conv_id, turn, said AS unit FROM own
  UNION ALL
  SELECT any_value(form), any_value(conv_id), any_value(turn),
         trim(regexp_replace(string_agg(said, ' ' ORDER BY idx), '\s+', ' ', 'g'))
  FROM own GROUP BY mid
), first AS (
  SELECT form, conv_id, unit, min(turn) AS original FROM said WHERE unit <> '' GROUP BY form, conv_id, unit
), runs AS (
  SELECT *, sum(fresh) OVER (PARTITION BY mid ORDER BY idx) AS run
  FROM (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY mid ORDER BY idx) THEN 1 ELSE 0 END AS fresh
        FROM lines)
), quoted AS (
  SELECT DISTINCT form, conv_id, turn, level, unit
  FROM (SELECT form, conv_id, turn, level, said AS unit FROM lines WHERE level > 0
        UNION ALL
        SELECT any_value(form), any_value(conv_id), any_value(turn), any_value(level), trim(string_agg(said, ' ' ORDER BY idx))
        FROM runs WHERE level > 0 GROUP BY mid, run)
  WHERE unit <> ''
), found AS (
  SELECT q.form, q.conv_id, q.turn, f.original, count(*) AS units
  FROM quoted q JOIN first f ON f.form = q.form AND f.conv_id = q.conv_id AND f.unit = q.unit
  WHERE q.level = 1 AND f.original < q.turn GROUP BY ALL
), parent AS (
  SELECT form, conv_id, turn, original AS parent FROM found
  QUALIFY row_number() OVER (PARTITION BY form, conv_id, turn ORDER BY units DESC, original DESC) = 1
), up AS (
  SELECT form, conv_id, turn, parent, parent AS root, 1 AS depth FROM parent
  UNION ALL
  SELECT up.form, up.conv_id, up.turn, up.parent, p.parent, up.depth + 1
  FROM up JOIN parent p ON p.form = up.form AND p.conv_id = up.conv_id AND p.turn = up.root
), thread AS (
  SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY form, conv_id, turn ORDER BY depth DESC) = 1
)
SELECT m.form, m.conv_id,
       row_number() OVER (PARTITION BY m.form, m.conv_id
                          ORDER BY coalesce(t.root, m.turn) NULLS FIRST, m.turn NULLS FIRST, m.role NULLS FIRST, c.message) - 1
         AS position,
       m.turn, m.role, t.parent AS parent_turn, coalesce(t.root, m.turn) AS root_turn,
       coalesce(t.depth, 0)::BIGINT AS depth, c.message
FROM m JOIN clean c ON c.mid = m.mid
LEFT JOIN thread t ON t.form = m.form AND t.conv_id = m.conv_id AND t.turn = m.turn"""
