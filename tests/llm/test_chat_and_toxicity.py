"""Quotation linking, toxicity, and the pipeline."""

import duckdb
import pandas as pd
import pytest

from tests.llm.fixtures import EDGES, SF, docs
from tickvault.llm import quotes, registry, toxicity

MESSAGES = [
    (1, 0, "user", "Hello there\nHow are you?"),
    (1, 1, "assistant", "> How are you?\nFine."),
    (1, 2, "user", "New topic"),
    (1, 3, "assistant", "Bob wrote:\n> > How are you?\n> Fine.\nGood to hear"),
    (1, 4, "user", "> unknown\nwhat"),
    (1, 5, "user", "> New   TOPIC\nok"),
    (2, 0, "user", None),
    (2, 1, "user", ">\n> \n"),
    (3, 7, "user", "x"),
    (3, 7, "user", "x"),
    (3, 9, "user", "> X\ny"),
]


def test_links_depth_and_order(spark):
    df = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS root", "2 AS level")
    got = {(r.conv_id, r.position): r for r in quotes.conversations(spark, df).collect()}
    first = [(got[1, k].turn, got[1, k].parent_turn, got[1, k].root_turn, got[1, k].depth) for k in range(6)]
    assert first == [(0, None, 0, 0), (1, 0, 0, 1), (3, 1, 0, 2), (2, None, 2, 0), (5, 2, 2, 1), (4, None, 4, 0)]
    assert got[1, 2].message == "Good to hear" and got[1, 5].message == "what"
    assert got[2, 0].message == "" and got[2, 1].message == ""
    assert got[3, 2].parent_turn == 7 and len(got) == len(MESSAGES)


def test_quotes_match_sql(spark, tmp_path):
    rows = MESSAGES + [(4, k, "user", f"line {k}\n\nmore of {k % 3}") for k in range(6)]
    pdf = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
    pdf.to_parquet(f"{tmp_path}/conversations.parquet")
    got = quotes.query(spark, str(tmp_path)).toPandas()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet')")
    want = c.execute(quotes.SQL).df()[list(got.columns)]

    def key(f):
        plain = lambda v: None if pd.isna(v) else v if isinstance(v, str) else int(v)
        return sorted(str([plain(v) for v in r]) for r in f.itertuples(index=False, name=None))

    assert key(got) == key(want)


def test_null_conversations_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 1, None, "x"), (None, None, "user", "> x")], "conv_id long, turn long, role string, text string")
    assert quotes.conversations(spark, df).count() == 2
    assert quotes.conversations(spark, df.limit(0)).count() == 0


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.query(spark, sf).toPandas()
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.toxic).mean() > 0.9
    assert got.score.between(0, 1).all() and len(got) == 1000


def test_toxicity_finds_sentences_and_edges(spark):
    model = toxicity.Model(-8.0, {"idiot": 9.0, "awful": 5.0, "vile": 5.0})
    df = docs(spark, [(1, "A fine day. You IDIOT! Yes"), (2, "An awful day. A vile one"), (3, "awful and vile")] + EDGES)
    rows = toxicity.detect(df, model).collect()
    by = {r.doc_id: r.toxicity for r in rows}
    assert [(s.start, s.end) for s in by[1].sentences] == [(11, 21)]
    assert by[1].score > 0.5 > by[2].score and by[3].score > 0.5
    assert by[900].score == by[901].score == 0.0 and len(rows) == len(EDGES) + 3


def test_toxicity_does_not_grow_with_length(spark):
    model = toxicity.Model(-8.0, {"idiot": 9.0, "awful": 5.0})
    rows = [
        (1, "A fine day. " * 30_000),
        (2, ("An awful day. " + "A fine day. " * 200) * 100),
        (3, "A fine day. " * 30_000 + "An awful day. " * 20 + "A fine day. " * 30_000),
        (4, "A fine day. " * 30_000 + "You IDIOT! " + "A fine day. " * 30_000),
    ]
    score = {r.doc_id: r.toxicity.score for r in toxicity.detect(docs(spark, rows), model).collect()}
    assert score[1] == 0.0 and score[2] < 0.1
    assert score[3] > 0.5 and score[4] > 0.5


def test_joined_clean_documents_stay_clean(spark):
    sf = "/root/testdata/sf0.01"
    table, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(table, labels)
    scored = toxicity.detect(table.join(labels.select("doc_id", "toxic"), "doc_id"), model)
    rows = scored.filter(toxicity.held_out(scored["doc_id"])).orderBy("doc_id").collect()
    clean = [r.text for r in rows if r.toxic == 0 and r.toxicity.score < 0.5]
    toxic = next(r.text for r in rows if r.toxic == 1 and r.toxicity.score >= 0.5)
    long = "\n".join(clean * 10)
    joined = docs(spark, [(1, long), (2, f"{long}\n{toxic}\n{long}")])
    score = {r.doc_id: r.toxicity.score for r in toxicity.detect(joined, model).collect()}
    assert score[1] < 0.5 <= score[2]


@pytest.mark.parametrize("toxic", [[], [(1, 0)], [(1, None), (None, 1)]])
def test_toxicity_without_both_classes(spark, toxic):
    labels = spark.createDataFrame(toxic, "doc_id long, toxic int")
    model = toxicity.train(docs(spark, EDGES), labels)
    assert toxicity.detect(docs(spark, EDGES), model).filter("toxicity.score >= 0.5").count() == 0


def test_labels_of_the_held_out_fold_are_never_read(spark):
    import zlib

    ids = [i for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    used = {r.doc_id for r in toxicity.training_labels(labels).collect()}
    assert used == {i for i in ids if zlib.crc32(str(i).encode()) % 5}
    assert toxicity.training_labels(labels, max_docs=10).count() == 10


def test_pipeline_stages(spark):
    """Each stage against its operator's own verdicts on the stage's input."""
    import corpus_pipeline as cp
    from tickvault.llm import jaccard_join, packing, quality, secrets

    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality rules", "n-gram Jaccard join", "secret scans", "packing"]
    table = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    data = table
    for name, stage in cp.STAGES:
        out = stage(spark, data, SF)
        seen[name] = (data, out)
        if name != "packing":
            assert out.columns == table.columns
        data = spark.createDataFrame(out.toPandas(), out.schema)
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    before, after = seen["toxicity"]
    scored = toxicity.detect(before, toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet")))
    assert ids(after) == ids(scored.filter("toxicity.score < 0.5"))
    before, after = seen["quality rules"]
    assert ids(after) == ids(quality.quality_rules(before).filter("quality.kept"))
    before, after = seen["n-gram Jaccard join"]
    same = jaccard_join.jaccard_components(spark, before, 5, 80).filter("doc_id = component_id")
    assert ids(after) == ids(same)
    before, after = seen["secret scans"]
    assert ids(before) == ids(after)
    assert secrets.scan(after, secrets.train(before)).filter("exists(secrets, x -> x.kind < 3 and not x.value like '%[SECRET]%')").count() == 0
    before, after = seen["packing"]
    pieces = after.select("doc_id", "start", "length", "ids_crc32").collect()
    want = packing.pieces(before).selectExpr("doc_id", "start", "length", "crc32(ids) AS ids_crc32").collect()
    key = lambda r: (r.doc_id, r.start)
    assert sorted(pieces, key=key) == sorted(want, key=key)


def test_registry():
    assert [n for n in registry.QUERIES] == sorted(registry.QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert set(registry.SQL) <= set(registry.QUERIES)
