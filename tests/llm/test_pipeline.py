"""The whole pipeline, written and reread stage by stage, against plain versions."""

import collections
import shutil

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from tests.llm.fixtures import EDGES, SF
from tests.llm.test_duplicates import components
from tickvault.llm import quality, registry
from tickvault.llm.encoder import Encoder, default_path


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    root = tmp_path_factory.mktemp("pipeline")
    given = spark.read.parquet(f"{SF}/documents.parquet")
    edges = spark.createDataFrame([(i, t) for i, t in EDGES if len(t or "") < 40_000], "doc_id long, text string")
    for c in given.columns:
        if c not in edges.columns:
            edges = edges.selectExpr("*", f"CAST(NULL AS {given.schema[c].dataType.simpleString()}) AS {c}")
    again = given.orderBy("doc_id").limit(3)
    given.unionByName(edges).unionByName(again).write.parquet(f"{root}/documents.parquet")
    shutil.copy(f"{SF}/labels.parquet", f"{root}/labels.parquet")
    return str(root)


def test_run_equals_the_plain_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder).toPandas()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]

    # toxicity: the scores of its own query, one for every row
    scored = registry.QUERIES["op3_toxicity"](spark, folder).collect()
    toxic = {r.doc_id for r in scored if r.predicted == 1}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    marked = [d for d, _ in rows if labels.get(d) == 1]
    assert marked and sum(d in toxic for d in marked) >= 0.8 * len(marked)
    assert sum(labels.get(d) == 0 for d in toxic) <= 0.02 * len(rows)
    rows = [r for r in rows if r[0] not in toxic]

    # quality rules: the SQL of its query
    table = pd.DataFrame({"doc_id": range(len(rows)), "text": [t for _, t in rows]})
    con = duckdb.connect()
    con.register("numbered", table)
    kept = dict(con.sql(f"SELECT doc_id, kept FROM ({quality.oracle('numbered')})").fetchall())
    rows = [r for k, r in enumerate(rows) if kept[k]]
    assert len(rows) > 50

    # near duplicates: all pairs
    first = {i: component for missing, i, _, component in components(rows, 5, 80) if not missing}
    rows = [r for r in rows if r[0] is None or first[r[0]] == r[0]]

    # secrets are replaced, nothing goes; packing gives every id one place
    assert collections.Counter(map(str, out[out.start == 0].doc_id.dropna().astype(int))) == collections.Counter(
        str(d) for d, _ in rows if d is not None
    )
    assert out.doc_id.isna().any() == any(d is None for d, _ in rows)
    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(f"{folder}/left/documents.parquet")
    hidden = {r.doc_id for r in registry.QUERIES["op6_secret_scan"](spark, f"{folder}/left").collect() if r.spans}
    tokenizer = Encoder(default_path()).tokenizer
    sizes = {d: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in rows}
    told = {int(d): n for d, n in zip(out.doc_id, out.doc_tokens) if d == d}
    plain = [d for d, _ in rows if d is not None and d not in hidden]
    assert len(plain) > 30 and all(told[d] == sizes[d] for d in plain)
    assert all(told[d] != 0 for d in told)
    for _, seq in out.sort_values("offset").groupby("sequence_id"):
        assert (seq.offset == seq.length.cumsum() - seq.length).all() and seq.length.sum() <= 4096


def test_an_empty_table_gives_no_rows(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    shutil.copy(f"{SF}/labels.parquet", f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
