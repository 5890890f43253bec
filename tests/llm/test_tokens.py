"""Encoder, packing, token files and the piece transducer against the libraries."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.fixtures import EDGES, SF, docs, prose
from tickvault.llm import packing, piece_fst, token_files
from tickvault.llm.encoder import Encoder, default_path

ODD = [
    "Hello  World's it'S 1st <|endoftext|> x",
    "naïve ÉCOLE ß ſ K İstanbul Σίσυφος ΟΔΟΣ",
    "a\x1cb \x85c\xa0d …“x” ȩ́ z",
    "日本語 テキスト 한국어 ½²³ªº µ",
    "it''s !!a,b.c--d '' 'll 'S K",
]


@pytest.fixture(scope="module")
def enc():
    return Encoder(default_path())


def ids_of(enc, text):
    return np.array(enc.tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4").tobytes()


def test_encoder_equals_library(enc, spark):
    texts = ODD + [t for _, t in EDGES] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    end = np.array([2], "<u4").tobytes()
    assert enc.encode(texts, end) == [ids_of(enc, t) for t in texts]


def test_encoder_keeps_bounded_bytes():
    enc = Encoder(default_path())
    rng = random.Random(5)
    for _ in range(12):
        # pieces without a blank, every one new, 8 MB a call
        texts = ["".join(rng.choices("abcdefgh.", k=1 << 12)) * 64 for _ in range(32)]
        enc.flat(pa.array(texts, pa.string()))
    held = sum(len(k) + len(v) for c in (enc.pieces.now, enc.pieces.old) for k, v in c.items())
    assert held < 200 << 20


def test_cutting_stock_meets_demand_exactly():
    rng = random.Random(3)
    for cap, demand in [
        (10, {3: 7, 4: 5, 10: 2}),
        (64, {s: rng.randint(1, 30) for s in range(1, 65)}),
        (64, {1: 1}),
    ]:
        plan = packing.patterns(demand, cap)
        made = {}
        for held, times in plan:
            assert sum(s * n for s, n in held.items()) <= cap
            for s, n in held.items():
                made[s] = made.get(s, 0) + n * times
        assert made == demand
        bound = -(-sum(s * n for s, n in demand.items()) // cap)
        assert sum(t for _, t in plan) <= bound + max(2, bound // 20)
    assert packing.patterns({}, 8) == []


def test_packing_is_whole_and_gapless(spark, enc):
    rows = [(i, prose(random.Random(i), 40 * i)) for i in range(120)] + EDGES
    got = packing.packed(spark, docs(spark, rows)).toPandas()
    seq = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id").length
    assert (seq.cumsum() - got.sort_values(["sequence_id", "offset"]).length == got.sort_values(["sequence_id", "offset"]).offset).all()
    assert seq.sum().max() <= 4096
    want = sorted(
        (zlib.crc32(x[a : a + 4 * 4096]), a // 4, len(x) // 4)
        for _, t in rows
        for x in [ids_of(enc, t)]
        for a in range(0, len(x), 4 * 4096)
    )
    assert sorted(got[["ids_crc32", "start", "doc_tokens"]].itertuples(index=False, name=None)) == want
    total = got.length.sum()
    assert 1 - total / (4096 * got.sequence_id.nunique()) < 0.05


def test_packing_an_empty_table(spark):
    assert packing.packed(spark, docs(spark, EDGES).limit(0)).count() == 0


def test_token_files(spark, enc, tmp_root):
    rows = EDGES + [(i, prose(random.Random(i), 30)) for i in range(50, 0, -1)]
    token_files.write_tokens(docs(spark, rows), f"{tmp_root}/t")
    got = token_files.read_index(spark, f"{tmp_root}/t").orderBy("start").collect()
    start = 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for r, (i, t) in zip(got, order, strict=True):
        ids = ids_of(enc, t)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    found = token_files.lookup(spark, f"{tmp_root}/t", [7]).first()
    assert np.array(found.ids, "<u4").tobytes() == ids_of(enc, dict(rows)[7])


def test_token_files_of_an_empty_table(spark, tmp_root):
    token_files.write_tokens(docs(spark, EDGES).limit(0), f"{tmp_root}/t")
    assert token_files.read_index(spark, f"{tmp_root}/t").count() == 0


def test_transducer_equals_library_and_round_trips(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_fst.default_path())
    m = piece_fst.Machine(piece_fst.default_path())
    rng = random.Random(1)
    texts = ODD + [t for _, t in EDGES] + ["  a  b ", "      x", "\n\n\t", "for (i=0;i<9;++i){\n        x\n    }", "<s> <0x0A> </s>"]
    texts += ["".join(rng.choice("  ab.cth ein,(1\n>") for _ in range(25)) for _ in range(200)]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    for t in texts:
        ids = m.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(t or "")
        assert m.decode(ids) == (t or "")


def test_transducer_columns(spark):
    df = docs(spark, EDGES)
    ids = df.select("text", piece_fst.encode(df["text"]).alias("p"))
    back = ids.select("text", piece_fst.decode(ids["p"]).alias("b")).collect()
    assert all(r.b == (r.text or "") for r in back)
