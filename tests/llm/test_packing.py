import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from heliogrid.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_encoder_equals_tokenizer():
    plain = Tokenizer.from_file(PATH)
    texts = ["One two, three.\nFour  five\n\n six ", "it's I'll they'd'x", "a\x1c b c   d", "", " lead", "x\n", "<|endoftext|> hi", "a  <|endoftext|>b <|endoftext|>", "<|endoftext", "Été!! niño *** $$$a", "日本 語 x1 22 é", "a.b!? c--", "\x85 a"]
    enc = packing.Encoder(PATH)
    for t in texts * 2:
        assert enc.ids(t) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_bounds_and_best_fit():
    rng = np.random.default_rng(3)
    for top in (40, 300, 1023):
        x = np.sort(rng.integers(1, top, 400))[::-1]
        where, offset, fill = packing.best_fit_decreasing(x, 1024)
        assert fill.max() <= 1024 and fill.sum() == x.sum()
        for b in range(len(fill)):
            mine = np.argsort(offset[where == b])
            assert (np.cumsum(np.append(0, x[where == b][mine]))[:-1] == offset[where == b][mine]).all()
        assert -(-x.sum() // 1024) <= packing.lower_bound(x, 1024) <= len(fill)
    assert packing.lower_bound(np.array([600] * 5), 1024) == 5
    assert packing.lower_bound(np.array([342] * 9), 1024) == 5


@pytest.mark.parametrize("part_rows", [50_000, 40])
def test_pack_whole_documents(spark, part_rows):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["alpha", "beta", "Gamma,", "delta."], int(n))) for n in rng.integers(1, 900, 120)]
    rows = [(k, t, 7) for k, t in enumerate(texts)] + [(500, None, 7), (501, "", 7), (None, "x", 7), (3, texts[3], 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part long")
    cut = packing.pieces(df, PATH, capacity=256).withColumn("crc", F.crc32("ids"))
    out = packing.pack(cut, capacity=256, carry=("crc",), part_rows=part_rows).toPandas()
    plain = Tokenizer.from_file(PATH)
    want = []
    for d, t, _ in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 256 or 256, len(ids), 256), len(ids)] if len(ids) > 256 else [0, len(ids)]
        want += [(d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.crc) for r in out.itertuples()]
    assert sorted(got, key=str) == sorted(want, key=str)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 256 and (g.length.cumsum() - g.length == g.offset).all()
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 256) + 8
    if part_rows > 40:
        short = out[out.length < 256]
        assert short.certified.all() == (short.sequence_id.nunique() == short.part_bound.iloc[0])


def test_rows_without_ids_spread(spark):
    df = spark.range(600).selectExpr("CAST(NULL AS bigint) AS doc_id", "CAST(0 AS int) AS piece", "CAST(0 AS bigint) AS start", "100 + id % 7 AS length")
    out = packing.pack(df, capacity=256, part_rows=50).toPandas()
    assert len(out) == 600 and out.groupby("sequence_id").length.sum().max() <= 256 and out.sequence_id.nunique() == 300


def test_pack_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.pieces(df, PATH).drop("ids")).count() == 0
