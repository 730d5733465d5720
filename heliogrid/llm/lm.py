"""Language-model scoring of documents by stupid backoff, leaving the document itself out.

The model of a document is the n-gram counts of all other documents.  A word w after u, v:
    c(uvw) / c(uv)          if the others hold uvw,
    0.4 * c(vw) / c(v)      else, if they hold vw,
    0.16 * c(w) / N         else, if they hold w, N being their number of words,
    0.16 / (N + 1)          else.
A text's first word starts at the third line, its second at the second.  The document's
score is the sum of the logarithms.

Relationally: documents are gathered into batches, a written table of compressed texts.
Each batch is exploded into its distinct n-grams, as sorted hash arrays, one row per hash
partition.  A hash partition sums the counts of all batches, which is its n-gram count
table, and joins them back to the batches' n-grams.  The answers go to the batches, are
joined to the n-grams of each document there, less its own counts, and summed per document.

Scale.  A batch names an n-gram once, so a frequent n-gram has at most one entry per batch
and no key is hot.  Batches and hash partitions grow in number with the input and not in
size: about BATCH_BYTES of text and PART_GRAMS n-grams.  Shuffled are the compressed texts,
once, and about six bytes for every distinct n-gram of a batch.  N-grams are told apart by
hashes of as many bits as number the corpus's n-grams, and MARGIN more (64 at most), so a
look-up meets a foreign n-gram with a probability of 2**-MARGIN.

Defined results.  A null or wordless text has 0 words and score 0.  Repeated rows are
different documents that know each other.  A null id is an ordinary value.  An empty table
gives an empty result.  Extra columns are not read.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import release, written
from .textblocks import U64, Block, blocks, mix, span_hashes, window_hashes, words

ORDER = 3
BACKOFF = 0.4
BATCH_BYTES = 4 << 20
PART_GRAMS = 2_000_000
MARGIN = 26


def _grams(b: Block, bits: int):
    """Words and, by order, hashes of all n-grams with the index of each one's first word."""
    down = U64(64 - bits)
    w = words(b)
    h = span_hashes(b.data, w.start, w.end)
    out = [(mix(h + U64(1)) >> down, np.arange(len(h)))]
    for n in range(2, ORDER + 1):
        g, at = window_hashes(h, w, n)
        out.append((mix(g + U64(n)) >> down, at))
    return w, out


def _sorted_counts(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all orders in a batch, ascending, and their counts."""
    # Blocks bound the temporary arrays; the batch as a whole is bounded by BATCH_BYTES.
    found = [np.unique(np.concatenate([g for g, _ in _grams(b, bits)[1]]), return_counts=True) for b in blocks(texts)]
    if not found:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    g, c = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
    u, inverse = np.unique(g, return_inverse=True)
    return u, np.bincount(inverse, c, len(u)).astype(np.int64)


def _planes(x: np.ndarray, width: int) -> bytes:
    """Byte planes of non-negative integers, entropy-coded: like bytes stand together, and small ones cost bits."""
    planes = np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unplanes(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(f"<u{width}").ravel()


def _pack_hashes(g: np.ndarray) -> bytes:
    return _planes(np.diff(g, prepend=U64(0)), 8)


def _unpack_hashes(data: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(data, 8).astype(U64), dtype=U64)


def _document_sums(texts: pa.Array, known: np.ndarray, count: np.ndarray, n_words: int, bits: int):
    """(n_words, score, n3, n2, n1) per document, given all counts of the batch's n-grams."""
    outs = []
    for b in blocks(texts):
        w, grams = _grams(b, bits)
        others = []  # by order and n-gram: its count in the other documents
        for g, at in grams:
            order = np.argsort(g, kind="stable")
            sg, sd = g[order], w.doc[at[order]]
            new = np.ones(len(sg), bool)
            new[1:] = (sg[1:] != sg[:-1]) | (sd[1:] != sd[:-1])
            first = np.flatnonzero(new)
            own = np.diff(np.append(first, len(sg)))
            rest = np.empty(len(g), np.int64)
            rest[order] = np.repeat(count[np.searchsorted(known, sg[first])] - own, own)
            others.append(rest)
        total = len(w.start)
        by_word = [np.zeros(total, np.int64) for _ in range(ORDER)]  # of the n-gram that ends in the word
        for k, (_, at) in enumerate(grams):
            by_word[k][at + k] = others[k]
        c1, c2, c3 = by_word
        v1, v2 = np.zeros(total, np.int64), np.zeros(total, np.int64)  # of the contexts
        if total > 1:
            v1[1:] = c1[:-1]
            v2[1:] = c2[:-1]
        n = np.maximum(n_words - w.count[w.doc], 0)
        use3, use2, use1 = c3 > 0, (c3 <= 0) & (c2 > 0), (c3 <= 0) & (c2 <= 0) & (c1 > 0)
        score = np.log(BACKOFF * BACKOFF / (n + 1.0))
        score[use1] = np.log(BACKOFF * BACKOFF * c1[use1] / n[use1])
        score[use2] = np.log(BACKOFF * c2[use2] / v1[use2])
        score[use3] = np.log(c3[use3] / v2[use3])
        docs = len(b.starts)
        some = w.count > 0
        sums = [np.zeros(docs) for _ in range(4)]
        if total:
            for out, x in zip(sums, (score, use3, use2, use1)):
                out[some] = np.add.reduceat(x.astype(np.float64), w.first[some])
        outs.append((w.count, *sums))
    return [np.concatenate(x) for x in zip(*outs)] if outs else [np.zeros(0)] * 5


def _batches(docs: DataFrame, id_col: str, text_col: str, batch_bytes: int) -> DataFrame:
    """(batch, blob): runs of documents of about batch_bytes, as compressed Arrow tables."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def emit():
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            name = int.from_bytes(os.urandom(8), "big") >> 1
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch", "blob"])

        for batch in rows:
            at = 0
            while at < len(batch):
                n = max(1, min(len(batch) - at, len(batch) * batch_bytes // max(1, 4 * batch.nbytes)))
                held.append(batch.slice(at, n))
                size += held[-1].nbytes
                at += n
                if size >= batch_bytes:
                    yield emit()
                    held, size = [], 0
        if held:
            yield emit()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "batch long, blob binary")


def _unpack(blob) -> tuple[pa.Array, pa.Array]:
    """(ids, texts) of a batch."""
    table = pa.ipc.open_stream(blob).read_all().combine_chunks()
    flat = lambda c: c.chunk(0) if c.num_chunks else pa.array([], c.type)
    return flat(table["id"]), flat(table["t"])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, part_grams: int = PART_GRAMS) -> DataFrame:
    """Score every document: id_col, n_words, log_score (natural), n_trigram, n_bigram, n_unigram.

    The last three count the words scored by trigram, by bigram and by unigram.
    """
    size = docs.agg(F.sum(F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))).alias("w")).first()
    n_words = int(size["w"] or 0)
    n_parts = max(1, -(-ORDER * n_words // part_grams))
    bits = min(64, max(40, math.ceil(math.log2(ORDER * n_words + 1)) + MARGIN))
    batches = written(_batches(docs, id_col, text_col, batch_bytes), "lm-batches")

    def explode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for batch, blob in zip(row.column(0), row.column(1)):
                g, c = _sorted_counts(_unpack(blob.as_buffer())[1], bits)
                part = ((g >> U64(bits - 32)) * U64(n_parts) >> U64(32)).astype(np.int64)  # ascending with g
                cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(g) else np.zeros(0, np.int64)
                ends = np.append(cuts[1:], len(g)) if len(g) else cuts
                made = [pa.array(part[cuts], pa.int64()), pa.array(np.full(len(cuts), batch.as_py(), np.int64)), pa.array([_pack_hashes(g[a:z]) for a, z in zip(cuts, ends)], pa.binary()), pa.array([_planes(c[a:z], 4) for a, z in zip(cuts, ends)], pa.binary())]
                yield pa.RecordBatch.from_arrays(made, names=["part", "batch", "grams", "counts"])

    grams = batches.mapInArrow(explode, "part long, batch long, grams binary, counts binary")

    def tabulate(key: tuple, table: pa.Table) -> pa.Table:
        asked = [_unpack_hashes(x.as_py()) for x in table["grams"]]
        counts = [_unplanes(x.as_py(), 4).astype(np.int64) for x in table["counts"]]
        known, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        sums = np.bincount(inverse, np.concatenate(counts), len(known)).astype(np.int64)[inverse]
        ends = np.cumsum([len(x) for x in asked])
        return pa.table({
            "batch": table["batch"],
            "part": table["part"],
            "totals": pa.array([_planes(sums[e - len(x) : e], 4) for e, x in zip(ends, asked)], pa.binary()),
        })

    answers = grams.repartition(n_parts, "part").groupBy("part").applyInArrow(tabulate, "batch long, part long, totals binary")
    answers = written(answers, "lm-counts")
    del grams
    release(docs.sparkSession)

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts = _unpack(left["blob"][0].as_buffer())
        g, _ = _sorted_counts(texts, bits)
        order = np.argsort(right["part"].to_numpy())
        rows = right["totals"].to_pylist()
        counts = np.concatenate([_unplanes(rows[i], 4) for i in order]).astype(np.int64) if rows else np.zeros(0, np.int64)
        sums = _document_sums(texts, g, counts, n_words, bits)
        return pa.table({"id": ids, "n_words": pa.array(sums[0].astype(np.int64)), "log_score": pa.array(sums[1]), **{n: pa.array(x.astype(np.int64)) for n, x in zip(("n_trigram", "n_bigram", "n_unigram"), sums[2:])}})

    id_type = docs.schema[id_col].dataType.simpleString()
    out = batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(finish, f"id {id_type}, n_words long, log_score double, n_trigram long, n_bigram long, n_unigram long")
    return out.withColumnRenamed("id", id_col)

