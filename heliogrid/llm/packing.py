"""Best-fit packing of tokenised documents, certified by lower bounds.

Documents are cut into pieces of at most ``capacity`` tokens; full pieces are sequences of
their own.  The rest is dealt by hash to partitions of about PART_ROWS pieces, each packed
by best-fit decreasing.  Dual-feasible functions give every partition a lower bound on the
sequences it needs.  Partitions that use no more are certified and done.  The others have
a gap: they exchange documents, being dealt anew among themselves into half as many
partitions (as many, once these are GROWTH times as large), and rerun, as long as that saves
sequences.  Last, the emptiest sequence of every partition is opened and those pieces are
packed together, as every partition may have rounded up by one; that is done in groups of
about PART_ROWS pieces, and again with the groups' emptiest sequences.

Defined results.  A null text is empty, so it is the end token alone.  Repeated rows are
documents of their own, dealt by a row number, so that rows without ids or with one id spread
too.  A null id is an ordinary value.  Ties in length go by id, piece and row.  A text of any
length is tokenised whole.  An empty table gives an empty result.  Only the named columns are
read; ``carry`` columns pass through, and may be named like no result.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import written

CAPACITY = 1024
END_TOKEN = 2
PART_ROWS = 50_000
#: A partition that exchanges documents grows to this many times PART_ROWS at most.
GROWTH = 8
_CACHE_WORDS = 200_000
_CACHE_CHARS = 48
_MARKS = '!"#$%&()*+,-./:;<=>?@[]^_`{|}~'

_encoders: dict[str, Encoder] = {}


def _bytes_of(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _by_ranks(path: str, slow):
    """The tokenizer file's own merges, run by a faster merge loop; None if the file does not allow it.

    It does if it is byte-level BPE whose ids rise in the order of its merges, so that ids
    are ranks.  The two are held against each other on a few texts when a worker starts.
    """
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in pairs]
    single = [model["vocab"].get(c) for c in byte_of]
    if None in single or max(single) > min(made) or any(x >= y for x, y in zip(made, made[1:])):
        return None
    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if all(c in byte_of for c in t)}
    known = set(made)
    ranks = {t: i for t, i in ranks.items() if i in known or len(t) == 1}
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    probes = ["Some words, 12 of them; it's\n\n  spaced  out\t!", " été Ürünü niño", "日本語 \u00a0 x", "", "$$$ *** a"]
    return fast if all(fast(t) == slow(t) for t in probes) else None


class Encoder(dict):
    """Token ids of texts, as little-endian 32-bit bytes, with a bounded cache of words.

    Byte-level pre-tokenisation never joins what stands before a single space between two
    visible characters with what follows it, and makes a single line break between visible
    characters a part of its own.  So texts can be cut there, and most of their parts have
    been encoded before.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        self.uneven = re.compile(r"\s\s").search  # \s holds all white space of Unicode, and 1C to 1F
        self.cut = re.compile(r"(?<=\S) (?=\S)").split
        self.encode = _by_ranks(path, self._slow) or self._slow

    def _slow(self, part: str) -> list[int]:
        return self.tokenizer.encode(part, add_special_tokens=False).ids

    def __missing__(self, part: str) -> bytes:
        stem = part.rstrip(_MARKS)
        if len(stem) < len(part) and stem[-1:].isalpha():  # letters and the marks behind them are apart too
            ids = self[stem] + self[part[len(stem) :]]
        else:
            ids = _bytes_of(self.encode(part))
        if len(part) <= _CACHE_CHARS and len(self) < _CACHE_WORDS:
            self[part] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if self.added(text):  # a token beside the merges, such as an end mark, is one id
            return _bytes_of(self._slow(text))
        if self.uneven(text) or text[:1].isspace() or text[-1:].isspace():
            first, *rest = self.cut(text)
            return self[first] + b"".join([self[" " + x] for x in rest])
        out = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(self[first] + b"".join([self[" " + x] for x in rest]))
        return self["\n"].join(out)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_token: int = END_TOKEN) -> DataFrame:
    """Tokenise and cut: id_col, piece, start, length, ids (binary, little-endian 32-bit).

    Only documents longer than ``capacity`` are cut, and only their first piece is shorter.
    """
    size = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        end = np.array([end_token], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, len(batch), 128):
                part = batch.slice(lo, 128)
                owner, number, start, data = [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = (enc.ids(text) if text else b"") + end
                    cuts = [0, *range(len(ids) % size or size, len(ids), size), len(ids)] if len(ids) > size else [0, len(ids)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        owner.append(i)
                        number.append(k)
                        start.append(a // 4)
                        data.append(ids[a:b])
                columns = [part.column(0).take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in data], pa.int64()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "piece", "start", "length", "ids"])

    source = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids binary")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that these lengths need at least, by two families of dual-feasible functions."""
    n = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    best = -(-int((n * x).sum()) // capacity)
    for cut in range(1, capacity // 2 + 1):  # below cut 0, above capacity - cut a whole bin
        value = np.where(x > capacity - cut, capacity, np.where(x < cut, 0, x))
        best = max(best, -(-int((n * value).sum()) // capacity))
    for k in range(1, 33):  # (k + 1) x / capacity rounded down, in k-ths of a bin
        whole = (k + 1) * x % capacity == 0
        value = np.where(whole, x * k, (k + 1) * x // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((n * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length (given in descending order), and the bins' fills."""
    spaces: list[int] = []  # sorted distinct residual capacities that open bins have
    bins: dict[int, list[int]] = {}
    fill: list[int] = []
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        at = bisect_left(spaces, size)
        if at == len(spaces):
            b = len(fill)
            fill.append(0)
        else:
            space = spaces[at]
            b = bins[space].pop()
            if not bins[space]:
                del bins[space]
                del spaces[at]
        where[i], offset[i] = b, fill[b]
        fill[b] += size
        left = capacity - fill[b]
        if left:
            if left not in bins:
                insort(spaces, left)
                bins[left] = []
            bins[left].append(b)
    return where, offset, np.array(fill, np.int64)


def pack(items: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, carry: tuple[str, ...] = (), part_rows: int = PART_ROWS) -> DataFrame:
    """Place pieces into sequences: adds sequence_id, offset, part_bound and certified to every row.

    ``items`` has id_col, piece, start, length and the carried columns.  part_bound is the
    lower bound of the row's partition (1 for a full piece), certified whether it used no more.
    """
    given = [id_col, "piece", "start", "length", *carry]
    items = written(items.select(*given, F.monotonically_increasing_id().alias("__row")), "pack-items")
    base = [*given, "__row"]
    short = items.filter(F.col("length") < capacity)
    total = short.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    schema = T.StructType([*items.schema.fields, T.StructField("part", T.LongType()), T.StructField("bin", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("bins", T.LongType()), T.StructField("bound", T.LongType()), T.StructField("last", T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), (id_col, "ascending"), ("piece", "ascending"), ("__row", "ascending")])
        lengths = table["length"].to_numpy()
        where, offset, fill = best_fit_decreasing(lengths, capacity)
        same = lambda x: pa.array(np.full(len(lengths), x, np.int64))
        made = {"bin": pa.array(where), "offset": pa.array(offset), "bins": same(len(fill)), "bound": same(lower_bound(lengths, capacity)), "last": same(int(fill.argmin()))}
        for name, column in made.items():
            table = table.append_column(name, column)
        return table.select(schema.names)

    used = 0

    def packed(df: DataFrame, n: int) -> DataFrame:
        """Deal the rows to n partitions, numbered on, and pack each."""
        nonlocal used
        part = F.lit(used) + F.pmod(F.xxhash64("__row", F.lit(used)), F.lit(n))
        used += n
        return written(df.select(*base).withColumn("part", part).groupBy("part").applyInArrow(run, schema), "packed")

    def stats(df: DataFrame) -> DataFrame:  # a row a partition
        return df.groupBy("part").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound"), F.count(F.lit(1)).alias("n"))

    def sums(df: DataFrame):
        return df.agg(F.count(F.lit(1)).alias("parts"), F.coalesce(F.sum("bins"), F.lit(0)).alias("bins"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()

    now = packed(short, max(1, -(-total // part_rows)))
    while True:
        gap = written(stats(now).filter("bins > bound"), "pack-gap")
        open_ = sums(gap)
        if open_["parts"] < 2:
            break
        again = packed(now.join(gap, "part", "left_semi"), max(-(-open_["parts"] // 2), -(-open_["n"] // (GROWTH * part_rows))))
        if sums(stats(again))["bins"] >= open_["bins"]:
            break
        now = written(now.join(gap, "part", "left_anti").unionByName(again), "packed-round")
    done = []
    while (parts := sums(stats(now))["parts"]) > 1:
        loose = now.filter("bin = last")
        rest = packed(loose, max(1, -(-loose.count() // part_rows)))
        if sums(stats(rest))["bins"] >= parts:
            break
        done.append(now.filter("bin <> last"))
        now = rest
    for kept in done:
        now = now.unionByName(kept)
    wide = F.lit(1 << 24)  # bins of a partition are far fewer
    placed = now.select(*given, (F.col("part") * wide + F.col("bin")).alias("sequence_id"), "offset", F.col("bound").alias("part_bound"), (F.col("bins") <= F.col("bound")).alias("certified"))
    whole = items.filter(F.col("length") >= capacity).select(*given, (-1 - F.col("__row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(1).cast("long").alias("part_bound"), F.lit(True).alias("certified"))
    return placed.unionByName(whole)
