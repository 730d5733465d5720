"""N-gram Jaccard join by parity sketches.

1. Every text is reduced to the set of its word shingles, a 64-bit class (equal sets have
   equal classes), and a parity sketch.
2. Each class gives out its pigeonhole keys (see ``parity``).  Within a task a class does
   so once, so a group of copies adds no rows.
3. Keys are sorted; classes that share one are candidates.  Runs of up to FEW classes give
   all their pairs.  Longer runs give a star around their first class, and are kept.  A run
   that is long already within one map task is made a star there, and only its head goes to
   the key's task; so that task gets FEW + 1 rows from every map task at most.
4. Candidates pass the size bound and the sketches' Hamming bound.  Then the sets
   themselves are intersected: of each class and its smallest partner first, then of the
   pairs that are still apart.  For that, the texts of the classes concerned are fetched
   once, compressed, and dealt by pairs' first classes: one of them and up to STAR partners
   meet in a task, so a text is shipped once a pair at most.
5. Links give components.  Of the kept runs whose members are still in different components,
   each class forgets the EXTRA most frequent ones of a band, which loses no pair (see
   ``parity``) and ends the runs of passages that many documents share.  The members left are
   compared by their sketches, in blocks of bounded size that give out only what passes the
   Hamming bound; that is verified and the components closed again.  A first pass takes of
   every two components in a block the nearest pair, the second one all that is left.

No step drops a candidate that could reach the threshold, so the components are exact
(up to collisions of 64-bit hashes).

Defined results.  A text of fewer than ``n`` words is one shingle, its whole sequence; a
null or wordless text has an empty set, links with nothing and is its own component.
Rows with equal sets are linked; repeated rows are rows of their own.  A pair just at the
threshold links.  A component's id is the smallest non-null id in it.  A text of any length
is shingled whole, as one block.  An empty table gives an empty result.  Extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .parity import BAND_BITS, EXTRA, SHORT, SKETCH_WORDS, Bands, distinct, keys, sketches
from .storage import written
from .textblocks import CHUNK_BYTES, LOWER, U64, blocks, mix, short_hashes, span_hashes, window_hashes, words

FEW = 8
#: Members of a long run that are compared at once.
CHUNK = 8192
#: Partners that meet one class in one task.
STAR = 64
#: Bits of the filter by which texts are fetched; texts fetched in vain cost time only.
SLOT_BITS = 24
#: Keys that a map task sorts at once.
SORTED_KEYS = 1 << 22


def _sets(texts: pa.Array, n: int):
    """Per block: it, its distinct shingles, their documents, and each document's set size and class."""
    for b in blocks(texts):
        b.data = LOWER[b.data]
        w = words(b)
        h = span_hashes(b.data, w.start, w.end)
        s, at = window_hashes(h, w, n)
        short, docs = short_hashes(h, w, n)
        s, doc = np.concatenate([s, short]), np.concatenate([w.doc[at], docs])
        order = np.argsort(doc, kind="stable")
        s, doc = distinct(s[order], doc[order])
        size = np.bincount(doc, minlength=len(b.starts))
        cls = np.zeros(len(size), U64)
        np.add.at(cls, doc, mix(s))
        yield b, s, doc, size, mix(cls + size.astype(U64))


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5) -> DataFrame:
    """id, n_shingles, cls (null if the set is empty) and sketch of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, s, doc, size, cls in _sets(batch.column(1), n):
                bits = sketches(s, doc, len(size)).view(np.int64).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * SKETCH_WORDS), pa.array(bits))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.lo, b.hi - b.lo), pa.array(size), pa.array(cls.view(np.int64), mask=size == 0), lists], names=["id", "n_shingles", "cls", "sketch"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_shingles long, cls long, sketch array<long>")


def _stars(key: np.ndarray, cls: np.ndarray, few: int) -> pa.RecordBatch:
    """Keys of one map task, sorted: runs longer than ``few`` become stars.

    head is 0 for a class of a short run and the star's first class for all others.
    """
    order = np.lexsort((cls, key & ~SHORT))
    key, cls = key[order], cls[order]
    run = key & ~SHORT
    start = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    length = np.diff(np.append(start, len(key)))
    head = np.where(np.repeat(length > few, length), np.repeat(cls[start], length), 0)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(cls), pa.array(head)], names=["key", "cls", "head"])


def _key_rows(docs: DataFrame, text_col: str, n: int, bands: Bands, few: int) -> DataFrame:
    """(key, cls, head): the keys of every class, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, count = [], 0
        for batch in batches:
            for _, s, doc, size, cls in _sets(batch.column(0), n):
                new = np.zeros(len(size), bool)
                for i, c in enumerate(cls.tolist()):
                    if c not in seen and size[i]:
                        seen.add(c)
                        new[i] = True
                use = new[doc]
                k, owner = keys(s[use], doc[use], np.where(new, size, 0), bands)
                if len(k):
                    held.append((k.view(np.int64), cls[owner].view(np.int64)))
                    count += len(k)
                if count >= SORTED_KEYS:
                    yield from _in_slices(_stars(*map(np.concatenate, zip(*held)), few))
                    held, count = [], 0
        if held:
            yield from _in_slices(_stars(*map(np.concatenate, zip(*held)), few))

    return docs.select(text_col).mapInArrow(run, "key long, cls long, head long")


def _in_slices(batch: pa.RecordBatch, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(batch), rows):
        yield batch.slice(lo, rows)


def _run_pairs(key: np.ndarray, cls: np.ndarray, starred: np.ndarray, few: int) -> pa.RecordBatch:
    """(a, b, null) for pairs and (a, null, key) for members of long runs, of whole runs of keys equal but for SHORT.

    A run is long if it has more than ``few`` classes or one of them heads a star.
    """
    run = key & ~SHORT
    start = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(key) else np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(key)))
    small = (length <= few) & (np.add.reduceat(starred, start) == 0) if len(key) else np.zeros(0, bool)
    short = np.repeat(small, length)
    a, b = [], []
    for d in range(1, few):
        at = np.flatnonzero((run[:-d] == run[d:]) & short[d:]) if len(key) > d else np.zeros(0, np.int64)
        a.append(cls[at])
        b.append(cls[at + d])
    at = np.flatnonzero(~short)
    first = np.repeat(start, length)[at]
    ray = at != first
    return _hits(np.concatenate([*a, cls[first[ray]]]), np.concatenate([*b, cls[at[ray]]]), cls[at], key[at])


def _hits(a: np.ndarray, b: np.ndarray, member: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    pair = np.arange(len(a) + len(member)) < len(a)
    arrays = [np.concatenate([a, member]), np.concatenate([b, member]), np.concatenate([np.zeros(len(a), np.int64), key])]
    masks = [None, ~pair, pair]
    return pa.RecordBatch.from_arrays([pa.array(x, mask=m) for x, m in zip(arrays, masks)], names=["a", "b", "key"])


def _collisions(rows: DataFrame, few: int) -> DataFrame:
    """Candidates from keys: pairs (a, b), and the members (a, key) of long runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        key, cls, star = none, none, none
        for batch in batches:
            k, c, h = (batch.column(i).to_numpy() for i in range(3))
            ray = (h != 0) & (h != c)
            if ray.any():
                yield _hits(np.minimum(c, h)[ray], np.maximum(c, h)[ray], c[ray], k[ray])
            key, cls, star = (np.concatenate(x) for x in ((key, k[~ray]), (cls, c[~ray]), (star, (h != 0)[~ray].astype(np.int64))))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] & ~SHORT != key[:-1] & ~SHORT) | (cls[1:] != cls[:-1])
            if not new.all():
                star = np.add.reduceat(star, np.flatnonzero(new))
                key, cls = key[new], cls[new]
            cut = int(np.searchsorted(key & ~SHORT, key[-1] & ~SHORT)) if len(key) else 0  # the last run may go on
            if cut:
                yield _run_pairs(key[:cut], cls[:cut], star[:cut], few)
            key, cls, star = key[cut:], cls[cut:], star[cut:]
        yield _run_pairs(key, cls, star, few)

    ray = (F.col("head") != 0) & (F.col("head") != F.col("cls"))
    whole = F.col("key").bitwiseAND(F.lit(~SHORT))
    dealt = rows.repartition(F.when(ray, F.xxhash64("key", "cls")).otherwise(whole))
    return dealt.sortWithinPartitions(whole, "cls").mapInArrow(run, "a long, b long, key long")


def _close(pairs: DataFrame, classes: DataFrame, bands: Bands) -> DataFrame:
    """Those of the class pairs (a, b) that pass the bounds of size and Hamming distance."""
    num, den = bands.num, bands.den
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("rep").alias(f"rep_{x}"), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    least, most = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    distance = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    close = both.filter((den * least >= num * most) & (distance * (den + num) <= (F.col("n_a") + F.col("n_b")) * (den - num)))
    return written(close.select("a", "b"), "jaccard-close")


def _slots(values: DataFrame, name: str) -> np.ndarray:
    """A bit set of the leading bits of a column of hashes, of SLOT_BITS bits whatever the input, summed up in the executors."""
    rows = values.select(F.shiftrightunsigned(name, 64 - SLOT_BITS).alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << SLOT_BITS - 6, np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out


def _has(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 6] >> (slots & 63)) & 1 == 1


def _texts(close: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(cls, blob): the compressed texts of the classes in ``close``, from rows of their first ids.

    Filters on ids, then on classes keep most others out; what passes in vain costs time only.
    A task gives out a class once, so repeated rows add little.
    """
    wanted = close.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    wanted = written(classes.join(wanted, "cls", "left_semi").select(F.xxhash64("rep").alias("id"), "cls"), "jaccard-wanted")
    shared = docs.sparkSession.sparkContext.broadcast((_slots(wanted, "id"), _slots(wanted, "cls")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        ids, named = shared.value
        seen: set[int] = set()
        for batch in batches:
            batch = batch.filter(pa.array(_has(ids, batch.column(1).to_numpy())))
            for b, _, _, _, cls in _sets(batch.column(0), n):
                hit = np.flatnonzero(_has(named, (cls >> U64(64 - SLOT_BITS)).astype(np.int64)))
                new = [i for i in hit.tolist() if not (int(cls[i]) in seen or seen.add(int(cls[i])))]
                blobs = [press.compress(batch.column(0)[b.lo + i].as_buffer() or b"") for i in new]
                yield pa.RecordBatch.from_arrays([pa.array(cls[new].view(np.int64)), pa.array(blobs, pa.binary())], names=["cls", "blob"])

    slot = F.shiftrightunsigned(F.xxhash64(id_col), 64 - SLOT_BITS).alias("slot")
    return written(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"), slot).mapInArrow(run, "cls long, blob binary"), "jaccard-texts")


def _links(close: DataFrame, texts: DataFrame, n: int, bands: Bands, star: int) -> tuple[DataFrame, DataFrame]:
    """Links that connect what all similar pairs of ``close`` connect, and the labels they give.

    Each class is first held against its smallest partner alone; of the other pairs only those
    that this leaves in different components can add anything.
    """
    first = written(close.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "jaccard-first")
    links = written(_verified(first, texts, n, bands, star), "jaccard-links")
    labels = components(links)
    name = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    rest = close.join(first, ["a", "b"], "left_anti").join(name("a"), "a", "left").join(name("b"), "b", "left")
    rest = written(rest.filter(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b"), "jaccard-rest")
    if rest.limit(1).count():
        links = written(links.union(_verified(rest, texts, n, bands, star)), "jaccard-links")
        labels = components(links)
    return links, labels


def _verified(close: DataFrame, texts: DataFrame, n: int, bands: Bands, star: int) -> DataFrame:
    """Those of the class pairs (a, b) whose sets are similar.

    a and up to about ``star`` of its partners make a group; a's text comes first in it.
    """
    num, den = bands.num, bands.den
    degree = close.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / star).cast("int").alias("parts"))
    rays = close.join(degree, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    heads = rays.select("a", "part", F.col("a").alias("cls"), F.lit(True).alias("head")).distinct()
    asked = written(rays.select("a", "part", F.col("b").alias("cls"), F.lit(False).alias("head")).unionByName(heads), "jaccard-asked")
    full = asked.join(texts, "cls")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        group, one = None, None
        for batch in batches:
            a, part, cls, head = (batch.column(i).to_pylist() for i in range(4))
            found_a, found_b, lo = [], [], 0
            while lo < len(batch):  # a few texts at a time, as they grow when opened
                hi, raw, size = lo, [], 0
                while hi < len(batch) and (size < CHUNK_BYTES or hi == lo):
                    raw.append(open_.decompress(batch.column(4)[hi].as_buffer()))
                    size += len(raw[-1])
                    hi += 1
                at = lo
                at = lo
                for _, s, _, sizes, _ in _sets(pa.array(raw, pa.binary()), n):
                    for mine in np.split(s, np.cumsum(sizes)[:-1]):
                        if head[at]:
                            group, one = (a[at], part[at]), mine
                        elif group == (a[at], part[at]):
                            common = len(np.intersect1d(one, mine, assume_unique=True))
                            if den * common >= num * (len(one) + len(mine) - common):
                                found_a.append(a[at])
                                found_b.append(cls[at])
                        at += 1
                lo = hi
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    rows = full.select("a", "part", "cls", "head", "blob").repartition("a", "part")
    rows = rows.sortWithinPartitions("a", "part", F.col("head").desc(), "cls")
    return rows.mapInArrow(verify, "a long, b long").distinct()


def _nearest(one: np.ndarray, two: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Of pairs with labels one and two, the index of the nearest of each two labels."""
    order = np.lexsort((distance, two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    return order[new]


def _late_pairs(members: DataFrame, classes: DataFrame, bands: Bands, chunk: int, nearest: bool) -> DataFrame:
    """Pairs (a, b) of different labels within runs (key, cls, label, m members), near by their sketches.

    If ``nearest``, a block gives out one pair of every two labels, else all.  A run is cut by hash into about m / chunk parts, and every two parts meet in a block.
    """
    num, den = bands.num, bands.den
    parts = F.ceil(F.col("m") / chunk).cast("int")
    rows = members.withColumn("p", parts).withColumn("c", F.pmod(F.xxhash64("cls"), F.col("p")).cast("int"))
    rows = rows.select("key", "cls", "label", "c", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("d"))
    rows = rows.select("cls", "label", "c", (F.col("c") == F.col("d")).alias("own"), F.xxhash64("key", F.least("c", "d"), F.greatest("c", "d")).alias("block"))
    rows = rows.join(classes.select("cls", "n_shingles", "sketch"), "cls")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def pairs_of(t: dict[str, np.ndarray]) -> pa.RecordBatch:
            rows, cols, far = [], [], []
            cls, label, part, own, n, s = (t[k] for k in ("cls", "label", "c", "own", "n", "s"))
            for lo in range(0, len(cls), 256):
                i = slice(lo, lo + 256)
                dist = np.zeros((len(cls[i]), len(cls)), np.uint16)
                for w in range(s.shape[1]):
                    dist += np.bitwise_count(s[i, w, None] ^ s[None, :, w])
                both = n[i, None] + n[None, :]
                near = dist.astype(np.int64) * (den + num) <= both * (den - num)
                near &= den * np.minimum(n[i, None], n[None, :]) >= num * np.maximum(n[i, None], n[None, :])
                near &= (label[i, None] < label[None, :]) & (own[i, None] | (part[i, None] != part[None, :]))
                x, y = np.nonzero(near)
                d = dist[x, y]
                if nearest:
                    first = _nearest(label[lo + x], label[y], d)
                    x, y, d = x[first], y[first], d[first]
                rows.append(lo + x)
                cols.append(y)
                far.append(d)
            x, y, d = map(np.concatenate, (rows, cols, far))
            if nearest:
                first = _nearest(label[x], label[y], d)
                x, y = x[first], y[first]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(cls[x], cls[y])), pa.array(np.maximum(cls[x], cls[y]))], names=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            flat = batch.column(5).flatten().to_numpy()
            new = {"block": batch.column(0).to_numpy(), "cls": batch.column(1).to_numpy(), "label": batch.column(2).to_numpy(), "c": batch.column(3).to_numpy(), "n": batch.column(4).to_numpy(), "s": flat.view(U64).reshape(len(batch), -1), "own": batch.column(6).to_numpy(zero_copy_only=False)}
            held = new if held is None else {k: np.concatenate([held[k], new[k]]) for k in held}
            cuts = np.flatnonzero(held["block"][1:] != held["block"][:-1]) + 1
            for lo, hi in zip(np.append(0, cuts), cuts):
                yield pairs_of({k: v[lo:hi] for k, v in held.items()})
            last = cuts[-1] if len(cuts) else 0
            held = {k: v[last:] for k, v in held.items()}
        if held is not None and len(held["cls"]):
            yield pairs_of(held)

    rows = rows.select("block", "cls", "label", "c", "n_shingles", "sketch", "own")
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(compare, "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100, few: int = FEW, chunk: int = CHUNK, star: int = STAR) -> DataFrame:
    """Components under Jaccard similarity >= num/den of word n-shingles.

    Returns a row per row of ``docs``: id_col, n_shingles, component_id, cls (equal for
    equal sets, null for empty ones).
    """
    bands = Bands(num, den, growth=1.5)
    known = written(profiles(docs, id_col, text_col, n), "jaccard-profiles")
    classes = known.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = written(classes, "jaccard-classes")
    hits = written(_collisions(_key_rows(docs, text_col, n, bands, few), few), "jaccard-hits")
    pairs = written(hits.filter("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "jaccard-pairs")
    close = _close(pairs, classes, bands)
    links, labels = _links(close, _texts(close, classes, docs, id_col, text_col, n), n, bands, star)

    # Long runs: compare what the stars have left apart.
    whole = F.col("key").bitwiseAND(F.lit(~SHORT)).alias("key")
    member = hits.filter("key IS NOT NULL").groupBy(whole, F.col("a").alias("cls")).agg(F.max(F.col("key").bitwiseAND(F.lit(SHORT))).alias("short"))
    member = written(member, "jaccard-members")
    band = F.col("key").bitwiseAND(F.lit((1 << BAND_BITS + 1) - 1))
    rank = F.row_number().over(Window.partitionBy("cls", band).orderBy(F.col("m").desc(), "key"))
    for nearest in (True, False):  # the nearest pairs join most of what is similar, which leaves few of all pairs
        named = member.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", "short", F.coalesce("label", "cls").alias("label"))
        named = written(named, "jaccard-labelled")
        split = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo <> hi").select("key", "m")
        named = named.join(split, "key").withColumn("rank", rank).filter((F.col("rank") > EXTRA) | (F.col("short") != 0))
        named = written(named.select("key", "cls", "label", "m"), "jaccard-apart")
        apart = _late_pairs(named, classes, bands, chunk, nearest).distinct()
        apart = written(apart.join(pairs, ["a", "b"], "left_anti"), "jaccard-late-pairs")
        if not apart.limit(1).count():
            continue
        pairs = pairs.union(apart)
        close = _close(apart, classes, bands)
        late, _ = _links(close, _texts(close, classes, docs, id_col, text_col, n), n, bands, star)
        if late.limit(1).count():
            links = links.union(late)
            labels = components(links)

    grouped = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "rep", F.coalesce("label", "cls").alias("label"))
    grouped = written(grouped, "jaccard-grouped")
    named = written(grouped.groupBy("label").agg(F.min("rep").alias("component")), "jaccard-named")
    by_class = written(grouped.join(named, "label").select("cls", "component"), "jaccard-by-class")
    out = known.select("id", "n_shingles", "cls").join(by_class, "cls", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"), "cls")
