"""Language identification by prediction by partial matching.

Per language, a tree of byte contexts of up to MAX_ORDER bytes holds symbol counts.  A
symbol's code length is that of PPM with escape method C and frozen statistics: from the
longest context known to the language downwards, -log2(count / (total + distinct)) if the
symbol was seen there, else an escape, -log2(distinct / (total + distinct)), and the next
shorter context; below order 0 all bytes cost 8 bits.  The language with the shortest
code for the whole text wins.

For scoring, the exact code lengths of every (context, symbol) are tabulated once for up to
``GROUP`` languages together, so a byte costs two look-ups a group.

Bound.  Trees are trained on about ``sample_docs`` documents a language, those with ids of
lowest hash, at most ``sample_bytes`` of text each language; the document that crosses that
bound is the last, and of it the first ``sample_bytes`` characters are learnt.  Every language of the training
rows is trained and every text is scored whole: more than ``GROUP`` languages are trained
and scored in passes over the texts at hand, each of which holds one group's tables and
carries the best so far.

Letters are compared without case: A-Z, and capitals of Latin-1 as coded in UTF-8.

Defined results.  A null text, or one without a letter, is ``und`` with score 0; so is
every text if there is nothing to learn from.  Ties go to the language that sorts first.
Null ids and languages are not learnt from.  A text of any length is scored whole, as one
block.  Repeated rows get equal results.  An empty
table gives an empty result.  An input column named like a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textblocks import LOWER, Block, blocks

MAX_ORDER = 3
SAMPLE_DOCS = 300
SAMPLE_BYTES = 1_000_000
#: Languages that are tabulated together, and bytes of text that are scored by one group before the next.
GROUP = 4
HOLD_BYTES = 32 << 20
UNKNOWN = "und"


def fold(data: np.ndarray) -> np.ndarray:
    """Bytes with capitals made small: ASCII, and the second byte of C3 80 to C3 9E."""
    out = LOWER[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    out[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
    return out


@dataclass
class Model:
    """Tabulated code lengths.

    symbol: class of each byte, 0 for bytes never seen in training.
    state: by the classes of the last MAX_ORDER bytes, the longest context that any language knows.
    bits: by state * classes + class, the code length in each language.
    """

    languages: list[str]
    symbol: np.ndarray
    state: np.ndarray
    bits: np.ndarray

    @property
    def classes(self) -> int:
        return int(self.symbol.max()) + 1

    def code_lengths(self, b: Block) -> np.ndarray:
        """Bits of every document of a block in every language."""
        out = np.zeros((len(b.starts), len(self.languages)))
        some = b.ends > b.starts
        if not some.any():
            return out
        c = self.symbol[fold(b.data)].astype(np.int64)
        k = self.classes
        context = np.zeros(len(c), np.int64)
        for back in range(MAX_ORDER, 0, -1):
            context *= k
            context[back:] += c[:-back]
        for i in range(MAX_ORDER):  # a text's first bytes have the context of those before them in it
            at = b.starts + i
            context[at[at < b.ends]] %= k**i
        state = self.state[context]
        lengths = self.bits[state * k + c]
        for j in range(len(self.languages)):
            out[some, j] = np.add.reduceat(lengths[:, j].astype(np.float64), b.starts[some])
        return out


def build(texts: dict[str, list[bytes]]) -> Model | None:
    """Count contexts per language and tabulate the code lengths."""
    languages = sorted(texts)
    if not languages:
        return None
    joined = {}
    for lang in languages:
        data = [fold(np.frombuffer(t, np.uint8)) for t in texts[lang] if t]
        joined[lang] = (np.concatenate(data) if data else np.zeros(0, np.uint8), [len(x) for x in data])
    seen = np.unique(np.concatenate([x for x, _ in joined.values()]))
    symbol = np.zeros(256, np.int16)
    symbol[seen] = np.arange(1, len(seen) + 1)
    k, n_lang = len(seen) + 1, len(languages)
    counts = []  # by language and order: codes of (context, symbol) and their counts
    for lang in languages:
        data, lengths = joined[lang]
        c = symbol[data].astype(np.int64)
        starts = np.cumsum([0, *lengths[:-1]]) if lengths else np.zeros(0, np.int64)
        place = np.arange(len(c)) - np.repeat(starts, lengths)
        per_order = []
        for order in range(MAX_ORDER + 1):
            code = np.zeros(len(c), np.int64)
            for back in range(order, -1, -1):
                code *= k
                code[back:] += c[: len(c) - back]
            per_order.append(np.unique(code[place >= order], return_counts=True))
        counts.append(per_order)
    states = [np.zeros(1, np.int64)]  # by order: the contexts some language knows, as sorted codes
    for order in range(1, MAX_ORDER + 1):
        states.append(np.unique(np.concatenate([p[order][0] // k for p in counts])))
    first = np.cumsum([0, *map(len, states)])
    bits = np.empty((first[-1], k, n_lang), np.float32)
    for j, per_order in enumerate(counts):
        lower = np.full((1, k), 8.0)
        for order in range(MAX_ORDER + 1):
            contexts = states[order]
            if order:  # the context without its oldest byte
                lower = lower[np.searchsorted(states[order - 1], contexts % k ** (order - 1))]
            code, n = per_order[order]
            at = np.searchsorted(contexts, code // k)
            total = np.bincount(at, n, len(contexts))
            distinct = np.bincount(at, minlength=len(contexts))
            known = total > 0
            escape = np.where(known, -np.log2(np.where(known, distinct, 1) / np.where(known, total + distinct, 1)), 0.0)
            now = lower + escape[:, None]
            now[at, code % k] = -np.log2(n / (total + distinct)[at])
            bits[first[order] : first[order + 1], :, j] = now
            lower = now
    state = np.zeros(1, np.int32)
    for order in range(1, MAX_ORDER + 1):  # oldest byte first, so longer contexts repeat the shorter table
        state = np.tile(state, k)
        state[states[order]] = first[order] + np.arange(len(states[order]))
    return Model(languages, symbol, state, bits.reshape(-1, n_lang))


@dataclass
class Trained:
    """The languages of the training rows in groups, in order of name.

    groups: (lang, rows, lowest h) of each language; usable: the training rows, as h, lang and t.
    """

    groups: list[list[tuple[str, int, float]]]
    usable: DataFrame
    sample_docs: int
    sample_bytes: int

    def model(self, group: int) -> Model:
        """Sample one group's languages and tabulate them."""
        # Documents whose hash lies in the lowest sample_docs / n of all hashes: a bounded sample without a sort.
        h, lang, wanted = F.col("h"), F.col("lang"), self.groups[group]
        part = F.coalesce(*[F.when(lang == name, (h < self.sample_docs / n) | (h == low)) for name, n, low in wanted])
        rows = self.usable.filter(part).withColumn("size", F.octet_length("t"))
        by_hash = Window.partitionBy("lang").orderBy("h", "size", F.xxhash64("t"))
        before = by_hash.rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("k", F.row_number().over(by_hash)).withColumn("used", F.coalesce(F.sum("size").over(before), F.lit(0)))
        rows = rows.filter((F.col("k") <= 2 * self.sample_docs) & (F.col("used") < self.sample_bytes))
        rows = rows.select("lang", F.encode(F.substring("t", 1, self.sample_bytes), "UTF-8").alias("t"), "h", "size").orderBy("h", "lang", "size", F.xxhash64("t"))
        texts: dict[str, list[bytes]] = {name: [] for name, _, _ in wanted}
        for r in rows.collect():  # per language less than sample_bytes and one text of sample_bytes characters
            texts[r["lang"]].append(bytes(r["t"]))
        return build(texts)


def train(docs: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, group: int = GROUP) -> Trained | None:
    """Train on the rows that ``allowed`` admits, of known id, text and language."""
    usable = docs.filter(allowed & F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    place = F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 1) / float(1 << 63)
    usable = usable.select(place.alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("t"))
    found = sorted(tuple(r) for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("low")).collect())
    if not found:
        return None
    return Trained([found[i : i + group] for i in range(0, len(found), group)], usable, sample_docs, sample_bytes)


_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True


def _letters(b: Block) -> np.ndarray:
    """Per document: does it hold a letter?"""
    total = np.zeros(len(b.data) + 1, np.int64)
    np.cumsum(_ALPHA[b.data], out=total[1:])
    out = total[b.ends] > total[b.starts]
    for i in np.flatnonzero(~out & (b.ends > b.starts)):
        text = b.data[b.starts[i] : b.ends[i]].tobytes().decode("utf-8", "replace")
        out[i] = any(ch.isalpha() for ch in text)
    return out


def _held(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists that end as soon as they hold ``size`` bytes."""
    some, used = [], 0
    for batch in batches:
        some.append(batch)
        used += batch.nbytes
        if used >= size:
            yield some
            some, used = [], 0
    if some:
        yield some


def _better(best: tuple | None, bits: np.ndarray, first: int, scale: np.ndarray) -> tuple:
    """(winner, its bits, sum of 2**-scaled bits relative to the winner's) with one more group, whose languages count from ``first``."""
    win = bits.argmin(axis=1)
    low = bits[np.arange(len(bits)), win]
    total = np.exp2(-(bits - low[:, None]) * scale[:, None]).sum(axis=1)
    if best is None:
        return win + first, low, total
    was, was_low, was_total = best
    least = np.minimum(low, was_low)
    total = was_total * np.exp2(-(was_low - least) * scale) + total * np.exp2(-(low - least) * scale)
    return np.where(low < was_low, win + first, was), least, total


def identify(docs: DataFrame, trained: Trained | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred, score (0 to 1) and bits_per_byte (of the winner) to every document.

    The score is the winner's share of 2**-bits, with the bits of long texts scaled down to
    those of a text of 64 bytes.
    """
    names = ["lang_pred", "score", "bits_per_byte"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    groups = trained.groups if trained else []
    languages = [name for g in groups for name, _, _ in g]
    shared = [docs.sparkSession.sparkContext.broadcast(trained.model(i)) for i in range(len(groups))]  # each bounded by the sample
    firsts = np.cumsum([0, *map(len, groups)]).tolist()
    hold = HOLD_BYTES if len(shared) > 1 else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.array([*languages, UNKNOWN], object)
        for held in _held(batches, hold):
            cut = [(batch, b) for batch in held for b in blocks(batch.column(len(keep)))]
            found: list[tuple | None] = [None] * len(cut)
            for first, one in zip(firsts, shared):
                m = one.value
                for i, (_, b) in enumerate(cut):
                    found[i] = _better(found[i], m.code_lengths(b), first, np.minimum(1, 64 / np.maximum(b.ends - b.starts, 1)))
                if len(shared) > 1:  # a worker holds the tables of one group at a time
                    del m
                    vars(one).pop("_value", None)
            for (batch, b), best_of in zip(cut, found):
                n = len(b.starts)
                best, score, rate = np.full(n, len(labels) - 1), np.zeros(n), np.zeros(n)
                if best_of:
                    win, low, total = best_of
                    ok = _letters(b)
                    best[ok], score[ok], rate[ok] = win[ok], (1 / total)[ok], (low / np.maximum(b.ends - b.starts, 1))[ok]
                cols = [batch.column(i).slice(b.lo, b.hi - b.lo) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(labels[best], pa.string()), pa.array(score), pa.array(rate)], names=[*keep, *names])

    source = docs.select(*keep, F.col(text_col).alias("__text"))
    types = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + ["lang_pred string", "score double", "bits_per_byte double"])
    return source.mapInArrow(run, types)
