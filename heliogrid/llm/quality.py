"""Quality rules: counted base rules, then a calibrated n-gram classifier.

The classifier is a logistic regression over hashed word uni- and bigrams and hashed byte
4-grams (each family as relative frequencies), trained on labelled quality rows and
calibrated by Platt's method on a held-out part of them.  Scores are computed in Arrow
batches and held against fixed thresholds.

Bound.  The model is fitted on at most ``sample_rows`` labelled documents of at most
``sample_bytes`` together, taken in the order of the hash of their id; one that does not
fit into what is left of the bytes is passed over.  Everything else covers all rows and
whole texts.  One task of an executor fits the model, and the driver gets its weights,
3 * 2**BITS numbers, whatever the input.

Defined results.  A null or wordless text has all counts 0, fails the base rules and has
probability null.  Null or clashing other columns are not read.  Repeated rows get equal
results.  If the labelled rows lack one of the two classes, no model is fitted and every
document that passes the base rules is kept, with probability null.  Labels other than 0
and 1, and those whose document is absent or has a null text, are not used and do not
count towards the bound; equal rows of one id and label are used once.  Ties in hash go
by id, label and text.  A text of any length is counted and scored whole, as one block.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textblocks import U64, Block, Words, blocks, mix, span_hashes, window_hashes, words

SAMPLE_ROWS = 3000
SAMPLE_BYTES = 12 << 20
BITS = 16
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_PROBABILITY = 0.5
_SCALE = (30.0, 30.0, 100.0)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _per_doc(b: Block, flags: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[b.ends] - total[b.starts]


def _repeats(keys: np.ndarray) -> np.ndarray:
    """For every key: 0 if it is alone, 1 if it is the first of equal ones, 2 if a later one."""
    out = np.zeros(len(keys), np.int8)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        out[order[:-1][same]] = 1
        out[order[1:][same]] = 2
    return out


def duplicate_lines(b: Block) -> np.ndarray:
    """Per document, its lines that hold a word and equal an earlier line."""
    n = len(b.starts)
    if len(b.data) == 0:
        return np.zeros(n, np.int64)
    breaks = np.flatnonzero(b.data == 10) + 1
    start = np.unique(np.concatenate([b.starts[b.ends > b.starts], breaks[breaks < len(b.data)]]))
    end = np.append(start[1:], len(b.data))
    end = end - (b.data[end - 1] == 10)
    solid = np.zeros(len(b.data) + 1, np.int64)
    np.cumsum((b.data > 0x20) | ((b.data < 0x20) & ((b.data < 9) | (b.data > 13))), out=solid[1:])
    some = solid[end] > solid[start]
    start, end = start[some], end[some]
    doc = np.searchsorted(b.starts, start, "right") - 1
    keys = mix(span_hashes(b.data, start, end) + doc.astype(U64) * U64(0xA24BAED4963EE407))
    return np.bincount(doc[_repeats(keys) == 2], minlength=n)


def repeated_words(b: Block, w: Words, h: np.ndarray, n: int = 5) -> np.ndarray:
    """Per document, its words that lie in an n-word window found twice or more in it."""
    keys, at = window_hashes(h, w, n)
    keys = mix(keys + w.doc[at].astype(U64) * U64(0xA24BAED4963EE407))
    at = at[_repeats(keys) > 0]
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + n, -1)
    return np.bincount(w.doc[np.cumsum(cover[:-1]) > 0], minlength=len(b.starts))


def _families(b: Block, w: Words, h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per family: feature indices in document order, and where each document's begin and end."""
    down = U64(64 - BITS)
    two, at = window_hashes(h, w, 2)
    ends = np.cumsum(np.maximum(w.count - 1, 0))
    out = [(h >> down, w.first, w.first + w.count), (two >> down, ends - np.maximum(w.count - 1, 0), ends)]
    d = b.data.astype(np.uint32)
    if len(d) >= 4:
        code = d[:-3] | d[1:-2] << np.uint32(8) | d[2:-1] << np.uint32(16) | d[3:] << np.uint32(24)
        code = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    else:
        code = np.zeros(0, np.uint32)
    stop = np.maximum(b.ends - 3, b.starts)
    out.append((code, b.starts, stop))
    return out


def _segment_sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of values[start:end]; each depends on its own values alone, so block cuts don't matter."""
    out = np.zeros(len(start))
    some = end > start
    if some.any():
        cuts = np.stack([start[some], end[some]], 1).ravel()
        out[some] = np.add.reduceat(np.append(values, 0.0), cuts)[::2]
    return out


@dataclass
class Model:
    """Weights by family, bias, and the calibration p = sigmoid(a * logit + c)."""

    weights: np.ndarray
    bias: float
    a: float
    c: float

    def probability(self, b: Block, w: Words, h: np.ndarray) -> np.ndarray:
        z = np.full(len(b.starts), self.bias)
        for k, (f, start, end) in enumerate(_families(b, w, h)):
            z += _SCALE[k] * _segment_sums(self.weights[k][f], start, end) / np.maximum(end - start, 1)
        return 1 / (1 + np.exp(-np.clip(self.a * z + self.c, -500, 500)))


def fit(texts: pa.Array, labels: np.ndarray, steps: int = 80, l2: float = 1e-4) -> Model | None:
    """Fit on texts with labels 0 or 1; every fifth row is held out for calibration."""
    y = np.asarray(labels, np.float64)
    if len(set(y.tolist())) < 2:
        return None
    rows, cols, values, lo = [], [], [], 0
    for b in blocks(pa.array(texts, pa.string())):
        w = words(b)
        h = span_hashes(b.data, w.start, w.end)
        for k, (f, start, end) in enumerate(_families(b, w, h)):
            n = end - start
            doc = np.repeat(np.arange(len(n)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
            key, count = np.unique(doc.astype(np.int64) << 32 | f[at].astype(np.int64), return_counts=True)
            doc = key >> 32
            rows.append((doc + lo).astype(np.int32))
            cols.append(((key & 0xFFFFFFFF) + (k << BITS)).astype(np.int32))
            values.append((_SCALE[k] * count / n[doc]).astype(np.float32))
        lo += len(b.starts)
    rows, cols, values = map(np.concatenate, (rows, cols, values))
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held[:] = False
    use = ~held[rows]
    r, c, v = rows[use], cols[use], values[use]
    n, dims = len(y), 3 << BITS
    share = y[~held].mean()
    weigh = np.where(held, 0, np.where(y == 1, 0.5 / share, 0.5 / (1 - share))) / (~held).sum()
    w, bias, speed, g2 = np.zeros(dims), 0.0, 0.0, np.full(dims, 1e-8)
    for _ in range(steps):  # AdaGrad over full batches
        z = np.bincount(r, w[c] * v, n) + bias
        d = (1 / (1 + np.exp(-z)) - y) * weigh
        g = np.bincount(c, d[r] * v, dims) + l2 * w
        g2 += g * g
        w -= 0.3 * g / np.sqrt(g2)
        speed += d.sum() ** 2
        bias -= 0.3 * d.sum() / np.sqrt(speed + 1e-8)
    z = np.bincount(rows, w[cols] * values, n) + bias
    z, t = (z[held], y[held]) if held.any() else (z, y)
    prior = ((t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
    goal = np.where(t == 1, prior[0], prior[1])
    ab = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], 1)
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -500, 500)))
        hess = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        ab -= np.linalg.solve(hess, x.T @ (p - goal) + 1e-3 * (ab - [1.0, 0.0]))
    return Model(w.reshape(3, -1).astype(np.float32), float(bias), float(ab[0]), float(ab[1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Fit a model on the labelled documents whose ids hash lowest, within both bounds.

    Ids, labels and lengths decide what is taken; only the texts taken are gathered, in the
    task that fits.
    """
    y = F.col(label_col).cast("int")
    lab = labels.filter(y.isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), y.alias("y"))
    text = docs.filter(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    sized = text.select("id", F.octet_length("t").alias("size"), F.xxhash64("t").alias("h"))
    order = [F.xxhash64("id"), "id", "y", "size", "h"]
    known = sized.join(lab, "id").filter(F.col("size") <= sample_bytes).distinct().orderBy(*order).limit(sample_rows)
    taken, left = [], sample_bytes
    for r in known.select("id", "y", "size", "h").collect():  # sample_rows rows at most, without texts
        if r["size"] <= left:
            taken.append(tuple(r))
            left -= r["size"]
    if not taken:
        return None
    kind = T.StructType([known.schema["id"], T.StructField("y", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("place", T.IntegerType())])
    picked = F.broadcast(docs.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(taken)], kind))
    found = text.withColumn("size", F.octet_length("t")).join(picked, ["id", "size"]).filter(F.xxhash64("t") == F.col("h"))
    found = found.groupBy("place").agg(F.first("y").alias("y"), F.first("t").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by("place").combine_chunks()
        model = fit(table["t"].combine_chunks(), table["y"].to_numpy())
        if model:
            yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.bias]), pa.array([model.a]), pa.array([model.c])], names=["weights", "bias", "a", "c"])

    fitted = found.coalesce(1).mapInArrow(run, "weights binary, bias double, a double, c double").collect()  # one row, or none
    return Model(np.frombuffer(fitted[0]["weights"], np.float32).reshape(3, -1), *fitted[0][1:]) if fitted else None


_OUT = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("p_quality", "double"), ("kept", "boolean")]


def judge(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """Add the counts, the base verdict, the probability and the verdict to every document.

    ``keep`` names the input columns to carry (all, if None); an input column named like a
    result is replaced.
    """
    names = [n for n, _ in _OUT]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: 3 * 2**BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for b in blocks(batch.column(len(keep))):
                w = words(b)
                h = span_hashes(b.data, w.start, w.end)
                solid = np.ones(len(b.data), bool)
                solid[(b.data == 0x20) | ((b.data >= 9) & (b.data <= 13)) | (b.data & 0xC0 == 0x80)] = False
                repeat = repeated_words(b, w, h)
                failed = (w.count < min_words) | (100 * repeat > max_repeat_percent * w.count)
                p = m.probability(b, w, h) if m else np.full(len(b.starts), np.nan)
                none = np.isnan(p) | (w.count == 0)
                kept = ~failed & (none | (p >= min_probability))
                made = [w.count, _per_doc(b, solid), _per_doc(b, _SYMBOL[b.data]), duplicate_lines(b), repeat, failed, pa.array(p, pa.float64(), mask=none), kept]
                cols = [batch.column(i).slice(b.lo, b.hi - b.lo) for i in range(len(keep))] + [x if isinstance(x, pa.Array) else pa.array(x) for x in made]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *names])

    source = docs.select(*keep, F.col(text_col).alias("__text"))
    types = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + [f"{n} {t}" for n, t in _OUT])
    return source.mapInArrow(run, types)
