"""Text primitives, base quality rules and language trees against plain Python."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heliogrid.llm import langid, quality
from heliogrid.llm.textblocks import blocks, span_hashes, window_hashes, words

TEXT = st.text(alphabet="ab É\n\t,#$  \x1c", max_size=40)


def plain_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_words_and_base_features(texts):
    for b in blocks(pa.array(texts, pa.string()), chunk_bytes=30):
        w = words(b)
        h = span_hashes(b.data, w.start, w.end)
        repeat, lines = quality.repeated_words(b, w, h), quality.duplicate_lines(b)
        for i in range(b.hi - b.lo):
            t = texts[b.lo + i] or ""
            ws = plain_words(t)
            assert w.count[i] == len(ws)
            got = [b.data[s:e].tobytes().decode() for s, e in zip(w.start[w.doc == i], w.end[w.doc == i])]
            assert got == ws
            counts = Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
            cover = {k + j for k in range(len(ws) - 4) if counts[tuple(ws[k : k + 5])] > 1 for j in range(5)}
            assert repeat[i] == len(cover)
            kept = [x for x in t.split("\n") if plain_words(x)]
            assert lines[i] == len(kept) - len(set(kept))


def test_hashes_do_not_depend_on_place():
    (b,) = blocks(pa.array(["a b c d e f", "x a b c d e"]))
    w = words(b)
    h = span_hashes(b.data, w.start, w.end)
    s, at = window_hashes(h, w, 5)
    first, second = s[w.doc[at] == 0], s[w.doc[at] == 1]
    assert first[0] == second[1] and len(set(s.tolist())) == 3


def opposite(n):
    """Two texts of n letters that a polynomial hash modulo a power of two cannot tell apart."""
    one = "".join("ab"[bin(k).count("1") & 1] for k in range(n))
    return one, one.translate({97: 98, 98: 97})


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_structured_words_and_lines_are_told_apart(n):
    one, two = opposite(n)
    (b,) = blocks(pa.array([f"{one}\n{two}\n", f"{one} {two}", f"{one}\n{one}", one]))
    w = words(b)
    h = span_hashes(b.data, w.start, w.end)
    assert len(set(h.tolist())) == 2 and h[0] == h[2] == h[4] == h[6]
    assert quality.duplicate_lines(b).tolist() == [0, 0, 1, 0]


def brute_bits(train: list[bytes], text: bytes) -> float:
    """Code length of text under PPM-C of order 3, by dictionaries."""
    table = {}
    for t in train:
        for i, s in enumerate(t):
            for k in range(min(i, 3) + 1):
                table.setdefault(t[i - k : i], Counter())[s] += 1
    bits = 0.0
    seen = {x for t in train for x in t}
    for i, s in enumerate(text):
        # a context holding a byte that training never had is not in any tree
        for k in range(min(i, 3), -1, -1):
            context = table.get(text[i - k : i])
            if not context:
                continue
            n, q = sum(context.values()), len(context)
            if s in context:
                bits -= np.log2(context[s] / (n + q))
                break
            bits -= np.log2(q / (n + q))
        else:
            bits += 8
    assert seen
    return bits


@pytest.mark.parametrize("text", [b"the cat sat", b"zzz", b"thx the", b"a"])
def test_code_lengths_are_exact(text):
    train = {"en": [b"the cat sat on the mat", b"then that"], "xx": [b"zaz zbz"]}
    model = langid.build(train)
    (b,) = blocks(pa.array([text.decode()]))
    got = dict(zip(model.languages, model.code_lengths(b)[0]))
    for lang in train:
        assert got[lang] == pytest.approx(brute_bits(train[lang], text), rel=1e-5)


def test_quality_fit_separates():
    rng = np.random.default_rng(1)
    good = [" ".join(rng.choice(["the", "cat", "sat", "mat", "dog", "ran"], 30)) for _ in range(60)]
    bad = [" ".join(x + "$$$" for x in rng.choice(["the", "cat", "sat", "mat"], 30)) for _ in range(30)]
    model = quality.fit(good + bad, np.array([1] * 60 + [0] * 30))
    (b,) = blocks(pa.array([good[0] + " ran", bad[0] + " mat$$$"]))
    w = words(b)
    p = model.probability(b, w, span_hashes(b.data, w.start, w.end))
    assert p[0] > 0.9 and p[1] < 0.1
    assert quality.fit(good, np.ones(60)) is None
