import re

import numpy as np

from heliogrid.llm import jaccard
from heliogrid.llm.components import components
from heliogrid.llm.parity import EXTRA, SHORT, Bands, keys, sketches

SCHEMA = "doc_id long, text string, lang string, key long, cls string, label string"


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                group[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted((d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(rows))


def corpus():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(60)]
    passage = list(rng.choice(vocabulary, 40))
    rows, n = [], 0
    for size in (3, 5, 9, 30, 80, 200):
        base = list(rng.choice(vocabulary, size))
        for edits in (0, 0, 1, 1, 2, 4, 8):
            text = base.copy()
            for _ in range(min(edits, size // 12)):
                text[rng.integers(len(text))] = f"e{rng.integers(9999)}"
            rows.append((n, " ".join(text)))
            n += 1
    for _ in range(25):  # a passage that many documents share
        rows.append((n, " ".join([*rng.choice(vocabulary, 25), *passage])))
        n += 1
    near = list(rng.choice(vocabulary, 60))
    for k in range(20):  # a long run of near copies
        text = near.copy()
        text[(3 * k) % 60] = f"x{k}"
        rows.append((n, " ".join(text)))
        n += 1
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one TWO"), (905, "É é"), (906, "é é")]


def test_components_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "en", 1, "x", "y") for d, t in rows], SCHEMA).repartition(3)
    for few, chunk, star in ((3, 2048, 64), (2, 5, 2)):
        out = jaccard.jaccard_components(df, few=few, chunk=chunk, star=star)
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in out.collect())
        assert got == brute(rows)


def test_repeated_null_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t u"), (3, None)], "doc_id long, text string")
    got = sorted(jaccard.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect(), key=str)
    assert [tuple(r) for r in got] == [(1, 2, 1), (1, 2, 1), (3, 0, 3), (None, 1, None), (None, 2, 1)]
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_rows_of_one_id_and_structured_words(spark):
    base = [f"w{k}" for k in range(60)]
    one = "".join("ab"[bin(k).count("1") & 1] for k in range(1024))
    rows = [(k % 3 if k % 2 else None, " ".join([*base[: 20 + k], f"x{k}"])) for k in range(30)]
    rows += [(70, f"{one} b c d e"), (71, one.translate({97: 98, 98: 97}) + " b c d e"), (7, "word " * 300_000), (8, "Word " * 300_001)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, few=2, chunk=5, star=3).collect()), key=str)
    want = brute([(d if d is not None else 1 << 40, t) for d, t in rows])
    unnamed = lambda x: None if x == 1 << 40 else x
    assert got == sorted(((unnamed(d), n, unnamed(c)) for d, n, c in want), key=str)


def test_no_similar_pair_lacks_a_key():
    rng = np.random.default_rng(2)
    bands = Bands(growth=1.5)
    for _ in range(300):
        n = int(rng.integers(4, 300))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        lost = int(rng.integers(0, n * 2 // 9 + 1))
        b = np.concatenate([a[lost:], rng.integers(0, 2**63, int(rng.integers(0, lost + 1)), dtype=np.uint64)])
        common, union = n - lost, len(b) + lost
        if 100 * common < 80 * union or (lost == 0 and len(b) == n):
            continue
        doc = np.repeat([0, 1], [n, len(b)])
        k, owner = keys(np.concatenate([a, b]), doc, np.array([n, len(b)]), bands)
        short = [bool((k[owner == i] & np.uint64(SHORT)).any()) for i in (0, 1)]
        common_keys = set((k[owner == 0] >> np.uint64(1)).tolist()) & set((k[owner == 1] >> np.uint64(1)).tolist())
        assert len(common_keys) >= (1 if all(short) else EXTRA + 1)
        s = sketches(np.concatenate([a, b]), doc, 2)
        assert int(np.bitwise_count(s[0] ^ s[1]).sum()) <= lost + len(b) - common


def test_component_labels(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (8, 9), (7, 7), (None, 1)], "a long, b long")
    assert sorted(map(tuple, components(links).collect())) == [(2, 2), (3, 2), (4, 2), (5, 2), (8, 8), (9, 8)]
