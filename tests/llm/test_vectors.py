import numpy as np

from heliogrid.llm import nearvec


def brute(rows, t=0.9):
    ok = {i: np.array(v, float) for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    dim = max(map(len, ok.values()))
    ok = {i: np.pad(v, (0, dim - len(v))) for i, v in ok.items()}
    links = {i: {j for j in ok if i != j and ok[i] @ ok[j] / np.sqrt(ok[i] @ ok[i]) / np.sqrt(ok[j] @ ok[j]) >= t} if i in ok else set() for i in range(len(rows))}
    out = []
    for i, (d, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        c = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((d, len(links[i]), c, d is not None and d == c))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 20))
    rows = [(k, [float(x) for x in (centres[k % 12] + 0.28 * rng.normal(size=20)).astype(np.float32)]) for k in range(160)]
    rows += [(200 + k, rows[3][1]) for k in range(5)] + [(300, None), (301, []), (302, [0.0] * 20), (303, [1.0, None] + [0.0] * 18), (304, [float("nan")] * 20), (305, [float("inf")] * 20), (None, rows[7][1]), (306, [2 * x for x in rows[7][1]]), (7, rows[7][1])]
    df = spark.createDataFrame([(d, v, 1, "x") for d, v in rows], "vec_id long, embedding array<float>, label int, h string")
    out = nearvec.near_duplicates(df, tile=32)
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


def test_blocks_and_bounds_lose_nothing(monkeypatch):
    """Whole, in small blocks, dense and sparse: the links are those of all products."""
    rng = np.random.default_rng(4)
    for spread in (0.1, 0.35, 2.0):
        x = rng.normal(size=(6, 60))[rng.integers(0, 6, 300)] + spread * rng.normal(size=(300, 60))
        axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        want = {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.9)) if i < j}
        ids = np.arange(300)
        for block in (1024, 37):
            monkeypatch.setattr(nearvec, "BLOCK", block)
            t = nearvec.prepare(x, axes, ids, ids)
            i, j = nearvec.tile_links(t, t, 0.9, True)
            assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)
            one, two = nearvec.prepare(x[:130], axes, ids[:130], ids[:130]), nearvec.prepare(x[130:], axes, ids[130:], ids[130:])
            i, j = nearvec.tile_links(one, two, 0.9, False)
            assert set(zip(i.tolist(), (j + 130).tolist())) == {(a, b) for a, b in want if a < 130 <= b}


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert nearvec.near_duplicates(df).count() == 0
    one = spark.createDataFrame([(4, None)], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in nearvec.near_duplicates(one).collect()] == [(4, 0, 4, True)]
