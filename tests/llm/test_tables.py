"""Scoring, url rules, archives, mixing and sharding on small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliogrid.llm import langid, lm, mixing, quality, sharding, urltree, warc

DOCS = "doc_id long, text string, lang string, source string, size int, part string"


def brute_lm(rows):
    docs = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = [sum((grams(w, n) for _, w in docs), Counter()) for n in (1, 2, 3)]
    n_all = sum(len(w) for _, w in docs)
    out = []
    for d, w in docs:
        c = [lambda g, k=k, own=grams(w, k + 1): total[k][g] - own[g] for k in range(3)]
        s, use, n = 0.0, [0, 0, 0], n_all - len(w)
        for i, x in enumerate(w):
            if i > 1 and c[2](tuple(w[i - 2 : i + 1])) > 0:
                s += math.log(c[2](tuple(w[i - 2 : i + 1])) / c[1](tuple(w[i - 2 : i])))
                use[0] += 1
            elif i and c[1](tuple(w[i - 1 : i + 1])) > 0:
                s += math.log(0.4 * c[1](tuple(w[i - 1 : i + 1])) / c[0]((w[i - 1],)))
                use[1] += 1
            elif c[0]((x,)) > 0:
                s += math.log(0.16 * c[0]((x,)) / n)
                use[2] += 1
            else:
                s += math.log(0.16 / (n + 1))
        out.append((d, len(w), round(s, 6), *use))
    return sorted(out, key=str)


def test_lm_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(k, " ".join(rng.choice(["a", "b", "c", "d", "e"], int(n)))) for k, n in enumerate(rng.integers(0, 40, 60))]
    rows += [(100, None), (101, " "), (None, "a b c"), (5, rows[5][1]), (102, "zz yy")]
    df = spark.createDataFrame([(d, t, "en", "s", 1, "x") for d, t in rows], DOCS)
    got = lm.score(df, batch_bytes=200, part_grams=50).collect()
    assert sorted(((r[0], r[1], round(r[2], 6), *r[3:]) for r in got), key=str) == brute_lm(rows)
    assert lm.score(df.limit(0)).count() == 0


def test_url_rules_and_templates(spark):
    urls = ["http://Example.COM/en/1", "https://www.example.com/en/x?y=/", "http://b.net/es/7", "http://b.net/fr/7", "http://b.net/de/7", "ftp://a.org/es/1", "http://com", "nothing", None, "http://xcom/en/", "http://a.net/es", "http://h#frag/x", "http://a.org/" + "a/" * 40]
    df = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)], "page_id long, url string, host string, depth string")
    got = {r.page_id: r for r in urltree.judge(df).collect()}
    rules = [got[k].rule for k in range(len(urls))]
    assert rules == ["example.com/en/", "www.example.com/en/", "net/es/", "net/fr/", None, None, None, None, None, None, None, None, None]
    assert [got[k].verdict for k in range(4)] == ["block", "allow", "block", "block"]
    assert (got[0].host, got[0].path, got[7].host, got[8].path, got[11].host) == ("example.com", "/en/1", "", "", "h")
    assert all(r.verdict in ("allow", "block") for r in got.values())
    assert urltree.judge(df.limit(0)).count() == 0


def test_url_tree_learns_from_rules(spark):
    rows = [(k, f"http://s{k % 5}.net/{lang}/{k}") for k, lang in enumerate(["es", "fr"] * 60)] + [(k + 500, f"http://s{k % 5}.com/en/{k}") for k in range(120)] + [(900 + k, f"http://new.org/{p}/{k}") for k, p in enumerate(["es", "en"] * 30)]
    out = urltree.judge(spark.createDataFrame(rows, "page_id long, url string")).filter("page_id >= 900").toPandas()
    assert set(out[out.path.str.startswith("/es")].verdict) == {"block"} and set(out[out.path.str.startswith("/en")].verdict) == {"allow"}


def test_archives_round_trip(spark):
    big, other = "é" * 700, "b" * 999
    rows = [(1, "http://a/ b", big), (2, "http://b", big), (3, None, big), (4, "http://c", other), (5, "http://d", other), (6, "u", None), (7, "u", ""), (None, "n", big), (3, "again", big), (8, "x\n y", "c" * 5000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(2)
    out = warc.read_warc(warc.convert(warc.write_arc(df)))
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect()), key=str)
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        want.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if h == big and p != 3 else "response", 3 if h == big and p != 3 else None))
    threes = [w for w in want if w[0] == 3]
    want = [w for w in want if w[0] != 3] + [threes[0], (*threes[0][:3], "revisit", 3)]
    assert got == sorted(want, key=str)
    assert out.select("record_id").distinct().count() == len(rows)
    empty = warc.convert(warc.write_arc(df.limit(0)))
    assert warc.read_warc(empty).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    block = b"HTTP/1.1 200 OK\r\n\r\nbody\nwith lines"
    opening = warc.arc_version_block("n.arc.gz", version, "20240102030405")
    fields = opening.split(b"\n")[2].decode().split(" ")
    header, got = warc.parse_arc(warc.arc_record("http://x/a b", "20240102030405", "text/html", block, version, 9, "n"), fields)
    assert got == block and header["URL"] == "http://x/a%20b" and int(header["Archive-length"]) == len(block)
    assert warc.iso_date("20240102030405") == "2024-01-02T03:04:05Z"
    with pytest.raises(ValueError):
        warc.parse_arc(b"http://x 0.0.0.0 2024 text/html 99\nshort", fields if version == 1 else warc.ARC_FIELDS[1].split(" "))


def test_mixing(spark):
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(["w"] * int(n)), "en", s, 9, "x") for k, (n, s) in enumerate(zip(rng.integers(0, 30, 300), rng.choice(["a", "b", "c", "d"], 300, p=[0.1, 0.5, 0.3, 0.1])))]
    rows += [(400, None, None, None, 1, "x"), (401, "q r", None, None, 1, "x"), (7, rows[7][1], "en", "b", 1, "x"), (None, "z", "en", "b", 1, "x")]
    out = mixing.mix(spark.createDataFrame(rows, DOCS)).toPandas()
    assert len(out) == len(rows) and {"size", "part"} <= set(out.columns)
    out["taken"] = out.mix_size * out.mix_positions.map(len)
    sizes = out.groupby(out.source.fillna("~")).agg(size=("mix_size", "sum"), target=("mix_target", "first"), taken=("taken", "sum"))
    target, open_, weights, budget = {}, sorted(sizes.index), dict(zip(sorted(sizes.index), [5, 2, 1, 5, 2])), 1.5 * out.mix_size.sum()
    while open_:
        left, w = budget - sum(target.values()), sum(weights[s] for s in open_)
        full = [s for s in open_ if left * weights[s] / w > 2 * sizes["size"][s]]
        target |= {s: 2.0 * sizes["size"][s] for s in full} if full else {s: left * weights[s] / w for s in open_}
        open_ = [s for s in open_ if s not in full] if full else []
    for s, r in sizes.iterrows():
        assert r.target == pytest.approx(target[s]) and abs(r.taken - r.target) <= 30
    assert all(list(p) == sorted(p) and all(0 <= x <= 1 for x in p) for p in out.mix_positions)
    again = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(7)).toPandas()
    key = lambda d: sorted(zip(d.doc_id.fillna(-1), d.mix_size, d.mix_positions.map(tuple)))
    assert key(out) == key(again)
    ordered = mixing.training_order(mixing.mix(spark.createDataFrame(rows, DOCS))).select("mix_position").toPandas().mix_position
    assert ordered.is_monotonic_increasing
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_mixing_rows_come_from_the_training_order(spark, tmp_path, monkeypatch):
    from heliogrid.llm import queries

    rng = np.random.default_rng(6)
    rows = [(k // 2, "w " * int(n), "en", s, 9, "x") for k, (n, s) in enumerate(zip(rng.integers(0, 30, 300), rng.choice(["a", "b", "c"], 300, p=[0.4, 0.2, 0.4])))]
    rows += [(None, "z z", "en", "b", 1, "x"), (None, "z z", "en", "b", 1, "x"), (None, "z", "en", None, 1, "x"), (9, None, None, "d", 1, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    mixed = mixing.mix(docs)
    order = mixing.ranked(mixing.training_order(mixed, ["mix_row"], absent=True)).toPandas().sort_values("mix_rank")
    taken = order[order.mix_rank.notna()]
    assert taken.mix_rank.astype(int).tolist() == list(range(len(taken))) and taken.mix_position.is_monotonic_increasing
    assert len(order) > len(taken) and order.mix_row.map(str).nunique() == len(rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen, real = [], mixing.training_order
    monkeypatch.setattr(mixing, "training_order", lambda *a, **b: seen.append(1) or real(*a, **b))
    out = queries.op8_mixing(spark, str(tmp_path)).toPandas()
    assert seen
    want = [(r.doc_id, r.mix_size, r.mix_size * len(r.mix_positions), round(r.mix_positions[0], 6) if r.mix_positions else None) for r in mixed.collect()]
    got = [(None if d != d else int(d), n, t, None if p != p else p) for d, n, t, p in zip(out.doc_id, out["size"], out.taken, out.position)]
    assert sorted(want, key=str) == sorted(got, key=str)
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(str(empty / "documents.parquet"))
    assert queries.op8_mixing(spark, str(empty)).count() == 0


def test_sharding(spark):
    rng = np.random.default_rng(2)
    rows = [(k, "t" * int(n) + str(k)) for k, n in enumerate(rng.integers(1, 400, 3000))] + [(5000 + k, "copy " * 20) for k in range(100)] + [(6000, None), (6001, ""), (None, "x"), (6002, "x"), (6002, "x")]
    df = spark.createDataFrame([(d, t, "en", "s", 1, "x") for d, t in rows], DOCS)
    out = sharding.shard(df, 8).toPandas()
    assert len(out) == len(rows)
    by = out.groupby("shard").agg(size=("size", "sum"), n=("slot", "count"), top=("slot", "max"), kinds=("slot", "nunique"))
    assert (by.top == by.n - 1).all() and (by.kinds == by.n).all() and len(by) == 8
    assert by["size"].max() - by["size"].min() < 0.02 * by["size"].mean()
    assert out[out.doc_id.between(5000, 5099)].shard.nunique() == 1
    text = dict(rows)
    for r in out.dropna(subset="doc_id").sample(50, random_state=1).itertuples():
        data = (text[int(r.doc_id)] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    hot = spark.createDataFrame([(k, "same text " * 30) for k in range(900)] + [(k, f"own {k}") for k in range(900, 1800)], "doc_id long, text string")
    sizes = sharding.shard(hot, 8).groupBy("shard").agg(F.sum("size").alias("s")).toPandas().s
    assert len(sizes) == 8 and sizes.max() < 1.3 * sizes.mean()
    assert sharding.shard(df.limit(0)).count() == 0


def test_quality_and_language_rows(spark):
    good, bad = "the cat sat on the mat and then it ran off to the old barn", "x$$$ y*** z%%% q&&& r### s$$$ t*** u%%% v&&& w### k$$$ l***"
    rows = [(k, f"{good} {k}", "en", "s", 1, "x") for k in range(60)] + [(100 + k, f"{bad} {k}", "de" if k % 2 else None, "s", 1, "x") for k in range(40)]
    rows += [(300, None, None, None, None, None), (301, "", "en", "s", 1, "x"), (302, "123 !!", "en", "s", 1, "x"), (None, good, "en", "s", 1, "x"), (0, rows[0][1], "en", "s", 1, "x")]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, 1) for k in range(60)] + [(100 + k, 0) for k in range(40)] + [(None, 1), (9999, 0)], "doc_id long, quality int")
    out = quality.judge(df, quality.train(df, labels), keep=["doc_id", "kept_not"] if False else ["doc_id"]).toPandas()
    assert len(out) == len(rows)
    assert out[out.doc_id < 60].kept.all() and not out[out.doc_id.between(100, 139)].kept.any()
    assert not out[out.doc_id.isin([300, 301, 302])].kept.any() and out[out.doc_id == 300].p_quality.isna().all()
    no_model = quality.judge(df, quality.train(df, labels.filter("quality = 1")), keep=["doc_id"]).toPandas()
    assert no_model[no_model.doc_id < 140].kept.all()
    assert quality.judge(df.limit(0), None).count() == 0

    found = langid.identify(df, langid.train(df, F.lit(True)), keep=["doc_id"]).toPandas()
    assert set(found[found.doc_id < 60].lang_pred) == {"en"} and set(found[found.doc_id.between(100, 139)].lang_pred) == {"de"}
    assert set(found[found.doc_id.isin([300, 301, 302])].lang_pred) == {"und"} and found.score.between(0, 1).all()
    assert set(langid.identify(df, langid.train(df, F.lit(False)), keep=["doc_id"]).toPandas().lang_pred) == {"und"}


def test_more_languages_than_a_group(spark):
    rng = np.random.default_rng(12)
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)]
    words_of = [["".join(rng.choice(letters, 5)) for _ in range(12)] for _ in range(70)]
    rows = [(k * 10 + j, " ".join(rng.choice(w, 15)), f"l{k:02}", "s", 1, "p") for k, w in enumerate(words_of) for j in range(4 if k == 41 else 6)]
    rows += [(7, "\u0436 only", None, "s", 1, "p"), (None, "", "l00", "s", 1, "p")]
    df = spark.createDataFrame(rows, DOCS)
    found = langid.identify(df, langid.train(df, F.lit(True)), keep=["doc_id", "lang"]).toPandas()
    assert (found.lang_pred == found.lang)[:-2].all() and found.lang_pred[: -2].nunique() == 70 and found.lang_pred.iloc[-1] == "und"
    whole = langid.identify(df, langid.train(df, F.lit(True), group=100), keep=["doc_id", "lang"]).toPandas()
    assert whole.lang_pred.tolist() == found.lang_pred.tolist()
    assert np.allclose(whole.score, found.score, rtol=1e-6) and np.allclose(whole.bits_per_byte, found.bits_per_byte)
    same = spark.createDataFrame([(5, f"{w} {w}", lang, "s", 1, "p") for lang, w in (("x", "abc"), ("y", "def")) for _ in range(1000)], DOCS)
    assert {lang for g in langid.train(same, F.lit(True)).groups for lang, _, _ in g} == set(langid.train(same, F.lit(True)).model(0).languages)


def test_pipeline_on_a_small_table(spark, tmp_path):
    import corpus_pipeline as cp

    rng = np.random.default_rng(9)
    word = ["the", "cat", "sat", "on", "mat", "dog", "ran", "off", "to", "barn", "old", "and", "house", "green", "by", "river"]
    rows = [(k, " ".join(rng.choice(word, 60)) + ".", "en", f"s{k % 3}", 1) for k in range(80)]
    rows += [(200 + k, rows[k][1] + " extra", "en", "s0", 1) for k in range(10)] + [(300 + k, " ".join(x + "$$$" for x in rng.choice(word, 40)), "en", "s1", 1) for k in range(30)]
    rows += [(400, None, None, None, None), (401, "short", "en", "s0", 1), (5, rows[5][1], "en", "s2", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(80)] + [(300 + k, 0, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = cp.documents(spark, str(tmp_path))
    kept = cp.STAGES[0][1](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*range(80), *range(200, 210)}
    spoken = cp.STAGES[1][1](spark, kept, str(tmp_path))
    assert spoken.count() == kept.count()
    single = cp.STAGES[2][1](spark, spoken, str(tmp_path))
    assert sorted(r.doc_id for r in single.collect()) == list(range(80))
    mixed = cp.STAGES[3][1](spark, single, str(tmp_path))
    assert mixed.columns == docs.columns
    out = cp.run(spark, str(tmp_path)).toPandas()
    assert out.groupby("sequence_id").length.sum().max() <= 1024
    assert len(out) == mixed.count()


def test_one_row_of_each_group_stays(spark):
    """Rows of one id, without an id, and equal rows; extra columns named like those of the operators."""
    import corpus_pipeline as cp

    a, z, k = ([f"{x}{i}" for i in range(40)] for x in "azk")
    text = lambda *w: " ".join(w)
    rows = [(3, text(*a)), (5, text(*a, "more")), (5, text(*z)), (8, text(*k)), (8, text(*k, "more")), (None, text(*z, "more")), (9, None), (9, None), (10, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id long")
    out = cp.ngram_jaccard(spark, docs, "")
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(d for d, _ in got) == [3, 5, 8, 9, 10] and (3, text(*a)) in got and (5, text(*z)) in got
    assert cp.ngram_jaccard(spark, docs.limit(0), "").count() == 0
