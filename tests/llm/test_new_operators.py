"""Nearest neighbours, source divergence and filter interactions against brute force, with odd rows."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.llm import ann, audit, common, divergence, entry, hnsw

BIG = "sf0.01"


def brute_nearest(rows, ask, k):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    asks = {}
    for i, v in fine:
        if ask(i) and (i not in asks or list(v) < list(asks[i])):
            asks[i] = v
    out = {}
    for q, v in asks.items():
        near = sorted((-float(v @ w), i) for i, w in fine if i != q and len(w) == len(v))[:k]
        out |= {(q, n): (i, -s) for n, (s, i) in enumerate(near, 1)}
    return out


def test_nearest_neighbours_odd_rows(spark):
    common.tune(spark)
    r = np.random.default_rng(0)
    rows = [(i, (r.normal(size=6) * (1 + i % 4)).tolist()) for i in range(200)]
    rows += [(1000 + i, [0.5] * 6) for i in range(60)] + [(1000, [0.5] * 6)] * 30  # copies, and rows that repeat an id
    rows += [(40, [-9.0] * 6), (2000, None), (2020, [float("nan")] * 6), (2040, [0.0] * 6), (2060, []), (2080, [None] * 6), (None, [1.0] * 6), (2100, [1.0, 2.0]), (2120, [2.0, 1.0]), (2140, [1e150] * 6), (2141, [1e-150] * 6), (2160, [float("inf")] * 6), (2180, [3.0] * 3)]
    v = spark.createDataFrame([(i, x, 1, "v") for i, x in rows], "vec_id long, embedding array<double>, node long, v string").repartition(4)
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in ann.nearest(v, F.col("vec_id") % 20 == 0, 20).collect()}
    want = brute_nearest(rows, lambda i: i % 20 == 0, 20)
    assert set(got) == set(want)
    for key in want:
        assert got[key][1] == pytest.approx(want[key][1], rel=1e-12)
    exact = np.mean([got[key][0] == want[key][0] for key in want])
    assert exact > 0.99 and (2180, 1) not in got
    assert ann.nearest(v.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(v.where("vec_id = 3"), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_neighbours_recall_over_shards(spark, monkeypatch):
    """Given vectors in five shards: recall against brute force, scores exact."""
    monkeypatch.setattr(ann, "SHARD", 400)
    monkeypatch.setattr(ann, "BLOCK", 30)
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in e.select("vec_id", "embedding").collect()]
    got = {}
    for x in ann.nearest(common.tune(spark) and e, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(x["query_id"], {})[x["rank"]] = (x["vec_id"], x["score"])
    v = np.array([x for _, x in rows], float)
    ids = np.array([i for i, _ in rows])
    hits = 0
    for q, found in got.items():
        s = v @ v[ids == q][0]
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))][:20]
        hits += len({i for i, _ in found.values()} & set(best.tolist()))
        assert sorted(found) == list(range(1, 21)) and all(abs(s[ids == i][0] - x) < 1e-12 for i, x in found.values())
    assert len(got) == sum(ids % 20 == 0) and hits / (20 * len(got)) >= 0.97


@pytest.mark.parametrize("n", [1, 2, 3, 300, 3000])
def test_graph_reaches_every_node(n):
    r = np.random.default_rng(n)
    v = r.normal(size=(n, 8))
    v[n // 2 :] = v[0] + r.normal(size=(n - n // 2, 8)) * 1e-3  # half of them in one heap
    order, sizes = hnsw.order_and_sizes(np.arange(n))
    x = hnsw.lifted(v[order])
    links = hnsw.build(x, sizes)
    assert [len(a) for a in links] == sizes and sizes[0] == n and all((a < len(a)).all() for a in links)
    ids, sims = hnsw.search(x, links, hnsw.asking(v[:50]), 100)
    want = np.sort(hnsw.asking(v[:50]) @ x.T, axis=1)[:, ::-1][:, : min(n, 10)]
    got = np.sort(sims, axis=1)[:, ::-1][:, : min(n, 10)]
    assert np.mean(np.abs(got - want) < 1e-5) > 0.95


def brute_divergence(rows, top):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))) for lang, source, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = [t for t in df if df[t] >= 3]
        n = {s: Counter() for s in {d[1] for d in docs if d[0] == lang}}
        for d in docs:
            if d[0] == lang:
                n[d[1]].update(t for t in d[2] if df[t] >= 3)
        whole = Counter()
        for c in n.values():
            whole.update(c)
        p = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        for s, c in n.items():
            pair = [(-sum((p(c, t) - p(o, t)) ** 2 // p(o, t) for t in kept), x.encode(), x) for x, o in n.items() if x != s]
            term = [(-((p(c, t) - p(whole, t)) ** 2 // p(whole, t)), t.encode(), t) for t in kept if c[t] > 0 and p(c, t) > p(whole, t)]
            for part, got in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, item, -v, rank) for rank, (v, _, item) in enumerate(got, 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_divergence(spark, monkeypatch, small):
    if small:  # many chunks, spans and blocks
        for name, v in (("CHUNK", 20), ("SPAN", 2), ("BLOCK", 2), ("HELD", 3)):
            monkeypatch.setattr(divergence, name, v)
    r = random.Random(3)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Ünï", "ünï", "ÉTÉ", "日本", "a b"]
    rows = [(r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", "s4", "", None, "é"]), "-".join(r.choices(vocabulary, k=r.randint(0, 40)))) for _ in range(120)]
    rows += [("en", "none", None), ("xx", "a", "only once"), ("xx", "b", ""), ("yy", "alone", "tick tick"), ("en", "s1", "Long " * 3000 + "z" * 9000)]
    rows += [("en", "s1", "same same text")] * 4
    docs = spark.createDataFrame([(*x, "t", 1) for x in rows], "lang string, source string, text string, term string, n int").repartition(5)
    common.tune(spark)
    got = sorted(tuple(x) for x in divergence.divergence(docs, 7).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute_divergence(rows, 7)
    assert divergence.divergence(docs.where("false")).count() == 0


def test_terms_of_long_texts_and_large_counts():
    text = ("Ab é1c" * 40 + "q" * 30).encode()
    assert divergence.terms(text, 7) == divergence.terms(text) == Counter(re.findall(rb"[a-z\x80-\xff]+", text.lower()))
    big = np.array([0, 9_300_000_000, 4 * 10**18])
    assert divergence.shares(big, 5 * 10**18).tolist() == [1 + 10**9 * (int(n) + 1) // (5 * 10**18) for n in big]


def brute_audit(rows, labels):
    good, toxic = ({i for i, q, x in labels if i is not None and (q, x)[k] == 1} for k in (0, 1))
    masks = []
    for i, source, text in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, _, u in rows)
        m = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": copy}
        masks.append((source or "", {k for k, v in m.items() if v}, i in good, i in toxic))
    out = {}
    for part in {m[0] for m in masks}:
        own, shapley = [m for m in masks if m[0] == part], Counter()
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [m for m in own if f in m[1] and not m[1] & before]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [sum(not m[1] & (before | {f}) for m in own), len(gone), sum(f in m[1] and bool(m[1] & before) for m in own), sum(m[1] == {f} for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone)]
        for key in out:
            if key[0] == part:
                out[key].append(shapley[key[1][key[2] - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit(spark, monkeypatch):
    r = random.Random(5)
    long = [" ".join(f"w{r.randint(0, 900)}" for _ in range(260)) for _ in range(6)]
    rows = [(i, r.choice(["a", "b", None]), r.choice([*long, *long[:1] * 5, long[0][:-1] + "x", "a b", "", None, "A " * 250, "x # y", "é" * 300, " \t ", "one two " * 900 + "#" + "z" * 9000])) for i in range(90)]
    rows += [(5, "a", long[0]), (5, "b", long[0]), (5, "a", "new"), (None, "b", long[0]), (None, "b", long[0]), (None, None, None), (7, "only", long[0])]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 100, 2)] + [(4, 1, 0), (None, 1, 1), (5, 1, 1)]
    docs = spark.createDataFrame([(*x, 1, "m") for x in rows], "doc_id long, source string, text string, mask int, quality string").repartition(4)
    tags = spark.createDataFrame([(*x, "s") for x in labels], "doc_id long, quality int, toxic int, source string")
    common.tune(spark)
    for _ in range(2):
        got = {(x["part"], x["filter_order"], x["step"]): tuple(x[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for x in audit.interactions(docs, tags).collect()}
        want = brute_audit(rows, labels)
        assert set(got) == set(want) and {k: (v, got[k]) for k, v in want.items() if got[k] != v} == {}
        monkeypatch.setattr(audit, "BROADCAST_IDS", 0)
    assert audit.interactions(docs.where("false"), tags).count() == 0
    assert audit.interactions(docs.limit(3), tags.where("false")).count() % 600 == 0


def test_audit_hashes_that_clash(spark, monkeypatch):
    """With hashes that tell nothing apart, texts of one length still are, by their text."""
    rows = [(1, "s", "abc"), (2, "s", "abd"), (3, "s", "abc"), (4, "s", "abd"), (5, "s", "abe"), (6, "s", "long text")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    flat = audit.sketches(docs).withColumn("hashes", F.array(F.lit(0).cast("long")))
    keys = audit._keys

    def same(batches):
        import pyarrow as pa

        for b in keys(batches):
            yield pa.RecordBatch.from_arrays([b.column("points"), pa.array([[0]] * b.num_rows, pa.list_(pa.int64())), b.column("least")], names=b.schema.names)

    monkeypatch.setattr(audit, "_keys", same)
    assert sorted(x["doc_id"] for x in audit.copies(docs, flat).collect()) == [3, 4]


def test_words_and_blocks():
    t = ("ab  cd\n" * 50 + "x" * 40).encode()
    assert audit.words(t, 5) == audit.words(t) == (101, 3)
    assert len(audit.blocks(b"x" * 256)) == 1 and len(audit.blocks(b"x" * 257)) == 2 and audit.blocks(b"") == []


def test_registered():
    assert {"op11_nearest_neighbours", "op12_source_divergence", "op13_filter_interactions"} <= set(entry.queries())
