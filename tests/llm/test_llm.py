"""Each operator against brute force or a library, with nulls, empty, long, repeated rows and odd columns."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from strideframe.llm import bpe, common, decontam, entry, langid, neardup, ngram, paragraphs, pii, repeats, tokencount, topk
from strideframe.llm.eliasfano import EliasFano, encode
from strideframe.llm.graph import components

ODD = [None, "", " ", "a", "one two three", "x" * 5000, "ab " * 2000, "é😀 ü\n\n\tz", "same words here again and again", "same words here again and again"]


@pytest.fixture(scope="module")
def odd(spark):
    common.tune(spark)
    rows = [(i, t, "key", "id") for i, t in enumerate(ODD)] + [(3, "a", "key", "id"), (None, "no id at all", "key", "id")]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, id string").repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def test_pii(spark, odd, none):
    model = pii.Boosted([], [])
    text = "a@b.c.@d.e +x@y.com 1.2.3.4.5.6.7.8 300.1.1.1 +1 (314) 555-6532 4111-1111-1111-1111 4111 1111 1111 1112 é a@b.co"
    base = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def brute(t):
        out = []
        for kind, p in base.items():
            for m in re.finditer(p, t):
                d = [int(c) for c in m.group() if c.isdigit()]
                luhn = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
                fine = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in re.findall(r"\d+", m.group())), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]
                out += [f"{kind}:{m.start()}:{m.end()}"] if fine else []
        return ",".join(out)

    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(99, text), (98, "9" * 30000), (97, "a" * 30000)], "doc_id long, text string"))
    texts = dict(docs.collect())
    for r in pii.digest(docs, model).collect():
        want = brute(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and r["spans"] == want
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs, model).collect()}
    assert "@" not in clean[99] and "[EMAIL]" in clean[99] and clean[0] is None
    assert pii.redact(none, model).count() == 0 and pii.redact(odd, model).columns == odd.columns


def test_pii_adds_loose_forms_and_nothing_invalid(spark):
    model = pii.fit(spark)
    added = {"joe [at] corp [dot] com": "email:0:23", "call (555) 123-4567 now": "phone:5:19", "host 10[.]0[.]0[.]7 and 300[.]0[.]0[.]7": "ip:5:19", "mail me: ann at corp dot com": "email:9:28", "card 3782 822463 10005": "card:5:22", "IP: fe80:1::2": "ip:4:13", "updates from joe [at] corp [dot] com": "email:13:36", "item joe (at) corp (dot) com": "email:5:28", "page 10[.]0[.]0[.]7": "ip:5:19", "my apartment phone: 555-123-4567": "phone:20:32"}
    not_added = ["ip 300.1.1.1 here", "order no. 555-123-4567", "card 3782 822463 10006", "look at house dot matrix", "on the date 2021-03-04", "at 12:30:45:10", "call on 2021-03-04", "phone 2021-03-04", "fax 1999-12-31", "call 31.12.1999"]
    rows = [(i, t) for i, t in enumerate([*added, *not_added])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_email": F.lit(1), "row": F.lit("x"), "spans": F.lit(2), "all_ip": F.lit(3), "a.b": F.lit(4)})
    got = {x["doc_id"]: x["spans"] for x in pii.digest(docs, model).collect()}
    assert got == {i: added.get(t, "") for i, t in rows}
    clean = pii.redact(docs, model)
    assert clean.columns == docs.columns
    texts = {x["doc_id"]: x["text"] for x in clean.collect()}
    assert texts[1] == "call [PHONE] now" and all(texts[i] == t for i, t in rows if t in not_added)
    # Precision and recall on planted texts that neither fitted nor calibrated.
    other = common.materialise(pii.planted(spark).withColumn("id", F.col("id") + 1), "planted")
    found = Counter()
    for x in pii.counted(other).collect():
        f = tuple(x["f"])
        form = list(pii.FORMS)[f[0]]
        taken = form in model.thresholds and model.score(f) >= model.thresholds[form]
        found[form, "hit"] += x["p"] * taken
        found[form, "false"] += (x["n"] - x["p"]) * taken
        found[form, "all"] += x["p"]
    for form in pii.LOOSE:
        assert found[form, "hit"] >= 0.6 * found[form, "all"] > 0 and found[form, "false"] <= 0.06 * found[form, "hit"], (form, found)


def test_pii_many_matches_in_one_text(spark):
    text = "a@b.co 1.2.3.4 " * 3000
    got = pii.digest(spark.createDataFrame([(1, text)], "doc_id long, text string"), pii.Boosted([], [])).first()
    assert (got["n_email"], got["n_ip"]) == (3000, 3000) and got["spans"].endswith("ip:44992:44999")


@pytest.mark.parametrize("seed", range(20))
def test_run_length_index(seed):
    r = random.Random(seed)
    length, base = r.choice([1, 2, 5, 9, 30]), bytes(r.choice(b"\0ab\xff") for _ in range(60)) * 3
    texts = []
    for _ in range(r.randint(1, 8)):
        text = bytearray(base[r.randint(0, 40) :][: r.randint(length, length + 40)])
        text[r.randrange(len(text))] = r.choice(b"\0abz")
        texts.append(bytes(text))
    texts += texts[:1] * r.randint(0, 1)
    index = repeats.RunLengthIndex(texts, np.array([len(t) - length + 1 for t in texts]), length)
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    assert [f.tolist() for f in index.stream()] == [[seen[t[i : i + length]] > 1 for i in range(len(t) - length + 1)] for t in texts]
    places = [(t, i) for t in texts for i in range(len(t))]
    common_ = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    best = [max((common_(t[i:], u[j:]) for n, (u, j) in enumerate(places) if n != m), default=0) for m, (t, i) in enumerate(places)]
    assert index.statistics().tolist() == best
    assert len(index.heads) == len(index.run_ends) == len(index.run_first) and index.run_ends[-1] == len(places) - 1


def test_run_length_index_of_nothing():
    assert list(repeats.RunLengthIndex([], np.zeros(0, np.int64)).stream()) == []


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeats(spark, odd, none, hot):
    r = random.Random(0)
    passage = "".join(r.choice("abcdef ") for _ in range(400))
    made = [(100 + i, "".join(r.choice("ghij") for _ in range(r.randint(0, 300))) + passage[r.randint(0, 60) :] + "".join(r.choice("klm") for _ in range(100))) for i in range(12)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    rows = [(d, (t or "").encode()) for d, t in docs.collect()]
    seen = Counter(t[i : i + 200] for _, t in rows for i in range(len(t) - 199))
    want = []
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        want.append((d, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept))
    got = [(x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in repeats.deduplicated(docs, hot=hot).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert repeats.digest(none).count() == 0


def test_near_duplicates(spark, odd, none):
    r = random.Random(1)
    base = [f"w{r.randint(0, 500)}" for _ in range(80)]
    made = []
    for i in range(40):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"e{r.randint(0, 9)}"
        made.append((100 + i, " ".join(w)))
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    rows = [(d, t) for d, t in docs.collect() if d is not None]

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()

    sets = {}
    for d, t in rows:
        sets[d] = shingles(t)
    comp = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert [tuple(x) for x in neardup.near_duplicates(docs, n=4).where("doc_id IS NULL").collect()] == [(None, 1, None, True)]
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "q r s t u v"), (2, "q r s t u v"), (3, "a b c d e f")], "doc_id long, text string")
    assert {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(twice, n=4).collect() if x["doc_id"] == 1} == {1: 1}
    got = neardup.near_duplicates(docs, n=4).where("doc_id IS NOT NULL").collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in got} == {d: (len(s), comp[d], comp[d] == d) for d, s in sets.items()}
    assert len(got) == len(rows)
    assert neardup.near_duplicates(none).count() == 0
    left = neardup.drop_near_duplicates(odd)
    assert left.columns == odd.columns and left.where("doc_id IN (8, 9)").count() == 1


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (40, 50), (7, 7), (None, 1)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(31)} | {40: 40, 50: 40}
    assert components(links.where("false")).count() == 0


def test_top_k(spark):
    common.tune(spark)
    r = np.random.default_rng(0)
    rows = [(i, r.normal(size=8).round(2).tolist()) for i in range(300)] + [(1000 + i, [0.5] * 8) for i in range(30)]
    rows += [(3000, [1e9, 0.0] * 4), (3000, [2.0] * 8), (3001, [3e9, 0.0] * 4)]
    odd_rows = [(2000, None), (2001, [float("nan")] * 8), (2002, [None] * 8), (2100, [1.0, 2.0]), (2200, [3.0, 4.0]), (None, [0.5] * 8)]
    v = spark.createDataFrame(rows + odd_rows, "vec_id long, embedding array<double>").repartition(4)
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in topk.top_k(v, F.col("vec_id") % 100 == 0, 10).collect()}
    fine = [(i, np.floor(1024 * np.array(e)).astype(int)) for i, e in [*rows, (2100, [1.0, 2.0]), (2200, [3.0, 4.0])]]
    want = {}
    asks = {}
    for q, a in fine:
        if q % 100 == 0 and (q not in asks or list(a) < list(asks[q])):
            asks[q] = a
    for q, a in asks.items():
        if True:
            best = sorted((-max(-(2**62), min(2**62, sum(int(x) * int(y) for x, y in zip(a, b, strict=True)))), i) for i, b in fine if i != q and len(b) == len(a))[:10]
            want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(best)}
    assert got == want
    assert topk.top_k(v.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_elias_fano():
    r = np.random.default_rng(0)
    for n, u in ((0, 1), (1, 2**63), (5000, 900), (20000, 2**40), (1000, 2**64 - 1)):
        v = np.sort(r.integers(0, u, n, dtype=np.uint64, endpoint=True))
        e = EliasFano(encode(v))
        assert (e.access(np.arange(n)) == v).all()
        q = np.concatenate([v[:300], r.integers(0, u, 300, dtype=np.uint64, endpoint=True)])
        assert (e.successor(q) == np.searchsorted(v, q)).all()


def test_lm_scores(spark, odd, none):
    r = random.Random(2)
    words = ["the", "cat", "sat", "on", "mat", "dog"]
    chain = lambda: " ".join(words[(i * 7 + r.randint(0, 1)) % 6] for i in range(30))
    docs = ngram.folded(odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, chain()) for i in range(60)], "doc_id long, text string")))
    model = ngram.train(docs.where("NOT held_out"))
    rows = docs.collect()
    toks = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")), None]
    c = Counter(w for x in rows if not x["held_out"] for w in toks(x["text"]))
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks(t))
    got = ngram.score(docs, model, keep=("held_out",)).collect()
    want = Counter((x["doc_id"], len(toks(x["text"])), sum(c[w] > 0 for w in toks(x["text"])), n, round(base(x["text"]), 6)) for x in rows)
    assert Counter((x["doc_id"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 6)) for x in got) == want
    held = [x for x in got if x["held_out"] and (x["doc_id"] or 0) >= 100]
    assert sum(x["score"] for x in held) > sum(x["base_score"] for x in held)
    # The interpolated model by brute force; 8-bit codes hold few distinct values here, so nothing is lost to them.
    grams, ways = Counter(), Counter()
    for x in rows:
        t = toks(x["text"]) if not x["held_out"] else []
        for k in (2, 3):
            for i in range(len(t) - k + 1):
                grams[tuple(t[i : i + k])] += 1
    context = Counter()
    for g, m in grams.items():
        context[g[:-1]] += m
        ways[g[:-1]] += 1

    def brute(t):
        out = 0.0
        for i, w in enumerate(t):
            p = (c[w] + 0.5) / (n + 0.5 * (v + 1))
            for k in (1, 2):
                ctx = tuple(t[i - k : i])
                if i < k or (c[ctx[0]] if k == 1 else grams[ctx]) == 0:
                    break
                seen = c[ctx[0]] if k == 1 else grams[ctx]
                rest = max(1 - (context[ctx] - 0.75 * ways[ctx]) / seen, 1e-9) if ctx in ways else 1.0
                p = (max(grams[ctx + (w,)] - 0.75, 0) / seen if grams[ctx + (w,)] else 0) + rest * p
            out += np.log10(p)
        return out

    assert all(abs(x["score"] - brute(toks(y))) < 1e-3 * max(1, x["n_tokens"]) for x in got for y in [z["text"] for z in rows if z["doc_id"] == x["doc_id"]][:1])
    empty = ngram.train(none)
    assert ngram.score(odd, empty).agg(F.max("score"), F.min("score")).first() == (0.0, 0.0)


def test_lm_counts_rare_ngrams(spark):
    rows = [(i, t) for i, t in enumerate(["red fox ran home", "red fox sat down", "old dog ran home", "old dog sat down", "red cat", "old cat"])]
    model = ngram.train(spark.createDataFrame(rows, "doc_id long, text string"))
    asked = ["red fox ran", "red dog ran", "old fox ran"]  # words equally frequent; the corpus holds only the first, once
    got = {x["doc_id"]: x for x in ngram.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    assert len({round(x["base_score"], 9) for x in got.values()}) == 1
    assert got[0]["score"] > got[2]["score"] and got[0]["score"] > got[1]["score"]


def test_bpe(spark, odd):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(entry.RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.coder(entry.RANKS, P.PATTERN)
    for t in ["", "Hello  world's 123\n\n x", "日本語" * 200, "a" * 2000, "\x00\x01é", "<|endoftext|>", "ab" * 700, "".join(random.Random(9).choice("thequickaes") for _ in range(30000))]:
        assert coder.encode(t) == enc.encode_ordinary(t) and coder.decode(coder.encode(t)) == t.encode()
    got = bpe.decode(bpe.encode(odd, entry.RANKS, P.PATTERN), entry.RANKS, P.PATTERN)
    assert set(odd.columns) < set(got.columns)
    for x in got.collect():
        assert x["ids"] == enc.encode_ordinary(x["text"] or "") and bytes(x["decoded"]) == (x["text"] or "").encode()


def test_bpe_slice_above_the_memo(monkeypatch):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(entry.RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.ByteBPE(entry.RANKS, P.PATTERN)
    monkeypatch.setattr(bpe, "MEMO", 50)
    many = "some words come first" + " ".join(f"{i * 7919 % 99991:x}q" for i in range(400))
    for t in ["some words come first", many, "some words come first", many + " and more", "some words"]:
        assert coder.encode(t) == enc.encode_ordinary(t)


def test_paragraphs(spark, odd, none):
    r = random.Random(3)
    para = lambda: " ".join(" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(r.randint(5, 12))) + "." for _ in range(8))
    p = para()
    near = p.split()
    near[10] = "other"
    made = [(100, para() + "\n" + p), (101, para() + " " + p + " " + para()), (102, p), (103, " ".join(near))] + [(200 + i, para() + "\n" + para()) for i in range(10)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    got = {x["doc_id"]: x for x in paragraphs.deduplicated(docs).collect() if x["doc_id"] is not None}
    assert got[100]["n_removed"] == 0 and got[101]["n_removed"] > 200
    assert got[102]["n_removed"] == len(p) and got[103]["n_removed"] == len(" ".join(near))
    assert all(got[i]["n_removed"] == 0 for i in range(200, 210)) and got[0]["n_bytes"] == 0
    assert paragraphs.digest(none).count() == 0


def test_paragraphs_find_passages_inside_other_text(spark):
    r = random.Random(5)
    word = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    p, tail, loop = word(50), word(25), "round " * 300
    made = [(1, word(30) + " " + p + " " + word(30)), (2, word(17) + " " + p + " " + word(40)), (3, f"{word(9)} {p} {word(3)}. {tail}"), (4, f"{word(40)} {tail} {word(9)}"), (5, loop), (6, word(60))]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x for x in paragraphs.deduplicated(docs).collect()}
    text = dict(made)
    assert got[1]["n_removed"] == got[6]["n_removed"] == 0
    for i, passage in ((2, p), (3, p), (4, tail)):  # to their very ends, without a sentence end in sight
        assert bytes(got[i]["kept"]).decode() == text[i].replace(passage, ""), i
    assert bytes(got[5]["kept"]).split() == [b"round"] * paragraphs.STRETCH


def test_paragraphs_short_and_wrapped_lines(spark):
    r = random.Random(6)
    words = lambda n: ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    nine, three, prose = " ".join(words(9)), " ".join(words(3)), words(60)
    other = [*prose[:25], "another", *prose[26:]]
    wrap = lambda w: "\n".join(" ".join(w[i : i + 12]) for i in range(0, len(w), 12))
    twelve = words(12)
    made = [(i, f"{' '.join(words(25))}\n{nine}\n{three.upper() if i % 2 else three}") for i in range(1, 8)]
    made += [(20, wrap(prose)), (21, f"{' '.join(words(30))}\n\n{wrap(other)}"), (22, "\n" + wrap(words(40))), (30, " ".join(twelve)), (31, " ".join(twelve[1:])), (40, " ".join(words(30)))]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: bytes(x["kept"]).decode() for x in paragraphs.deduplicated(docs).collect()}
    text = dict(made)
    assert all(got[i] == text[i] for i in (1, 20, 22, 30, 40))
    for i in range(2, 8):  # lines of nine and of three words
        assert got[i].split() == text[i].split()[:25]
    assert got[21].split() == text[21].split()[:30]  # an edited hard-wrapped paragraph
    assert got[31] == ""  # a near copy of a line of twelve words


def test_paragraph_links_against_brute_force(spark):
    """Recall of the banding over the lines of whole documents: every pair at 0.8 or more is in one component."""
    keyed = paragraphs._keyed(common.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text"))
    line = F.posexplode(F.split("text", "\n", -1)).alias("line", "text")
    lines = keyed.where("text IS NOT NULL").select("key", line).select(paragraphs._line_id(F.col("key"), F.col("line")).alias("id"), "text").collect()
    component = {x["key"]: x["component"] for x in paragraphs.repeated_lines(keyed).collect()}
    sets, alike = {}, {}
    for x in lines:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), x["text"]))
        if len(w) >= paragraphs.LINE_WORDS:
            sets[x["id"]] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
            alike.setdefault(sets[x["id"]], x["id"])
    holds = {}
    for g, i in alike.items():
        for shingle in g:
            holds.setdefault(shingle, []).append(i)
    met = Counter((a, b) for ids in holds.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    pairs = [(a, b) for (a, b), n in met.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    pairs += [(i, alike[g]) for i, g in sets.items() if alike[g] != i]
    found = sum(a in component and component[a] == component.get(b) for a, b in pairs)
    assert len(pairs) > 50 and found >= 0.999 * len(pairs), (found, len(pairs))


def test_token_counts(spark, odd):
    tok = tokencount.library(entry.LIBRARY)
    r = random.Random(4)
    prose = " ".join("".join(r.choice("abcdeé ") for _ in range(9)) for _ in range(9000))
    for t in [prose, "x" * 60000, "abc<|endoftext|> d" * 4000, "é à\n\n\t b" * 6000, prose.replace(" ", "")]:
        assert tokencount.count_huge(tok, t) == len(tok.encode(t, add_special_tokens=False))
    for x in tokencount.token_counts(odd, entry.LIBRARY).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        assert x["n_tokens"] == len(tok.encode(x["text"] or "", add_special_tokens=False)) and x["n_bytes"] == len((x["text"] or "").encode())


def _leaks(docs, bench):
    """Brute force: every alignment of every item in every document."""

    def words(text):
        toks = regex.findall(decontam.TOKEN, text)
        out = []
        for i, t in enumerate(toks):
            before, stop = (toks[i - 1] if i else None), lambda x: x in ".!?"
            if t[0] in "0123456789":
                c = "<number>"
            elif before and before[0] in "0123456789" and t.lower() in decontam.UNITS:
                c = "<unit>"
            elif t[0] != t[0].lower() and before is not None and not stop(before):
                c = "<name>"
            else:
                c = t.lower()
            if not stop(t):
                out.append((c, t.lower()))
        return out

    def in_windows(ws):
        """What stands in a window: canonical, but the value inside a run of placeholders."""
        return [w[1] if 2 <= i < len(ws) - 2 and all(x[0][0] == "<" for x in ws[i - 2 : i + 3]) else w[0] for i, w in enumerate(ws)]

    def fits(pairs):
        return len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)

    found = {}
    for item, their in bench:
        if item is None or not their or not words(their):
            continue
        theirs, n = words(their), min(8, len(words(their)))
        seen = (lambda ws: [w[1] for w in ws]) if len(theirs) < 8 else in_windows
        windows = [tuple(seen(theirs)[i : i + n]) for i in range(len(theirs) - n + 1)]
        for doc, text in docs:
            mine = words(text or "") if doc is not None else []
            shifts, looks = {}, seen(mine)
            for at in range(len(mine) - n + 1):
                w = tuple(looks[at : at + n])
                for place, x in enumerate(windows):
                    if x == w:
                        shifts.setdefault(at - place, []).append(place)
            ways = set()
            for shift, places in shifts.items():
                span = range(min(places), max(places) + n)
                slots = {(theirs[i][0] + theirs[i][1], theirs[i][0] + mine[i + shift][1]) for i in span if theirs[i][0] == mine[i + shift][0] and theirs[i][0][0] == "<"}
                if fits(slots):
                    ways.add((-len(places), tuple(sorted(places)), tuple(sorted(slots))))
            places, slots = set(), set()
            for _, p, x in sorted(ways):
                if fits(slots | set(x)):
                    places, slots = places | set(p), slots | set(x)
            if len(places) >= 0.5 * len(windows):
                found[doc, item] = max(found.get((doc, item), (0,)), (len(places) / len(windows), len(places), len(windows)))
    return found


def test_decontamination(spark, odd, none):
    item = "Then Anna buys 12 apples for 30 dollars and gives 12 to her good friend Tom in the park."
    same = item.replace("Anna", "Mary").replace("12", "15").replace("30", "40")
    broken = same.replace("gives 15", "gives 16")
    r = random.Random(7)
    prose = lambda n: " ".join(r.choice(["tree", "Rome", "12", "kg", "runs.", "blue", "Anna", "with", "7", "days"]) for _ in range(n))
    bench = [(7, item), (8, "x"), (9, None), (None, item), (10, "Capital of France?"), (11, prose(16)), (12, prose(30)), (12, prose(9)), (13, "...")]
    long_one, other = bench[6][1], bench[5][1]
    rows = [(100, "Well. " + item), (101, same), (102, broken), (103, "apples for 30 dollars"), (104, "the capital of france is"), (105, " ".join([" ".join(other.split()[:8])] * 5)), (106, " ".join([*long_one.split()[:14], "indeed so", *long_one.split()[14:]])), (107, item), (107, prose(5)), (108, other + " " + prose(40) + " " + other.replace("12", "77"))]
    rows += [(200 + i, prose(60)) for i in range(10)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = decontam.leaks(docs.withColumns({"item_id": F.lit(1), "h": F.lit(2), "words": F.lit(3)}), spark.createDataFrame(bench, "item_id long, text string").withColumn("key", F.lit(1)))
    got = {(x["doc_id"], x["item_id"]): (x["coverage"], x["matched"], x["windows"]) for x in got.collect()}
    want = _leaks([tuple(x) for x in docs.collect()], bench)
    assert got == want
    assert {(100, 7), (101, 7), (104, 10), (106, 12), (107, 7)} <= set(got) and not {(102, 7), (105, 11)} & set(got)
    small = spark.createDataFrame(bench[:4], "item_id long, text string")
    assert decontam.leaks(none, small).count() == 0 and decontam.leaks(docs, small.where("false")).count() == 0
    assert decontam.drop_contaminated(docs, small).count() == docs.count() - 4


def test_decontamination_of_runs(spark):
    """Tables of numbers: found by value, by brute force where small, and in time that doesn't multiply the lengths."""
    r = random.Random(11)
    cell = lambda: r.choice(["12", "12", "7", "3.5", "kg", "Rome", "Anna", "blue", "by"])
    bench = [(i, "The " + " ".join(cell() for _ in range(r.randint(9, 30)))) for i in range(6)]
    rows = [(i, " ".join(cell() for _ in range(60))) for i in range(20)] + [(50 + i, "See " + x + " there") for i, x in bench]
    schema = ("doc_id long, text string", "item_id long, text string")
    got = decontam.leaks(spark.createDataFrame(rows, schema[0]), spark.createDataFrame(bench, schema[1]))
    assert {(x["doc_id"], x["item_id"]): (x["coverage"], x["matched"], x["windows"]) for x in got.collect()} == _leaks(rows, bench)

    numbers = [str(r.randrange(10**9)) for _ in range(20_000)]
    table = [(1, " ".join(numbers)), (2, " ".join(str(r.randrange(10**9)) for _ in range(20_000)))]
    got = decontam.leaks(spark.createDataFrame(table, schema[0]), spark.createDataFrame([(5, " ".join(numbers[9_000:9_200]))], schema[1])).collect()
    assert [(x["doc_id"], x["matched"], x["windows"]) for x in got] == [(1, 189, 193)]  # two words at either end are no inside of the item's run


def test_decontamination_of_given_tables(spark):
    """All leaks that brute force finds in whole tables, and no others."""
    docs, bench = (common.table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "benchmark"))
    got = {(x["doc_id"], x["item_id"]): (x["coverage"], x["matched"], x["windows"]) for x in decontam.leaks(docs, bench).collect()}
    want = _leaks([tuple(x) for x in docs.select("doc_id", "text").collect()], [tuple(x) for x in bench.select("item_id", "text").collect()])
    assert got and got == want


def test_language_id(spark, odd, none):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    got = entry.op10_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.95
    model = langid.train(none.withColumn("lang", F.lit("en")), entry.PIECES)
    assert {x["lang_pred"] for x in langid.predict(odd, model).collect()} == {"und"}
    full = langid.train(docs, entry.PIECES)
    by = {x["doc_id"]: x for x in langid.predict(odd, full).collect()}
    marks = spark.createDataFrame([(1, "\u00b2 \u00bd \u2167 \u2460 12"), (2, "\u00b2 word"), (3, "\u65e5\u672c")], "doc_id long, text string")
    assert {x["doc_id"]: x["lang_pred"] == "und" for x in langid.predict(marks, full).collect()} == {1: True, 2: False, 3: False}  # numbers that look like letters are none
    assert entry.op10_language_id(spark, "/root/testdata/sf0.001").where("held_out IS NULL").count() == 0
    assert by[0]["lang_pred"] == by[1]["lang_pred"] == "und" and 0 < by[4]["score"] <= 1


def test_language_id_sums_all_segmentations():
    vocab = {"▁a": 0, "▁ab": 1, "b": 2, "a": 3, "ba": 4, "▁": 5, "abb": 6}
    logp = np.log(np.array([[0.3, 0.1], [0.2, 0.3], [0.1, 0.2], [0.1, 0.1], [0.1, 0.1], [0.1, 0.1], [0.1, 0.1]]))

    def total(w, k):
        if not w:
            return 1.0
        own = sum(np.exp(logp[vocab[w[:n]], k]) * total(w[n:], k) for n in range(1, len(w) + 1) if w[:n] in vocab)
        return own + np.exp(langid.UNKNOWN) * total(w[1:], k)

    words = ["abba", "b", "ab", "xyz", "aababb"]
    got = langid.Lattice(words, langid.Pieces(vocab)).forward(logp)[1]
    assert np.allclose(got, [[np.log(total("▁" + w, k)) for k in (0, 1)] for w in words])


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "tokens"]
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.materialise(stage(spark, docs, "/root/testdata/sf0.001"), "test")
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        docs = out
    assert docs.where(F.col("text").rlike(r"[a-z0-9.]+@[a-z0-9]+\.example")).count() == 0


def test_lm_training_aggregates_weights_once_and_drops_shuffles(spark, monkeypatch):
    key, seen, whole = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], ngram._weights
    before = spark.conf.get(key)
    monkeypatch.setattr(ngram, "_weights", lambda rows, *a: (seen.append((hasattr(rows, "_strideframe_path"), spark.conf.get(key))), whole(rows, *a))[1])
    ngram.train(spark.createDataFrame([("a b c a b d",), ("a b c",)], "text string"))
    assert seen == [(True, "true")] * 2 and spark.conf.get(key) == before
