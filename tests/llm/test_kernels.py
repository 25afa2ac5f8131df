"""Kernels against plain computations, and how much they read."""

import numpy as np
import pyarrow as pa
import pytest

from strideframe.llm import common, lookup, neardup, packed, paragraphs, repeats, textkit


def test_words_and_lowering():
    texts = ["", "A b\tC", "x", "y z ", "\x0b\x0c", " é\x08Q\x0e[@`Z{ ", "end", "", "End"]
    data, offs = common.text_bytes(pa.array(texts))
    start, end, first = textkit.word_spans(data, offs)
    got = [bytes(data[a:b]) for a, b in zip(start, end, strict=True)]
    assert got == [w for t in texts for w in t.encode().split(None) if w.strip(b" \t\n\r\x0b\x0c")]
    assert np.diff(first).tolist() == [len(t.encode().split()) for t in texts]
    every = np.arange(256, dtype=np.uint8)
    assert bytes(textkit.lowered(every)) == bytes(every).lower()


def test_prefix_hash_over_blocks(monkeypatch):
    data = np.random.default_rng(1).integers(0, 256, 1000).astype(np.uint8)
    whole = textkit.prefix_hash(data)
    monkeypatch.setattr(textkit, "BLOCK", 7)
    assert (textkit.prefix_hash(data) == whole).all()
    assert whole[-1] == U64(sum((int(x) + 1) * pow(textkit._BASE, i, 1 << 64) for i, x in enumerate(data)))


def U64(x):
    return np.uint64(x % (1 << 64))


def test_shingles_in_order_when_hashes_share_their_top():
    h = np.array([5, 3, 3, 1 << 63, 4, 2], np.uint64)
    doc = np.array([0, 0, 1, 0, 1, 1])
    assert neardup._by_document(h, doc, 2).tolist() == np.lexsort((h, doc)).tolist()


def test_empty_buckets_take_their_first_donor():
    h = np.sort(np.random.default_rng(2).integers(0, 1 << 63, 9).astype(np.uint64) * np.uint64(2))
    regs = neardup.registers(h, np.array([0, 4, 4, 9]), 36)
    own = [{int(x) >> 57 for x in part} for part in (h[:4], h[4:])]
    for row, full in ((0, own[0]), (2, own[1])):
        every = neardup.registers(h[:4] if row == 0 else h[4:], np.array([0, len(h[:4] if row == 0 else h[4:])]))[0]
        assert regs[row].tolist() == [int(every[next(d for d in neardup.DONORS[j] if d in full)]) for j in range(36)]
    assert not regs[1].any()


def test_repeated_keys_and_their_first_rows(spark, monkeypatch):
    monkeypatch.setattr(packed, "FLUSH", 20)
    r = np.random.default_rng(5)
    rows = [(None if i % 17 == 0 else f"d{i % 40}", i * 7 % 101, r.integers(0, 60, 5).tolist()) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id string, key long, ks array<long>").repartition(4)
    spread = lambda b: textkit.mix(b.column("ks").flatten().to_numpy().view(np.uint64)).view(np.int64)
    of = lambda b: np.repeat(np.arange(b.num_rows), 5)
    asked = textkit.mix(np.arange(61, dtype=np.uint64)).view(np.int64)
    want, first = [sum(x[2].count(k) for x in rows) for k in range(61)], []
    for k in range(61):
        first.append(min(((x[0] is not None, x[0] or "", x[1]) for x in rows if k in x[2]), default=(0, "", 0))[2])
    found, (n,) = lookup.repeated(docs, lambda b: [spread(b)], 3).first(asked, "n")
    assert n.tolist() == [x if x > 1 else 0 for x in want] and found.tolist() == [x > 1 for x in want]
    table = lookup.repeated_firsts(docs, lambda b: [(spread(b), of(b), b.column("doc_id"), b.column("key").to_numpy())], 3)
    found, (doc,) = table.first(asked, "doc")
    assert len(table.segments) == 3 and doc[found].tolist() == [x for x, y in zip(first, want, strict=True) if y > 1]


def test_lines_are_cut_from_texts_once(spark, monkeypatch):
    seen, whole = [], paragraphs.cluster
    monkeypatch.setattr(paragraphs, "cluster", lambda items, *a, **k: (seen.append(items.inputFiles()), whole(items, *a, **k))[1])
    line = "one two three four five six seven eight nine ten"
    docs = paragraphs._keyed(spark.createDataFrame([(1, f"{line}\nshort\n\n{line}"), (2, line), (3, None)], "doc_id long, text string"))
    assert paragraphs.repeated_lines(docs).count() == 4  # three lines, and the first one joined with the short one: 6 of 7 shingles
    assert seen[0] and all("compared-lines" in f for f in seen[0])  # not the texts, which would be cut again in every step


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"\0\xff", bytes(range(256))])
def test_suffixes_are_sorted_until_they_differ(monkeypatch, alphabet):
    r, sorted_, entries = np.random.default_rng(len(alphabet)), repeats.RunLengthIndex._sorted, []
    monkeypatch.setattr(repeats.RunLengthIndex, "_sorted", staticmethod(lambda key, bits: entries.append(len(key)) or sorted_(key, bits)))
    base = bytes(r.choice(list(alphabet), 300).astype(np.uint8))
    texts = [base, base[:120] + b"!" + base[120:250], base, b"", bytes(r.choice(list(alphabet), 3000).astype(np.uint8))]
    index = repeats.RunLengthIndex(texts, np.array([max(len(t) - 199, 0) for t in texts]), 200)
    places = sorted(((t[i:], n, i) for n, t in enumerate(texts) for i in range(len(t))))
    begin = np.cumsum([0, *map(len, texts)])
    want = [256 + n if i == 0 else texts[n][i - 1] for _, n, i in places]
    assert index.heads.tolist() == [c for k, c in enumerate(want) if not k or c != want[k - 1]]
    assert index.run_first.tolist() == sorted(int(begin[n]) + i for k, (_, n, i) in enumerate(places) if not k or want[k] != want[k - 1])
    assert len(alphabet) < 256 or sum(entries) < 3 * len(places)  # every round sorted all before


@pytest.mark.parametrize("bits", [10, 63])
def test_keys_are_sorted_with_their_places(bits):
    key = np.random.default_rng(0).integers(0, 1 << 10, 5000).astype(np.uint64)
    rising, place = repeats.RunLengthIndex._sorted(key, bits)
    assert place.tolist() == np.argsort(key, kind="stable").tolist() and rising.tolist() == sorted(key.tolist())
