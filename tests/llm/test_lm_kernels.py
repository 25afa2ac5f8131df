"""What scoring and training of the language model read and hold."""

import numpy as np
import pyarrow as pa

from strideframe.llm import common, eliasfano, ngram


def test_a_single_candidate_is_read_once(monkeypatch):
    values = np.arange(1000, dtype=np.uint64) << np.uint64(10)
    ef = eliasfano.EliasFano(eliasfano.encode(values))
    read, whole = [], eliasfano.EliasFano._low
    monkeypatch.setattr(eliasfano.EliasFano, "_low", lambda self, i: (read.append(len(i)), whole(self, i))[1])
    assert (ef.find(values) == np.arange(1000)).all()
    assert sum(read) == 1000  # twice before
    assert (ef.successor(values + np.uint64(1)) == np.arange(1, 1001)).all()


def test_a_batch_is_walked_at_once():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 4000)], names=["text"])  # as large as batches get
    assert len(list(common.slices(batch, "text", ngram.SLICE))) == 1


def test_words_are_counted_in_packed_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(f"a b w{i} w{i // 2}",) for i in range(400)] + [(None,)], "text string")
    monkeypatch.setattr(ngram, "WORD_BYTES", 500)
    table, n, v = ngram._unigrams(docs, common.shared_dir(spark))
    assert (n, v) == (4 * 400 + 401, 3 + 400) and len(table.segments) > 5
    words, _ = ngram.tokens(pa.array(["a w7 w250 never"]))
    assert table.get(words, 0.0)[1].tolist() == [400, 3, 1, 0, 401]
