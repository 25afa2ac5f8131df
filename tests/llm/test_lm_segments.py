"""Training in many small segments gives the scores of one; no n-gram passes Spark as a row of its own."""

import random

from strideframe.llm import ngram


def test_lm_segments_cut_contexts(spark, monkeypatch):
    r = random.Random(4)
    words = ["the"] * 20 + [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(40))) for i in range(400)], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(ngram, "_book", ngram._exact)  # codebooks are of a segment; exact values tell the same from the like
    score = lambda model: {x["doc_id"]: x["score"] for x in ngram.score(docs, model).collect()}
    whole = ngram.train(docs)
    monkeypatch.setattr(ngram, "PART", 500)
    monkeypatch.setattr(ngram, "BLOB", 50)
    monkeypatch.setattr(ngram, "FLUSH", 2000)
    monkeypatch.setattr(ngram, "SAMPLES", ((1, 0),))
    cut = ngram.train(docs)
    assert len(whole.levels[1].segments) == 1 and len(cut.levels[1].segments) > 10
    a, b = score(whole), score(cut)
    assert len(a) == 400 and all(abs(a[i] - b[i]) < 1e-6 for i in a)
