"""Tables of known size are written in few files, however many partitions a shuffle has; texts that are only filtered aren't shuffled."""

from pyspark.sql import functions as F

from strideframe.llm import graph, neardup


def test_near_duplicates_write_few_files(spark, monkeypatch):
    files, whole = {}, graph.materialise

    def counted(df, hint):
        out = whole(df, hint)
        files[hint] = max(files.get(hint, 0), len(out.inputFiles()))
        return out

    for module in (graph, neardup):
        monkeypatch.setattr(module, "materialise", counted)
    keys = {"spark.sql.shuffle.partitions": "67", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("w"), (F.col("id") % 150 * 100 + i).cast("string"))))
        docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(text, F.lit(" last"), (F.col("id") % 2).cast("string")).alias("text"))
        got = neardup.near_duplicates(docs, n=4).agg(F.count("*"), F.count_if("kept")).first()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tuple(got) == (300, 150)
    assert max(files.values()) <= spark.sparkContext.defaultParallelism, files


def test_dropping_copies_shuffles_no_text(spark):
    docs = spark.createDataFrame([(5, "a b c d e f g", 1), (3, "a b c d e f g", 2), (None, "a b c d e f g", 3), (9, "q r s t u v w", 4), (9, "q r s t u v w", 5), (4, None, 6)], "doc_id int, text string, n int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with very many ids
    try:
        left = neardup.drop_near_duplicates(docs)
        rows = left.collect()
        plan = left._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert left.schema == docs.schema
    assert sorted(r["n"] for r in rows) == [2, 3, 4, 5, 6]
    assert "Exchange" not in plan and "Join" not in plan


def test_only_texts_that_are_compared_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 1)
    text = spark.range(100).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    pairs = spark.createDataFrame([(3, 50), (50, 7)], "a long, b long")
    got = neardup._involved(text, pairs, 2)
    assert sorted(tuple(r) for r in got.collect()) == [(3, "text 3"), (7, "text 7"), (50, "text 50")]
    none = neardup._involved(text, pairs.where("a < 0"), 0)
    assert none.count() == 0
