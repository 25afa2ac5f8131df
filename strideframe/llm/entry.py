"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, bpe, decontam, divergence, langid, neardup, ngram, paragraphs, pii, repeats, tokencount, topk
from .common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.digest(docs, pii.fit(spark))


def op2_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), n=4)


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ngram.folded(table(spark, sf_dir, "documents"))
    return ngram.score(docs, ngram.train(docs.where(~F.col("held_out"))), keep=("held_out",))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op7_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.digest(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), LIBRARY)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, PIECES)
    folds = docs.select("doc_id", "text", langid.held_out().alias("held_out"))
    return langid.predict(folds, model, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 4 THEN list_aggregate(words, 'string_agg', ' ')
         ELSE unnest(list_transform(range(1, len(words) - 2), lambda i: list_aggregate(words[i:i + 3], 'string_agg', ' '))) END AS s
  FROM w WHERE len(words) >= 4
  UNION
  SELECT doc_id, list_aggregate(words, 'string_agg', ' ') FROM w WHERE len(words) BETWEEN 1 AND 3
), z AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * met >= 80 * (x.n + y.n - met)
), r(id, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b
), c AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, c.root AS component_id, d.doc_id = c.root AS kept
FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id
"""

TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""

DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), x AS (
  SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (SELECT lang, term, count(*) AS n FROM x GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
vocab AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM x SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (
  SELECT u.lang, u.source, coalesce(sum(c.n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) u LEFT JOIN c ON c.lang = u.lang AND c.source = u.source GROUP BY u.lang, u.source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // CAST(g.total + v.v AS HUGEINT) AS p,
         1 + (CAST(1000000000 AS HUGEINT) * (k.n + 1)) // CAST(v.total + v.v AS HUGEINT) AS q
  FROM g JOIN kept k ON k.lang = g.lang JOIN vocab v ON v.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q
)
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r
) WHERE part = 'pair' OR rank <= 200
"""

AUDIT_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents
), f AS (
  SELECT part, CAST(len(words) < 200 AS INTEGER) AS a, CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INTEGER) AS b,
         CAST(100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t) AS INTEGER) AS c,
         CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) AS d, CAST(coalesce(doc_id > least, FALSE) AS INTEGER) AS e,
         coalesce(q, 0) AS q, coalesce(x, 0) AS x
  FROM w LEFT JOIN (
    SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS q, max(CAST(toxic = 1 AS INTEGER)) AS x FROM labels GROUP BY doc_id
  ) USING (doc_id)
), m AS (SELECT part, a, b, c, d, e, a + b + c + d + e AS size, count(*) AS n, sum(q) AS good, sum(x) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
o AS (
  SELECT v.l || w.l || x.l || y.l || z.l AS filter_order FROM l v, l w, l x, l y, l z
  WHERE len(list_distinct([v.l, w.l, x.l, y.l, z.l])) = 5
), s AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[:step - 1] AS before FROM o, range(1, 6) r(step)),
j AS (
  SELECT m.*, s.*, CASE own WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fails,
         a * CAST(contains(before, 'A') AS INTEGER) + b * CAST(contains(before, 'B') AS INTEGER) + c * CAST(contains(before, 'C') AS INTEGER)
         + d * CAST(contains(before, 'D') AS INTEGER) + e * CAST(contains(before, 'E') AS INTEGER) AS earlier
  FROM m, s
), k AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, own,
         CAST(sum(CASE WHEN earlier = 0 AND fails = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN earlier = 0 AND fails = 1 THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN earlier > 0 AND fails = 1 THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN size = 1 AND fails = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN earlier = 0 AND fails = 1 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN earlier = 0 AND fails = 1 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM j GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM k
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_repeated_bytes, op3_near_duplicates, op4_top_k, op5_lm_score, op6_byte_bpe, op7_paragraphs, op8_token_counts, op9_decontamination, op10_language_id, op11_nearest_neighbours, op12_source_divergence, op13_filter_interactions)}


def oracle_sql() -> dict[str, str]:
    return {"op3_near_duplicates": NEAR_SQL, "op4_top_k": TOP_K_SQL, "op12_source_divergence": DIVERGENCE_SQL, "op13_filter_interactions": AUDIT_SQL}
