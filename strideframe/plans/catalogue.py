"""Registered queries over the shared tables and their SQL.

The sensor view takes events as continuous signals: a trial is a user, a sample an
event; batches of channels come from lineitem, vectors and classes from embeddings.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import augment, metrics, network, quant, scoring, signal, splits, stats, training, windows
from ..shipping import ship
from ..sources import corpora, reports, splits_sink
from ..sources.firmware import HOST_ONLY, RESOLVER_METHODS, SLOW

WIN, STRIDE = 16, 8
HOP = 1.28
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SAMPLES = """x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k2, event_type FROM events)"""
WINDOWS = SAMPLES + """, w AS (SELECT user_id, i, value, k2, unnest(generate_series(greatest(CAST(ceil((i - 15) / 8.0) AS BIGINT), 0), CAST(floor(i / 8.0) AS BIGINT))) AS k FROM x)"""
PRED = """p AS (SELECT vec_id, label, list_transform(embedding[1:10], lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings),
 q AS (SELECT vec_id, label, e, list_position(e, list_max(e)) - 1 AS a, list_position(list_transform(e, lambda v: round(v * 4)), list_max(list_transform(e, lambda v: round(v * 4)))) - 1 AS b FROM p)"""


def query(sql: str | None = None):
    def register(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k2"), "event_type")
    return windows.indexed(e, "user_id", "ts", "event_id")


def _round(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding_windows(samples(spark, sf_dir), "user_id", WIN, STRIDE, windows.mean_in_order(F.abs("value")).alias("energy"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows a person has above the energy threshold of 60 alarms an hour."""
    e = _energies(spark, sf_dir)
    cut = metrics.percentiles(e, "energy", [1 - metrics.flag_rate_for_far(60, HOP)]).select(F.col("p")[0].alias("threshold"))
    flagged = e.crossJoin(F.broadcast(cut)).groupBy("user_id").agg(F.count("*").alias("n_windows"), F.sum((F.col("energy") > F.col("threshold")).cast("long")).alias("n_alarms"))
    return flagged.select(F.concat(F.lit("ev_"), F.col("user_id").cast("string")).alias("subject"), "n_windows", "n_alarms")


@query(f"WITH {WINDOWS}, e AS (SELECT user_id, k, avg(abs(value)) AS energy FROM w GROUP BY 1, 2 HAVING count(*) = 16), t AS (SELECT quantile_cont(energy, 1 - 60 / 2812.5) AS t FROM e) SELECT 'ev_' || user_id AS subject, count(*) AS n_windows, CAST(sum(CASE WHEN energy > t THEN 1 ELSE 0 END) AS BIGINT) AS n_alarms FROM e, t GROUP BY user_id")
def alarm_windows(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(f"WITH {SAMPLES} SELECT user_id, CAST(i AS BIGINT) AS i, value FROM x")
def sensor_index(spark, sf_dir):
    return samples(spark, sf_dir).select("user_id", "i", "value")


@query("SELECT user_id, count(*) AS n, CAST(CASE WHEN count(*) < 16 THEN 0 ELSE (count(*) - 16) // 8 + 1 END AS BIGINT) AS m FROM events GROUP BY user_id")
def window_counts(spark, sf_dir):
    n = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.withColumn("m", windows.n_windows(F.col("n"), WIN, STRIDE))


@query('WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 16), b AS (SELECT user_id, unnest(generate_series(0, (n - 16) // 8)) AS k FROM n) SELECT user_id, CAST(k AS BIGINT) AS k, CAST(k * 8 AS BIGINT) AS "start", CAST(k * 8 + 16 AS BIGINT) AS "end" FROM b')
def window_bounds(spark, sf_dir):
    n = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return windows.window_bounds(n, "n", WIN, STRIDE).drop("n")


@query(f"WITH {WINDOWS} SELECT user_id, CAST(k AS BIGINT) AS k, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, min(value) AS lo, max(value) AS hi, arg_min(value, i) AS first_value, arg_max(value, i) AS last_value FROM w GROUP BY user_id, k HAVING count(*) = 16")
def sliding_window_features(spark, sf_dir):
    aggs = [F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.min_by("value", "i").alias("first_value"), F.max_by("value", "i").alias("last_value")]
    return _round(windows.sliding_windows(samples(spark, sf_dir), "user_id", WIN, STRIDE, *aggs), "mean", "sd")


@query(f"WITH {WINDOWS} SELECT user_id, CAST(k AS BIGINT) AS k, round(avg(sqrt(value * value + k2 * k2)), 6) AS energy FROM w GROUP BY user_id, k HAVING count(*) = 16")
def motion_energy(spark, sf_dir):
    return _round(windows.sliding_windows(samples(spark, sf_dir), "user_id", WIN, STRIDE, F.avg(stats.magnitude(F.col("value"), F.col("k2"))).alias("energy")), "energy")


@query(f"WITH {SAMPLES} SELECT user_id, CAST(min(i) AS BIGINT) AS impact FROM (SELECT *, max(abs(value)) OVER (PARTITION BY user_id) AS top FROM x) WHERE abs(value) = top GROUP BY user_id")
def impact_index(spark, sf_dir):
    return stats.impact_index(samples(spark, sf_dir), "user_id", F.abs("value"))


OVERLAP = SAMPLES + """, imp AS (SELECT user_id, min(i) AS impact, max(n) AS n FROM (SELECT *, max(abs(value)) OVER (PARTITION BY user_id) AS top, count(*) OVER (PARTITION BY user_id) AS n FROM x) WHERE abs(value) = top GROUP BY user_id HAVING max(n) >= 16),
 b AS (SELECT user_id, impact - 2 AS s, impact + 3 AS e, unnest(generate_series(0, (n - 16) // 8)) AS k FROM imp),
 o AS (SELECT user_id, k, CAST(greatest(least(k * 8 + 16, e) - greatest(k * 8, s), 0) AS DOUBLE) AS shared FROM b)"""


def _overlaps(spark, sf_dir, relative_to):
    x = samples(spark, sf_dir)
    n = x.groupBy("user_id").agg(F.count("*").alias("n"))
    b = windows.window_bounds(n, "n", WIN, STRIDE).join(stats.impact_index(x, "user_id", F.abs("value")), "user_id")
    f = windows.overlap_fraction(F.col("start"), F.col("end"), F.col("impact") - 2, F.col("impact") + 3, relative_to)
    return b.select("user_id", "k", f.alias("fraction"))


@query(f"WITH {OVERLAP} SELECT user_id, CAST(k AS BIGINT) AS k, shared / 16 AS fraction FROM o")
def overlap_fraction_window(spark, sf_dir):
    return _overlaps(spark, sf_dir, "window")


@query(f"WITH {OVERLAP} SELECT user_id, CAST(k AS BIGINT) AS k, shared / 5 AS fraction FROM o")
def overlap_fraction_event(spark, sf_dir):
    return _overlaps(spark, sf_dir, "event")


@query(f"WITH {OVERLAP} SELECT user_id, CAST(k AS BIGINT) AS k, CAST(CASE WHEN shared / 5 <= 0 THEN 0 WHEN shared / 5 >= 0.8 THEN 1 ELSE -1 END AS INTEGER) AS label FROM o")
def label_by_overlap(spark, sf_dir):
    return _overlaps(spark, sf_dir, "event").select("user_id", "k", windows.label_by_overlap(F.col("fraction")).alias("label"))


SPANS = SAMPLES + """, n AS (SELECT user_id, count(*) AS n FROM x GROUP BY user_id HAVING count(*) >= 16),
 b AS (SELECT user_id, k, k * 8 AS s, k * 8 + 16 AS e FROM (SELECT user_id, unnest(generate_series(0, (n - 16) // 8)) AS k FROM n)),
 v AS (SELECT user_id, i AS impact, i - 2 AS vs, i + 3 + CAST(k2 AS BIGINT) % 20 AS ve FROM x WHERE event_type = 'error'),
 o AS (SELECT b.user_id, k, impact, least(e, ve) - greatest(s, vs) AS shared, ve - vs AS width FROM b JOIN v ON b.user_id = v.user_id AND s < ve AND vs < e)"""


def _event_spans(spark, sf_dir):
    """(windows, spans): every window of every user, and a span of 5 to 24 samples about each of a user's errors."""
    x = samples(spark, sf_dir)
    w = windows.window_bounds(x.groupBy("user_id").agg(F.count("*").alias("n")), "n", WIN, STRIDE).drop("n")
    v = x.where("event_type = 'error'").select("user_id", F.col("i").alias("impact"), (F.col("i") - 2).alias("ev_start"), (F.col("i") + 3 + F.col("k2").cast("long") % 20).alias("ev_end"))
    return w, v


@query(f"WITH {SPANS} SELECT user_id, CAST(k AS BIGINT) AS k, CAST(impact AS BIGINT) AS impact, CAST(shared AS BIGINT) AS shared FROM o")
def window_span_pairs(spark, sf_dir):
    """Every pair of a window and an event span that have samples in common."""
    w, v = _event_spans(spark, sf_dir)
    shared = F.least("end", "ev_end") - F.greatest("start", "ev_start")
    return windows.interval_pairs(w, v, "user_id", WIN).select("user_id", "k", "impact", shared.alias("shared"))


@query(f"""WITH {SPANS}, m AS (SELECT user_id, k, count(*) AS n, max(CAST(shared AS DOUBLE) / width) AS f FROM o GROUP BY 1, 2)
 SELECT b.user_id, CAST(b.k AS BIGINT) AS k, coalesce(n, 0) AS n_spans, round(coalesce(f, 0), 6) AS fraction, CAST(CASE WHEN coalesce(f, 0) <= 0 THEN 0 WHEN f >= 0.8 THEN 1 ELSE -1 END AS INTEGER) AS label FROM b LEFT JOIN m USING (user_id, k)""")
def label_by_event_spans(spark, sf_dir):
    """The label of every window against all event spans of its user."""
    w, v = _event_spans(spark, sf_dir)
    return _round(windows.label_by_spans(w, v, "user_id", cell=WIN), "fraction")


@query(f"WITH {SAMPLES}, n AS (SELECT user_id, i, value AS b, coalesce(lag(value) OVER u, value) AS a, coalesce(lead(value) OVER u, value) AS c FROM x WINDOW u AS (PARTITION BY user_id ORDER BY i)) SELECT user_id, CAST(i AS BIGINT) AS i, greatest(least(a, b), least(greatest(a, b), c)) AS median FROM n")
def median3_denoise(spark, sf_dir):
    return signal.median3(samples(spark, sf_dir), "user_id", "value", "median").select("user_id", "i", "median")


@query("SELECT l_orderkey, l_linenumber, l_quantity * 32 / 8192 AS g FROM lineitem")
def adc_to_units(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", arrays.adc_to_units(F.col("l_quantity"), 16, 13).alias("g"))


CH = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
MELT = "m AS (UNPIVOT lineitem ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME channel VALUE v)"


@query(f"WITH {MELT} SELECT channel, round(avg(v), 6) AS mean, round(stddev_pop(v) + 1e-6, 6) AS std FROM m GROUP BY channel")
def channel_stats(spark, sf_dir):
    return _round(stats.channel_stats(_table(spark, sf_dir, "lineitem"), CH), "mean", "std")


@query("WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) + 1e-6 AS s FROM lineitem) SELECT l_orderkey, l_linenumber, round((l_quantity - m) / s, 6) AS z FROM lineitem, s")
def normalize(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("z"))
    s = stats.channel_stats(rows, ["z"]).first()  # frozen statistics: one row
    return _round(stats.normalise(rows, {"z": (s["mean"], s["std"])}), "z")


@query(f"WITH {MELT}, s AS (SELECT l_returnflag, channel, stddev_pop(v) AS sd FROM m GROUP BY 1, 2) SELECT channel, round(max(sd) / greatest(min(sd), 1e-9), 6) AS ratio, max(sd) / greatest(min(sd), 1e-9) < 3 AS ok FROM s GROUP BY channel")
def harmonization_gate(spark, sf_dir):
    return _round(stats.harmonisation(_table(spark, sf_dir, "lineitem"), "l_returnflag", CH), "ratio")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS subjects FROM events GROUP BY event_type")
def summary_counts(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("subjects"))


@query("""SELECT CASE WHEN grouping(l_returnflag) = 0 THEN 'l_returnflag' WHEN grouping(l_linestatus) = 0 THEN 'l_linestatus' WHEN grouping(l_linenumber) = 0 THEN 'l_linenumber' ELSE 'all' END AS what,
 coalesce(l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR), '') AS value, count(*) AS n, count(DISTINCT l_suppkey) AS subjects FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus), (l_linenumber))""")
def corpus_counts(spark, sf_dir):
    """Rows and suppliers in all and by each tag, from one aggregation."""
    return corpora.counts(_table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_linenumber", subject="l_suppkey").fillna("", ["value"])


@query("""WITH m AS (SELECT user_id % 40 AS g, event_type, stddev_pop(value) AS v FROM events WHERE user_id % 40 <> 7 OR event_type <> 'view' GROUP BY 1, 2)
 SELECT 'run ' || g AS run, """ + ", ".join(f"coalesce(max(CASE WHEN event_type = '{m}' THEN format('{{:.4f}}', v) END), '-') AS {m}" for m in ("click", "error", "purchase", "signup", "view")) + " FROM m GROUP BY g")
def run_comparison(spark, sf_dir):
    """Manifests of runs (groups of users) whose metrics are the deviation of each event type's values; one lacks one."""
    g = (F.col("user_id") % 40).alias("g")
    e = _table(spark, sf_dir, "events").select(g, "event_type", "value").where("g <> 7 OR event_type <> 'view'")
    named = F.map_from_entries(F.collect_list(F.struct("event_type", "v")))
    runs = e.groupBy("g", "event_type").agg(F.stddev_pop("value").alias("v")).groupBy("g").agg(named.alias("metrics"))
    docs = runs.select(F.parse_json(F.to_json(F.struct(F.concat(F.lit("run "), "g").alias("name"), "metrics"))).alias("doc"))
    return reports.compare(docs, ["click", "error", "purchase", "signup", "view"])


SPLIT = """u AS (SELECT DISTINCT user_id FROM events), r AS (SELECT user_id, row_number() OVER (ORDER BY md5('42|' || user_id), user_id) AS r, count(*) OVER () AS n FROM u),
 c AS (SELECT *, least(greatest(1, round_even(0.7 * n, 0)), n - 2) AS tr FROM r), d AS (SELECT *, least(greatest(1, round_even(0.15 * n, 0)), n - tr - 1) AS va FROM c),
 s AS (SELECT user_id, CASE WHEN r <= tr THEN 'train' WHEN r <= tr + va THEN 'val' ELSE 'test' END AS split FROM d)"""


@query(f"WITH {SPLIT} SELECT user_id, split FROM s")
def subject_split_hash(spark, sf_dir):
    return splits.subject_split(_table(spark, sf_dir, "events"), "user_id")


@query(f"WITH {SPLIT} SELECT split, count(DISTINCT user_id) AS subjects, count(*) AS windows FROM events JOIN s USING (user_id) GROUP BY split")
def split_describe(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("user_id")
    return splits.describe(e, splits.subject_split(e, "user_id"), "user_id")


@query(f"""WITH {SPLIT}, e AS (SELECT split, user_id, event_type, value FROM events JOIN s USING (user_id)), t AS (SELECT avg(value) AS m, stddev_pop(value) + 1e-6 AS d FROM e WHERE split = 'train'),
 k AS (SELECT split, count(DISTINCT event_type) AS classes FROM e GROUP BY split)
 SELECT split, count(*) AS n, count(DISTINCT user_id) AS subjects, any_value(classes) AS classes, round(any_value(m), 6) AS mean, round(any_value(d), 6) AS std, round(avg((value - m) / d), 6) AS z FROM e JOIN k USING (split), t GROUP BY split""")
def split_sink(spark, sf_dir):
    """Events written by part with their statistics, twice and one part again, then read back and normalised."""
    e = _table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    rows, home = e.join(splits.subject_split(e, "user_id"), "user_id"), f"{_folder(spark)}-split"
    for again in (rows, rows, rows.where("split = 'val'")):
        splits_sink.write_split(again, home, ["value"], "event_type")
    mean, std = splits_sink.read_statistics(spark, home)["value"]
    z = stats.normalised(F.col("value"), mean, std)
    found = splits_sink.read_split(spark, home).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("subjects"), F.avg(z).alias("z"))
    classes = spark.read.parquet(f"{home}/classes").groupBy("split").agg(F.count("*").alias("classes"))
    return _round(found.join(classes, "split").withColumns({"mean": F.lit(mean), "std": F.lit(std)}), "mean", "std", "z")


@query("SELECT user_id, count(DISTINCT event_type) AS splits FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def split_leaks(spark, sf_dir):
    return splits.leaks(_table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("split")), "user_id")


@query("SELECT user_id AS held, (SELECT count(*) FROM events) - count(*) AS n_train, count(*) AS n_test FROM events GROUP BY user_id")
def loso_folds(spark, sf_dir):
    return splits.loso_folds(_table(spark, sf_dir, "events"), "user_id")


@query("""WITH u AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag <> 'A'), r AS (SELECT l_suppkey, row_number() OVER (ORDER BY md5('42|' || l_suppkey), l_suppkey) AS r, count(*) OVER () AS n FROM u),
 l AS (SELECT l_returnflag, CASE WHEN l_returnflag = 'A' THEN 'test' WHEN r <= least(greatest(1, round_even(0.15 * n, 0)), n - 1) THEN 'val' ELSE 'train' END AS split FROM lineitem LEFT JOIN r USING (l_suppkey)) SELECT l_returnflag, split, count(*) AS n FROM l GROUP BY 1, 2""")
def leave_dataset_out(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag")
    return splits.leave_dataset_out(rows, "l_returnflag", "A", "l_suppkey").groupBy("l_returnflag", "split").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id), vec_id) AS r, greatest(1, 128 // (SELECT count(DISTINCT label) FROM embeddings)) AS per FROM embeddings)
 SELECT vec_id, label FROM r WHERE r <= per ORDER BY md5('42|' || vec_id), vec_id LIMIT 128""")
def stratified_sample(spark, sf_dir):
    return splits.stratified_sample(_table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", "label", 128)


@query("SELECT vec_id FROM embeddings ORDER BY md5('42|' || vec_id), vec_id LIMIT 64")
def uniform_sample(spark, sf_dir):
    return splits.uniform_sample(_table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 64)


WEIGHTS = "s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), w AS (SELECT label, sum(n) OVER () / (count(*) OVER () * n) AS w FROM s)"


@query(f"WITH {WEIGHTS} SELECT CAST(c AS INTEGER) AS label, round(coalesce(w / (SELECT avg(w) FROM w), 0), 6) AS weight FROM range(12) t(c) LEFT JOIN w ON label = c")
def class_weights(spark, sf_dir):
    return _round(metrics.class_weights(_table(spark, sf_dir, "embeddings"), "label", 12), "weight")


@query(f"WITH {WEIGHTS} SELECT CAST(c AS INTEGER) AS label, round(coalesce(w, 0), 6) AS weight FROM range(12) t(c) LEFT JOIN w ON label = c")
def class_weights_legacy(spark, sf_dir):
    return _round(metrics.class_weights(_table(spark, sf_dir, "embeddings"), "label", 12, legacy=True), "weight")


@query("SELECT c * (SELECT count(*) FROM embeddings) + vec_id AS vec_id, CAST(c AS INTEGER) AS copy, label FROM embeddings, range(3) t(c)")
def expand_copies(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return splits.expand(rows, 2, "vec_id", rows.count())


def _vec(spark, sf_dir, n):
    e = _table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.transform(F.slice("embedding", 1, n), lambda v: v.cast("double")).alias("e"))


@query("WITH p AS (SELECT vec_id, list_transform(embedding[1:3], lambda v: CAST(v AS DOUBLE)) AS e, (vec_id % 360) * pi() / 180 AS a FROM embeddings) SELECT vec_id, round(cos(a) * e[1] - sin(a) * e[2], 6) AS x, round(sin(a) * e[1] + cos(a) * e[2], 6) AS y, round(e[3], 6) AS z FROM p")
def rotate_triads(spark, sf_dir):
    v = _vec(spark, sf_dir, 3)
    r = arrays.rotation(F.lit(0.0), F.lit(0.0), F.lit(1.0), (F.col("vec_id") % 360) * F.pi() / 180)
    x, y, z = arrays.rotate(r, *[F.col("e")[i] for i in range(3)])
    return _round(v.select("vec_id", x.alias("x"), y.alias("y"), z.alias("z")), "x", "y", "z")


@query("""WITH p AS (SELECT vec_id, list_transform(embedding[1:16], lambda v: CAST(v AS DOUBLE)) AS e, 0.85 + (vec_id % 31) / 100.0 AS r FROM embeddings),
 s AS (SELECT vec_id, e, t, least(greatest((t - 7.5) * r + 7.5, 0), 15) AS src FROM p, range(16) g(t))
 SELECT vec_id, CAST(t AS INTEGER) AS t, round(e[CAST(floor(src) AS INTEGER) + 1] + (e[least(CAST(floor(src) AS INTEGER) + 1, 15) + 1] - e[CAST(floor(src) AS INTEGER) + 1]) * (src - floor(src)), 5) AS v FROM s""")
def time_warp(spark, sf_dir):
    ratio = F.lit(0.85) + (F.col("vec_id") % 31) / F.lit(100.0)
    v = _vec(spark, sf_dir, 16).withColumn("w", arrays.time_warp(F.col("e"), 16, ratio))
    return _round(v.select("vec_id", F.posexplode("w").alias("t", "v")), "v", digits=5)


@query("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) * (1 + (vec_id % 7) / 10.0), 6) AS a, round(CAST(embedding[2] AS DOUBLE) * (1 + (vec_id % 5) / 10.0), 6) AS b FROM embeddings")
def scale_channels(spark, sf_dir):
    gains = F.array(1 + (F.col("vec_id") % 7) / F.lit(10.0), 1 + (F.col("vec_id") % 5) / F.lit(10.0))
    v = _vec(spark, sf_dir, 2).withColumn("s", arrays.scale(F.col("e"), gains))
    return _round(v.select("vec_id", F.col("s")[0].alias("a"), F.col("s")[1].alias("b")), "a", "b")


@query("""WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, (vec_id % 3) / 10.0 < 0.15 AS da, (vec_id % 4) / 10.0 < 0.15 AS db, vec_id % 2 AS keep FROM embeddings)
 SELECT vec_id, round(CASE WHEN da AND NOT (db AND keep = 0) THEN 0 ELSE a END, 6) AS a, round(CASE WHEN db AND NOT (da AND keep = 1) THEN 0 ELSE b END, 6) AS b FROM p""")
def channel_dropout(spark, sf_dir):
    draws = F.array((F.col("vec_id") % 3) / F.lit(10.0), (F.col("vec_id") % 4) / F.lit(10.0))
    v = _vec(spark, sf_dir, 2).withColumn("s", arrays.channel_dropout(F.col("e"), draws, 0.15, (F.col("vec_id") % 2).cast("int")))
    return _round(v.select("vec_id", (F.col("s")[0] + 0.0).alias("a"), (F.col("s")[1] + 0.0).alias("b")), "a", "b")


SOFT = "p AS (SELECT vec_id, label, list_transform(embedding[1:6], lambda v: exp(CAST(v AS DOUBLE))) AS e FROM embeddings), q AS (SELECT vec_id, label, list_transform(e, lambda v: v / list_sum(e)) AS p FROM p)"


@query(f"WITH {SOFT} SELECT vec_id, round(-list_sum(list_transform(p, lambda v: v * ln(v))) / ln(6), 6) AS entropy FROM q")
def entropy(spark, sf_dir):
    v = _vec(spark, sf_dir, 6).withColumn("p", arrays.softmax(F.col("e")))
    return _round(v.select("vec_id", arrays.entropy(F.col("p"), 6).alias("entropy")), "entropy")


@query("WITH e AS (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(covar_samp(a.x, b.x) + CASE WHEN a.i = b.i THEN 0.001 ELSE 0 END, 6) AS cov FROM e a JOIN e b USING (vec_id) GROUP BY a.i, b.i")
def covariance_pairs(spark, sf_dir):
    return _round(scoring.covariance_pairs(_table(spark, sf_dir, "embeddings"), "embedding"), "cov")


@query("""WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), s AS (SELECT avg(x) AS mx, avg(y) AS my, covar_samp(x, x) + 0.001 AS a, covar_samp(x, y) AS b, covar_samp(y, y) + 0.001 AS c FROM p)
 SELECT vec_id, round(sqrt((c * (x - mx) ** 2 - 2 * b * (x - mx) * (y - my) + a * (y - my) ** 2) / (a * c - b * b)), 6) AS distance FROM p, s""")
def mahalanobis_2d(spark, sf_dir):
    v = _vec(spark, sf_dir, 2)
    m = scoring.Mahalanobis.fit(v, "e")
    return _round(v.select("vec_id", arrays.quadratic_form(F.col("e"), m.mean.tolist(), m.precision.tolist()).alias("distance")), "distance")


@query()
def mahalanobis_64d(spark, sf_dir):
    v = _vec(spark, sf_dir, 64)
    return scoring.Mahalanobis.fit(v, "e").score(v, "e").select("vec_id", F.round("distance", 6).alias("distance"))


@query("SELECT round(quantile_cont(value, 0.99), 6) AS threshold FROM events")
def percentile_threshold(spark, sf_dir):
    return _round(metrics.percentile_threshold(_table(spark, sf_dir, "events"), "value", 99), "threshold")


FARS = "f AS (SELECT unnest([6.0, 30.0, 60.0, 300.0])::DOUBLE AS far)"


@query(f"WITH {FARS}, t AS (SELECT far, (SELECT quantile_cont(value, 1 - 6 / 2812.5) FROM events WHERE event_type <> 'error') AS t6 FROM f), r AS (SELECT far, CASE far WHEN 6 THEN t6 WHEN 30 THEN (SELECT quantile_cont(value, 1 - 30 / 2812.5) FROM events WHERE event_type <> 'error') WHEN 60 THEN (SELECT quantile_cont(value, 1 - 60 / 2812.5) FROM events WHERE event_type <> 'error') ELSE (SELECT quantile_cont(value, 1 - 300 / 2812.5) FROM events WHERE event_type <> 'error') END AS t FROM t) SELECT far AS target_far, round(t, 6) AS threshold, round(avg(CASE WHEN value > t THEN 1.0 ELSE 0 END) FILTER (event_type = 'error'), 6) AS recall, round(avg(CASE WHEN value > t THEN 1.0 ELSE 0 END) FILTER (event_type <> 'error') * 2812.5, 6) AS achieved_far FROM events, r GROUP BY far, t")
def recall_at_far(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("value", (F.col("event_type") == "error").alias("is_pos"))
    return _round(metrics.recall_at_far(e, "value", "is_pos", [6.0, 30.0, 60.0, 300.0], HOP), "threshold", "recall", "achieved_far")


def _scored(spark, sf_dir):
    return _table(spark, sf_dir, "events").select(F.floor("value").alias("s"), (F.col("event_type") == "error").alias("is_pos"))


@query("""WITH s AS (SELECT floor(value) AS s, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS p, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS n FROM events GROUP BY 1),
 c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s) SELECT round(CAST(sum(p * (below + 0.5 * n)) AS DOUBLE) / (sum(p) * sum(n)), 9) AS auroc FROM c""")
def auroc(spark, sf_dir):
    return _round(metrics.auroc(_scored(spark, sf_dir), "s", "is_pos"), "auroc", digits=9)


@query("""WITH r AS (SELECT event_type = 'error' AS p, row_number() OVER (ORDER BY floor(value) DESC, event_type = 'error', event_id) AS rk FROM events), t AS (SELECT p, rk, sum(CAST(p AS INTEGER)) OVER (ORDER BY rk) AS tp FROM r) SELECT round(avg(tp / rk), 9) AS auprc FROM t WHERE p""")
def auprc(spark, sf_dir):
    return _round(metrics.auprc(_scored(spark, sf_dir), "s", "is_pos"), "auprc", digits=9)


def _predicted(spark, sf_dir):
    v = _vec(spark, sf_dir, 10)
    coarse = F.transform("e", lambda x: F.round(x * 4))
    return v.select("vec_id", "label", metrics.argmax(F.col("e")).alias("a"), metrics.argmax(coarse).alias("b"))


@query(f"WITH {PRED} SELECT label, CAST(a AS INTEGER) AS a, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS share FROM q GROUP BY label, a")
def confusion_matrix(spark, sf_dir):
    return _round(metrics.confusion(_predicted(spark, sf_dir), "label", "a"), "share")


PER = "t AS (SELECT label AS l, count(*) AS t, sum(CAST(label = a AS INTEGER)) AS h FROM q GROUP BY 1), d AS (SELECT a AS l, count(*) AS p FROM q GROUP BY 1), c AS (SELECT coalesce(t.l, d.l) AS l, coalesce(t, 0) AS t, coalesce(p, 0) AS p, coalesce(h, 0) AS h FROM t FULL JOIN d ON t.l = d.l)"


@query(f"WITH {PRED}, {PER} SELECT CAST(l AS INTEGER) AS label, CAST(t AS BIGINT) AS support, round(CASE WHEN p > 0 THEN h / p ELSE 0 END, 6) AS precision, round(CASE WHEN t > 0 THEN h / t ELSE 0 END, 6) AS recall, round(2 * h / (t + p), 6) AS f1 FROM c")
def classification_report(spark, sf_dir):
    return _round(metrics.per_class(_predicted(spark, sf_dir), "label", "a"), "precision", "recall", "f1")


@query(f"WITH {PRED}, {PER} SELECT round(avg(2 * h / (t + p)), 6) AS macro_f1 FROM c WHERE t > 0")
def macro_f1_present(spark, sf_dir):
    return _round(metrics.macro_f1(_predicted(spark, sf_dir), "label", "a", present_only=True), "macro_f1")


@query(f"WITH {PRED}, {PER} SELECT round(avg(2 * h / (t + p)), 6) AS macro_f1 FROM c")
def macro_f1_union(spark, sf_dir):
    return _round(metrics.macro_f1(_predicted(spark, sf_dir), "label", "a"), "macro_f1")


@query(f"WITH {PRED} SELECT round(avg(CAST(a = label AS INTEGER)), 6) AS float_accuracy, round(avg(CAST(b = label AS INTEGER)), 6) AS int8_accuracy, round(avg(CAST(b = label AS INTEGER)) - avg(CAST(a = label AS INTEGER)), 6) AS delta, round(avg(CAST(a = b AS INTEGER)), 6) AS agreement FROM q")
def accuracy_delta(spark, sf_dir):
    return _round(metrics.agreement(_predicted(spark, sf_dir), "label", "a", "b"), "float_accuracy", "int8_accuracy", "delta", "agreement")


@query(f"WITH {SOFT} SELECT round(avg(-ln(p[label + 1])), 6) AS loss FROM q WHERE label < 6")
def masked_ce(spark, sf_dir):
    v = _vec(spark, sf_dir, 6).select(arrays.softmax(F.col("e")).alias("p"), F.when(F.col("label") < 6, F.col("label")).otherwise(-1).alias("y"))
    return _round(metrics.masked_ce(v, "p", "y"), "loss")


@query("WITH p AS (SELECT 1 / (1 + exp(-CAST(embedding[1] AS DOUBLE))) AS p, label % 3 - 1 AS y FROM embeddings) SELECT round(sum((1 + 2 * y) * -(y * ln(p) + (1 - y) * ln(1 - p))) / sum(1 + 2 * y), 6) AS loss FROM p WHERE y >= 0")
def masked_bce(spark, sf_dir):
    v = _vec(spark, sf_dir, 1).select((1 / (1 + F.exp(-F.col("e")[0]))).alias("p"), (F.col("label") % 3 - 1).alias("y"))
    return _round(metrics.masked_bce(v, "p", "y", 3.0), "loss")


@query("WITH v AS (SELECT vec_id, unnest(range(64)) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), q AS (SELECT *, CAST(least(greatest(round_even(x / 0.03125 + 3, 0), -128), 127) AS INTEGER) AS q FROM v) SELECT vec_id, CAST(d AS INTEGER) AS d, q, (q - 3) * 0.03125::DOUBLE AS back FROM q")
def quantize_dequantize(spark, sf_dir):
    v = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("d", "x"))
    q = v.select("vec_id", "d", arrays.quantise(F.col("x").cast("double"), 0.03125, 3).alias("q"))
    return q.withColumn("back", arrays.dequantise(F.col("q"), 0.03125, 3))


LONG = "v AS (SELECT label, unnest(range(64)) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


def _long(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("d", "f")).select("label", "d", F.col("f").cast("double").alias("x"))


@query(f"WITH {LONG}, r AS (SELECT CAST(d AS INTEGER) AS d, quantile_cont(abs(x), 0.5) AS p50, quantile_cont(abs(x), 0.99) AS p99, quantile_cont(abs(x), 0.999) AS p999, max(abs(x)) AS mx FROM v GROUP BY d) SELECT d, round(p50, 6) AS p50, round(p99, 6) AS p99, round(p999, 6) AS p999, round(mx, 6) AS max, round(mx / p999, 6) AS ratio, round(127 * p99 / mx, 6) AS levels, 127 * p99 / mx < 32 AS flagged FROM r")
def activation_ranges(spark, sf_dir):
    return _round(quant.activation_ranges(_long(spark, sf_dir), "d", "x"), "p50", "p99", "p999", "max", "ratio", "levels")


@query(f"WITH {LONG}, c AS (SELECT label, d, greatest(max(abs(x)), 1e-12) AS t, quantile_cont(abs(x), 0.99) AS p FROM v GROUP BY 1, 2) SELECT label, round(max(t) / min(t), 6) AS spread, round(min(127 * p / t), 6) AS in_channel FROM c GROUP BY label")
def weight_ranges(spark, sf_dir):
    return _round(quant.weight_ranges(_long(spark, sf_dir), "label", "d", "x"), "spread", "in_channel")


@query(f"WITH {WINDOWS}, e AS (SELECT user_id % 3 AS g, avg(abs(value)) AS energy FROM w GROUP BY user_id, k HAVING count(*) = 16) SELECT g, round(quantile_cont(energy, 0.25), 6) AS q1, round(quantile_cont(energy, 0.5), 6) AS q2, round(quantile_cont(energy, 0.75), 6) AS q3 FROM e GROUP BY g")
def boxplot_energy(spark, sf_dir):
    e = metrics.percentiles(_energies(spark, sf_dir).withColumn("g", F.col("user_id") % 3), "energy", [0.25, 0.5, 0.75], "g").withColumnRenamed("p", "q")
    return _round(e.select("g", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3")), "q1", "q2", "q3")


@query("WITH r AS (SELECT event_type, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM events GROUP BY 1) SELECT event_type, CAST(least(floor((value - lo) / (hi - lo) * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM events JOIN r USING (event_type) WHERE value BETWEEN lo AND hi GROUP BY 1, 2")
def histogram_channels(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_type", "value")
    r = metrics.percentiles(e, "value", [0.005, 0.995], "event_type").withColumnRenamed("p", "q")
    j = e.join(F.broadcast(r), "event_type").where(F.col("value").between(F.col("q")[0], F.col("q")[1]))  # one row an event type
    return j.groupBy("event_type", F.least(F.floor((F.col("value") - F.col("q")[0]) / (F.col("q")[1] - F.col("q")[0]) * 20), F.lit(19)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query(f"""WITH {WINDOWS}, e AS (SELECT user_id % 3 AS g, avg(abs(value)) AS v FROM w GROUP BY user_id, k HAVING count(*) = 16),
 q AS (SELECT g, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM e GROUP BY g),
 held AS (SELECT *, v BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 AS inside FROM e JOIN q USING (g))
 SELECT g, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, round(min(v) FILTER (inside), 6) AS low, round(max(v) FILTER (inside), 6) AS high, count(*) AS n, count(*) FILTER (NOT inside) AS n_outside FROM held GROUP BY g, q1, q2, q3""")
def box_whiskers(spark, sf_dir):
    return _round(metrics.box(_energies(spark, sf_dir).withColumn("g", F.col("user_id") % 3), "energy", "g"), "q1", "q2", "q3", "low", "high")


@query("""WITH r AS (SELECT event_type, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM events GROUP BY 1),
 b AS (SELECT event_type, CAST(least(floor((value - lo) / (hi - lo) * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM events JOIN r USING (event_type) WHERE value BETWEEN lo AND hi GROUP BY 1, 2),
 t AS (SELECT event_type, sum(n) AS total FROM b GROUP BY 1), a AS (SELECT *, CAST(unnest(range(20)) AS INTEGER) AS bin FROM r)
 SELECT event_type, bin, round(lo + bin * (hi - lo) / 20, 6) AS "left", coalesce(n, 0) AS n, round(coalesce(n, 0) * 20 / (total * (hi - lo)), 6) AS density FROM a JOIN t USING (event_type) LEFT JOIN b USING (event_type, bin)""")
def density_channels(spark, sf_dir):
    return _round(metrics.density(_table(spark, sf_dir, "events"), "value", "event_type"), "left", "density")


RUNS = "r AS (SELECT label, avg(CAST(embedding[1] > 0 AS INTEGER)) AS a, avg(CAST(embedding[2] > 0 AS INTEGER)) AS b, avg(CAST(embedding[3] > 0 AS INTEGER)) AS c FROM embeddings GROUP BY label)"


def _runs(spark, sf_dir):
    """Accuracies of three runs for each label, taken from the signs of three components."""
    share = lambda i: F.avg((F.col("e")[i] > 0).cast("double"))
    return _vec(spark, sf_dir, 3).groupBy("label").agg(share(0).alias("a"), share(1).alias("b"), share(2).alias("c"))


@query(f"WITH {RUNS} SELECT label, CASE WHEN b - a > -0.02 THEN 'output resolution' WHEN c - b > 0.02 THEN 'calibration' WHEN c - a > 0.02 THEN 'mostly output' ELSE 'weights' END AS verdict FROM r")
def diagnose_verdict(spark, sf_dir):
    deltas = {"float_out_delta": F.col("b") - F.col("a"), "sweep_gain": F.col("c") - F.col("b"), "float_out_gain": F.col("c") - F.col("a")}
    return quant.diagnose(_runs(spark, sf_dir).withColumns(deltas)).select("label", "verdict")


@query(f"""WITH {RUNS}, d AS (SELECT label, a - b AS w, b - c AS x FROM r) SELECT label, round(w, 6) AS weight_cost, round(x, 6) AS activation_cost,
 CASE WHEN x > 2 * greatest(w, 1e-6) AND x > 0.02 THEN 'activations' WHEN w > 2 * greatest(x, 1e-6) AND w > 0.02 THEN 'weights' WHEN w + x <= 0.02 THEN 'neither' ELSE 'both' END AS verdict FROM d""")
def attribute_verdict(spark, sf_dir):
    found = quant.attribute(_runs(spark, sf_dir).toDF("label", "float_acc", "dynamic_acc", "int8_acc"))
    return _round(found.select("label", "weight_cost", "activation_cost", "verdict"), "weight_cost", "activation_cost")


SIZES = [20, 80, 320]
SWEEP = f"""e AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings), tr AS (SELECT * FROM e WHERE vec_id % 4 <> 0),
 m AS (SELECT label, d, avg(v) AS m FROM (SELECT label, unnest(range(64)) AS d, unnest(x) AS v FROM tr) GROUP BY 1, 2),
 w AS (SELECT label AS c, list(m ORDER BY d) AS w FROM m GROUP BY 1),
 u AS (SELECT c, w, list_sum(list_transform(w, lambda v: v * v)) / -2 AS b, list_transform(w, lambda v: round_even(v / (list_max(list_transform(w, lambda z: abs(z))) / 127), 0) * (list_max(list_transform(w, lambda z: abs(z))) / 127)) AS s FROM w),
 r AS (SELECT x, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id), vec_id) AS r FROM tr),
 n AS (SELECT unnest({SIZES}) AS n), st AS (SELECT n, max(list_max(list_transform(x, lambda v: abs(v)))) / 127 AS st FROM r, n WHERE r <= greatest(1, n // 10) GROUP BY n),
 q AS (SELECT n, st, vec_id, label, list_transform(x, lambda v: least(greatest(round_even(v / st, 0), -127), 127) * st) AS x FROM e, st),
 rq AS (SELECT n, list_transform(x, lambda v: least(greatest(round_even(v / st, 0), -127), 127) * st) AS x FROM r JOIN st ON r <= greatest(1, n // 10)),
 ro AS (SELECT n, max(abs(round(list_sum(list_transform(list_zip(x, s), lambda p: p[1] * p[2])) + b, 9))) / 127 AS o FROM rq, u GROUP BY n),
 sc AS (SELECT n, vec_id, label, c, round(list_sum(list_transform(list_zip(x, s), lambda p: p[1] * p[2])) + b, 9) AS v FROM q, u),
 pr AS (SELECT n, vec_id, label, arg_max(c, (v, -c)) AS fl, arg_max(c, (least(greatest(round_even(v / o, 0), -127), 127), -c)) AS i8 FROM sc JOIN ro USING (n) GROUP BY n, vec_id, label),
 f AS (SELECT vec_id, arg_max(c, (round(list_sum(list_transform(list_zip(x, w), lambda p: p[1] * p[2])) + b, 9), -c)) AS f FROM e, u GROUP BY vec_id),
 a AS (SELECT n AS rep_size, 'float' AS output, label, fl AS p, f FROM pr JOIN f USING (vec_id) UNION ALL SELECT n, 'int8', label, i8, f FROM pr JOIN f USING (vec_id)),
 sw AS (SELECT CAST(rep_size AS INTEGER) AS rep_size, output, CAST(label AS INTEGER) AS label, count(*) AS n, avg(CAST(p = label AS INTEGER)) AS accuracy, avg(CAST(f = label AS INTEGER)) AS float_accuracy,
  avg(CAST(p = label AS INTEGER)) - avg(CAST(f = label AS INTEGER)) AS delta, avg(CAST(p = f AS INTEGER)) AS agreement FROM a GROUP BY GROUPING SETS ((rep_size, output), (rep_size, output, label)))"""


def _sweep(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    train = e.where("vec_id % 4 <> 0")
    return quant.sweep(e, train, quant.centroids(train, "label", "x"), "vec_id", "label", "x", SIZES, 10)


@query(f"WITH {SWEEP} SELECT rep_size, output, coalesce(label, -1) AS label, n, round(accuracy, 6) AS accuracy, round(float_accuracy, 6) AS float_accuracy, round(delta, 6) AS delta, round(agreement, 6) AS agreement FROM sw")
def quant_sweep(spark, sf_dir):
    """Accuracies of a nearest-mean classifier over whole embeddings under int8 variants, overall (label -1) and by class."""
    return _round(_sweep(spark, sf_dir).fillna(-1, ["label"]), "accuracy", "float_accuracy", "delta", "agreement")


@query(f"""WITH {SWEEP}, i AS (SELECT * FROM sw WHERE label IS NULL AND output = 'int8'), o AS (SELECT accuracy AS fo FROM sw WHERE label IS NULL AND output = 'float' ORDER BY rep_size DESC LIMIT 1),
 g AS (SELECT any_value(float_accuracy) AS fa, arg_max(rep_size, (accuracy, -rep_size)) AS best, max(accuracy) AS acc, arg_max(accuracy, rep_size) - arg_min(accuracy, rep_size) AS gain FROM i)
 SELECT round(fa, 6) AS float_accuracy, best AS best_size, round(acc, 6) AS best_accuracy, round(gain, 6) AS sweep_gain, round(fo - fa, 6) AS float_out_delta, round(fo - acc, 6) AS float_out_gain,
 CASE WHEN fo - fa > -0.02 THEN 'output resolution' WHEN gain > 0.02 THEN 'calibration' WHEN fo - acc > 0.02 THEN 'mostly output' ELSE 'weights' END AS verdict FROM g, o""")
def quant_sweep_verdict(spark, sf_dir):
    """Where int8 loses accuracy, from the predictions of every variant over whole embeddings."""
    return _round(quant.sweep_verdict(_sweep(spark, sf_dir)), "float_accuracy", "best_accuracy", "sweep_gain", "float_out_delta", "float_out_gain")


OPS = [*RESOLVER_METHODS, *HOST_ONLY, "ZZZ"]


@query(f"""WITH o AS (SELECT DISTINCT {OPS}[p_partkey % {len(OPS)} + 1] AS op FROM part)
 SELECT op, CASE WHEN op NOT IN {tuple(RESOLVER_METHODS)} THEN 'unmapped' WHEN op IN {SLOW} THEN 'slow' ELSE 'accelerated' END AS status FROM o WHERE op <> 'DELEGATE'""")
def op_check(spark, sf_dir):
    known = spark.createDataFrame([(o, o not in SLOW) for o in RESOLVER_METHODS], "op string, accelerated boolean")
    used = F.element_at(F.array(*map(F.lit, OPS)), (F.col("p_partkey") % len(OPS) + 1).cast("int"))
    return quant.op_check(_table(spark, sf_dir, "part").select(used.alias("op")), known)


@query(f"WITH {PRED} SELECT label, count(*) AS n, round(avg(CAST(a = label AS INTEGER)), 6) AS float_recall, round(avg(CAST(b = label AS INTEGER)), 6) AS int8_recall, round(avg(CAST(b = label AS INTEGER)) - avg(CAST(a = label AS INTEGER)), 6) AS delta FROM q GROUP BY label")
def per_class_recall(spark, sf_dir):
    return _round(metrics.per_class_recall(_predicted(spark, sf_dir), "label", "a", "b"), "float_recall", "int8_recall", "delta")


@query("SELECT CAST(f AS DOUBLE) AS far, round(least(1, f / 2812.5), 9) AS flag_rate, round(100 * (1 - least(1, f / 2812.5)), 6) AS percentile FROM (SELECT unnest([0.5, 1.0, 2.0, 6.0, 4000.0])::DOUBLE AS f)")
def far_table(spark, sf_dir):
    return metrics.far_table(spark, [0.5, 1, 2, 6, 4000], HOP).select("far", F.round("flag_rate", 9).alias("flag_rate"), F.round("percentile", 6).alias("percentile"))


@query("""WITH t AS (SELECT 6.0::DOUBLE AS far, quantile_cont(value, 1 - 6 / 2812.5) AS t FROM events WHERE user_id % 2 = 0 UNION ALL SELECT 60.0, quantile_cont(value, 1 - 60 / 2812.5) FROM events WHERE user_id % 2 = 0)
 SELECT far AS target_far, round(t, 6) AS threshold, round(avg(CASE WHEN value > t THEN 1.0 ELSE 0 END) * 2812.5, 6) AS observed_far FROM events, t WHERE user_id % 2 = 1 GROUP BY far, t""")
def observed_far(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("user_id", "value")
    table = metrics.thresholds(e.where("user_id % 2 = 0"), "value", [6.0, 60.0], HOP)
    return _round(metrics.observed_far(e.where("user_id % 2 = 1"), "value", table, HOP), "threshold", "observed_far")


@query('SELECT CAST(sum(CAST(n = 0 AS INTEGER)) AS BIGINT) AS "none", CAST(sum(CAST(n > 1 AS INTEGER)) AS BIGINT) AS several FROM (SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1)')
def split_coverage(spark, sf_dir):
    return splits.coverage(_table(spark, sf_dir, "customer").select("c_custkey"), _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT o_orderkey AS pos, c_custkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def gather_rows(spark, sf_dir):
    wanted = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("c_custkey"))
    return splits.gather(_table(spark, sf_dir, "customer").select("c_custkey", "c_name"), wanted, "c_custkey")


@query("(SELECT 'best' AS which, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) UNION ALL (SELECT 'worst', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1)")
def best_and_worst(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    rows = [metrics.best_row(o, "o_totalprice", "o_orderkey", large).select(F.lit(name).alias("which"), "o_orderkey", "o_totalprice") for name, large in (("best", True), ("worst", False))]
    return rows[0].unionByName(rows[1])


@query(f"WITH {PRED} SELECT vec_id, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b FROM q")
def paired_predictions(spark, sf_dir):
    v = _vec(spark, sf_dir, 10)
    coarse = v.select("vec_id", F.transform("e", lambda x: F.round(x * 4)).alias("probs"))
    return metrics.paired_predictions(v.select("vec_id", F.col("e").alias("probs")), coarse, "vec_id")


@query(f"""WITH {SAMPLES}, t AS (SELECT unnest(range(-20, 21)) AS t),
 r AS (SELECT t, CASE WHEN t = 0 THEN 1 ELSE sin(pi() * t / 2) / (pi() * t / 2) END
   * list_sum(list_transform(range(31), lambda m: pow(6.25 * (1 - t * t / 400.0::DOUBLE), m) / pow(CAST(factorial(CAST(m AS INTEGER)) AS DOUBLE), 2))) AS h FROM t)
 SELECT a.user_id, a.i // 2 AS i, round(sum(b.value * r.h) / (SELECT sum(h) FROM r), 6) AS value
 FROM x a JOIN x b ON a.user_id = b.user_id AND b.i BETWEEN a.i - 20 AND a.i + 20 JOIN r ON r.t = a.i - b.i WHERE a.i % 2 = 0 GROUP BY a.user_id, a.i""")
def resample_poly(spark, sf_dir):
    """Half the rate; the SQL sums over taps of a sinc under a Kaiser window, with the Bessel function as its series."""
    return _round(signal.resample(samples(spark, sf_dir), "user_id", "value", 100, 50), "value")


@query()
def gravity_split(spark, sf_dir):
    return signal.gravity_split(samples(spark, sf_dir), "user_id", "value", 50)


@query()
def denoise_lowpass(spark, sf_dir):
    return signal.denoise(samples(spark, sf_dir), "user_id", "value", 50)


def _six_channels(spark, sf_dir):
    e = samples(spark, sf_dir).withColumns({c: F.col("value") * (j + 1) / 6 for j, c in enumerate(("c0", "c1", "c2", "c3", "c4", "c5"))})
    w = windows.window_arrays(e, "user_id", ["c0", "c1", "c2", "c3", "c4", "c5"], WIN, STRIDE)
    return w.withColumn("window_id", F.col("user_id") * 1000 + F.col("k")).select("window_id", "X")


@query()
def augmented_windows(spark, sf_dir):
    apply = augment.augmenter(180, 0.1, 0.15, 0.1, 0.02)
    return augment.expand_augmented(_six_channels(spark, sf_dir), 1, "window_id", 1 << 40, apply)


@query()
def stressed_windows(spark, sf_dir):
    w, key = _six_channels(spark, sf_dir), ["window_id"]
    made = {"shake": augment.shake_windows(w, key), "impact": augment.impact_windows(w, key, width=4, margin=4), "freeze": augment.freeze_windows(w, key)}
    kinds = [x.select(F.lit(kind).alias("kind"), "window_id", "X") for kind, x in made.items()]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


@query()
def network_forward(spark, sf_dir):
    return network.predict(_six_channels(spark, sf_dir), network.initial_weights(fall=True))


@query()
def train_on_windows(spark, sf_dir):
    """Held-out accuracy and macro-F1 a fold: how many errors (0 to 3 or more) a window holds, told from its values."""
    v, errors = F.col("value"), F.sum((F.col("event_type") == "error").cast("int"))
    aggs = [F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg(F.abs("value")).alias("energy"), F.avg(F.when(F.col("event_type") == "error", v).otherwise(0)).alias("hit"), errors.alias("errors")]
    w = windows.sliding_windows(samples(spark, sf_dir), "user_id", WIN, STRIDE, *aggs).withColumn("label", F.least(F.col("errors"), F.lit(3)).cast("int"))
    return _round(training.cross_validate(w, ["mean", "sd", "lo", "hi", "energy", "hit"], "label", "user_id", 4), "accuracy", "macro_f1")


@query("SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings) WHERE r = n // 2")
def class_middle(spark, sf_dir):
    return stats.class_middle(_table(spark, sf_dir, "embeddings"), "label", "vec_id")


@query(f"WITH {WINDOWS} SELECT user_id, CAST(k AS BIGINT) AS k, round(avg(value), 6) AS mean, round(avg(abs(value)), 6) AS energy FROM w GROUP BY user_id, k HAVING count(*) = 16")
def stream_windows(spark, sf_dir):
    """The streaming operator over the whole table, read as a stream and written to a table."""
    from ..streaming.windows import stream_windows as windowed

    stream = spark.readStream.schema(_table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    found = windowed(stream.select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "value", WIN, STRIDE)
    return _round(_drained(spark, found), "mean", "energy")


def _folder(spark) -> str:
    """A fresh folder name that all executors share (own temp folder where all runs on one machine)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="strideframe-")
    return f"{root}/strideframe-{uuid.uuid4().hex[:12]}"


def _drained(spark, stream):
    """What a stream gives until its source is empty, written to a table."""
    home = _folder(spark)
    stream.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/out")


#: Seconds that an event may be late in the test of late streams; parts in which the table arrives.
DISORDER, ARRIVALS = 3600, 4


@query(f"WITH {WINDOWS} SELECT user_id, CAST(k AS BIGINT) AS k, round(avg(value), 6) AS mean, round(avg(abs(value)), 6) AS energy FROM w GROUP BY user_id, k HAVING count(*) = 16")
def stream_late_windows(spark, sf_dir):
    """The whole table arrives in parts, each event up to an hour late by a hash of its id and parts in no order inside; windows are as if in order."""
    from ..streaming.ordered import ordered_windows, with_state_store

    home = _folder(with_state_store(spark))
    e = _table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    seconds = F.unix_seconds("ts")
    arrival = seconds + F.pmod(F.xxhash64("event_id"), F.lit(DISORDER))
    first, last = e.agg(F.min(seconds), F.max(seconds)).first()
    span = (last - first + DISORDER) // ARRIVALS + 1
    e.withColumn("part", F.floor((arrival - first) / span)).repartition("part").write.partitionBy("part").parquet(f"{home}/in")
    for k in range(ARRIVALS):  # files are streamed in the order in which they were written
        spark.read.parquet(f"{home}/in/part={k}").write.parquet(f"{home}/stream/{k}")
    end = spark.range(1).select(F.lit(None).cast("long").alias("user_id"), F.timestamp_seconds(F.lit(last + 10 * (span + DISORDER))).alias("ts"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("double").alias("value"))
    end.write.parquet(f"{home}/stream/{ARRIVALS}")  # moves the watermark past the last event
    stream = spark.readStream.schema(e.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{home}/stream")
    found = ordered_windows(stream, "user_id", "ts", ["event_id"], "value", WIN, STRIDE, f"{span + DISORDER} seconds", "10000 days")
    return _round(_drained(spark, found).drop("late"), "mean", "energy")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
