"""Box plots with whiskers and densities against NumPy."""

import numpy as np
import pytest

from strideframe.operators import metrics

A = [*map(float, range(1, 10)), 100.0, 3.0, 3.0]


@pytest.fixture
def rows(spark):
    values = [("a", v, "x") for v in [*A, None]] + [("b", 5.0, "y")] * 3 + [(None, 7.0, "z"), ("c", None, "z")]
    return spark.createDataFrame(values, "g string, v double, q1 string")  # a column with the name of a result


def test_whiskers_end_at_the_furthest_value_within_reach(rows):
    got = {r["g"]: r for r in metrics.box(rows, "v", "g").collect()}
    q1, q2, q3 = np.percentile(A, [25, 50, 75])
    inside = [v for v in A if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
    a = got["a"]
    assert (a["q1"], a["q2"], a["q3"]) == pytest.approx((q1, q2, q3))
    assert (a["low"], a["high"], a["n"], a["n_outside"]) == (min(inside), max(inside), len(A), len(A) - len(inside)) and a["n_outside"] == 1
    assert tuple(got["b"])[1:] == (5.0, 5.0, 5.0, 5.0, 5.0, 3, 0) and set(got) == {"a", "b"}


def test_box_of_all_rows_and_of_none(rows):
    assert metrics.box(rows.where("g = 'a'"), "v").first()["n"] == len(A)
    assert metrics.box(rows.where("false"), "v", "g").count() == 0


def test_density_equals_numpy_and_keeps_empty_bins(rows):
    got = sorted(metrics.density(rows.where("g = 'a'"), "v", "g", bins=7, lo=0.0, hi=1.0).collect(), key=lambda r: r["bin"])
    want, edges = np.histogram(A, 7, density=True)
    assert [r["n"] for r in got] == np.histogram(A, 7)[0].tolist() and 0 in [r["n"] for r in got]
    assert [r["density"] for r in got] == pytest.approx(want.tolist()) and [r["left"] for r in got] == pytest.approx(edges[:-1].tolist())


def test_density_of_one_value_and_of_no_rows(rows):
    got = metrics.density(rows.where("g = 'b'"), "v", "g", bins=3).orderBy("bin").collect()
    assert [(r["n"], r["density"]) for r in got] == [(3, None), (0, None), (0, None)]
    assert metrics.density(rows.where("false"), "v", "g").count() == 0
