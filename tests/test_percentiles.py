"""Exact selection by narrowing histograms against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import metrics


def expected(values, q):
    v = sorted(values)
    n = len(v)
    place = q * (n - 1)
    return round(float(np.percentile(v, q * 100)), 6), v[max(1, math.ceil(q * n)) - 1], v[round(place)]


@pytest.mark.parametrize("q", [0.5, 0.95, 0.0, 1.0])
def test_percentiles_of_narrowed_groups(spark, q):
    rng = np.random.default_rng(5)
    groups = {
        "hot": list(np.round(rng.normal(0, 10, 6000), 3)),
        "wide": list(10.0 ** rng.integers(-200, 200, 900)),
        "ties": [1.0] * 1500 + [2.0] * 1500 + [float(x) for x in rng.integers(0, 5, 500)],
        "same": [7.0] * 2000,
        "one": [3.5],
        None: list(rng.random(700)),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("empty", None), ("one", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: (r["linear"], r["nearest_rank"], r["rounded_index"]) for r in metrics.percentiles(df, "g", "v", q, most=40).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        want = expected(vs, q)
        assert got[g][1:] == want[1:], g
        assert got[g][0] == pytest.approx(want[0], rel=1e-9), g


def test_no_task_orders_more_than_the_bound(spark, monkeypatch):
    seen = []
    ranked = metrics._ranked

    def watched(values, ranks):
        seen.append(ranks.agg(F.max("_n")).first()[0])
        return ranked(values, ranks)

    monkeypatch.setattr(metrics, "_ranked", watched)
    df = spark.range(50_000).select(F.lit("a").alias("g"), (F.hash("id") / 7.0).alias("v"))
    metrics.percentiles(df, "g", "v", 0.95, most=100).collect()
    assert len(seen) > 1 and max(n or 0 for n in seen) <= 100


def test_empty_table_has_no_percentiles(spark):
    assert metrics.percentiles(spark.createDataFrame([], "g string, v double"), "g", "v", 0.5).count() == 0
