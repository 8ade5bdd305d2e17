"""Ranks of groups of any size, by refined histograms."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from arbora.operators import report, selection


@pytest.mark.parametrize("limit,bins", [(100_000, 1024), (10, 64)])
def test_selected(spark, monkeypatch, limit, bins):
    monkeypatch.setattr(selection, "LIMIT", limit)
    monkeypatch.setattr(selection, "BINS", bins)
    rnd = random.Random(limit)
    odd = [float("nan"), float("inf"), -float("inf"), 1e308, -1e308, 5e-324, 0.0, -0.0, None]
    groups = {
        "ties": [rnd.choice([1.0, 2.0, 3.0]) for _ in range(300)], "one": [7.0], "same": [4.5] * 200, "odd": odd * 5, None: [rnd.gauss(0, 1) for _ in range(151)],
        "wide": [math.copysign(10 ** rnd.uniform(-300, 300), rnd.random() - 0.5) for _ in range(150)], "none": [None] * 3,
    }
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double").repartition(4)
    ranks, want = [], {}
    for k, vs in groups.items():
        known = sorted((v for v in vs if v is not None), key=lambda v: (math.isnan(v), v))
        for r in {1, 2, len(known) // 2, len(known) - 1, len(known), len(known) + 1, 0}:
            ranks.append((k, r, r))
            if 1 <= r <= len(known):
                want[k, r] = known[r - 1]
    got = {(x["k"], x["target"]): x["value"] for x in selection.selected(df, ["k"], "v", spark.createDataFrame(ranks, "k string, target int, rank long")).collect()}
    assert set(got) == set(want) and all(got[k] == v or (math.isnan(got[k]) and math.isnan(v)) for k, v in want.items())


def test_distribution_of_one_large_key(spark, monkeypatch):
    """A key that is all of the table: exact, and no task sorts more than LIMIT rows of it."""
    monkeypatch.setattr(selection, "LIMIT", 500)
    n = 200_000
    df = spark.range(n).select(F.lit("k").alias("k"), ((F.col("id") * 7919) % n).cast("double").alias("v"))
    (r,) = report.distribution(df, ["k"], "v").collect()
    assert tuple(r) == ("k", 0.0, (n - 1) / 2, math.ceil(n * 0.95) - 1.0, n - 1.0, n)
    seen = []
    met = selection._met
    monkeypatch.setattr(selection, "_met", lambda rows, by, state: seen.append((state.columns, met(rows, by, state))) or seen[-1][1])
    report.distribution(df, ["k"], "v").collect()
    assert len(seen) >= 2 and "targets" in seen[-1][0] and seen[-1][1].count() <= 3 * 500


def test_distribution_without_values(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0), ("b", None), (None, 3.0), (None, 4.0)], "k string, v double")
    assert sorted(map(tuple, report.distribution(df, ["k"], "v").collect()), key=str) == [("b", 2.0, 2.0, 2.0, 2.0, 1), (None, 3.0, 3.5, 4.0, 4.0, 2)]
