"""Dominance of version vectors against comparing all pairs, small groups and large ones."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from arbora.operators import conflicts, dominance
from arbora.sources.fixtures import view

from .conftest import DATA


def below(a, b):
    return all(b.get(k, 0) >= v for k, v in a.items())


def vectors(seed):
    rng, out = random.Random(seed), {}
    shapes = {"few": (5, 3, 4), "dense": (300, 3, 12), "sparse": (300, 40, 3), "one": (1, 2, 3), "chain": (200, 1, 10**6), "none": (1, 0, 1)}
    for name, (n, devices, most) in shapes.items():
        made = {tuple(sorted((f"d{k}", rng.randint(1, most)) for k in rng.sample(range(devices), rng.randint(0, min(devices, 4))))) for _ in range(n)}
        out[name] = [dict(t) for t in made]
    out["anti"] = [{"a": i, "b": 250 - i} for i in range(250)]
    return out


def _df(spark, groups):
    rows = [(g, {k: v for k, v in c.items() if v}) for g, cs in groups.items() for c in cs]
    return spark.createDataFrame(rows, "g string, clock map<string,bigint>").select("g", dominance.steps(F.col("clock")).alias("steps")).distinct()


def _plain(v):
    return tuple((e["key"], e["value"]) for e in v)


@pytest.mark.parametrize("small, block", [(64, 32), (1, 7), (10**6, 32)])
def test_as_all_pairs(spark, small, block):
    groups = vectors(3)
    df = _df(spark, groups)
    key = lambda c: tuple(sorted((k, v) for k, v in c.items() if v))
    want = sorted((g, key(a)) for g, cs in groups.items() for a in cs if any(below(a, b) and key(a) != key(b) for b in cs))
    got = sorted((r.g, _plain(r.steps)) for r in dominance.dominated(df, ["g"], small, block).collect())
    assert got == want and len(want) > 100
    ask = {g: [{**c, "d0": c.get("d0", 0) + 2} for c in cs[::3]] for g, cs in groups.items()}
    pairs = sorted({(g, key(a), key(b)) for g, cs in groups.items() for a in cs for b in ask[g] if below(a, b)})
    told = sorted((r.g, _plain(r.lower), _plain(r.upper)) for r in dominance.known(df, _df(spark, ask), ["g"], small, block).collect())
    assert told == pairs and len(pairs) > 1000


def test_empty(spark):
    none = spark.createDataFrame([], f"g string, steps {dominance.STEPS}")
    assert dominance.dominated(none, ["g"]).collect() == [] and dominance.known(none, none, ["g"]).collect() == []


def test_many_records_of_one_path(spark):
    """20,000 records of one path: by many devices, by two, and in a row, of which one stays."""
    n = 20_000
    i = F.col("id")
    clock = F.when(i % 4 == 0, F.create_map(F.concat(F.lit("p"), i.cast("string")), F.lit(3).cast("long")))
    clock = clock.when(i % 4 < 3, F.create_map(F.lit("A"), i + 1, F.lit("B"), n - i)).otherwise(F.create_map(F.lit("C"), i))
    entry = lambda c: F.struct(F.lit("File").alias("kind"), F.lit(1).cast("long").alias("size"), c.alias("clock"))
    nothing = F.create_map(F.lit("L"), F.lit(9).cast("long"))
    records = spark.range(n).select(F.lit("f").alias("folder"), F.format_string("%06d", i).alias("id"), F.lit("x").alias("path"), entry(nothing).alias("local"), entry(clock).alias("incoming"))
    a = view(spark, DATA, "replica_a").limit(1).withColumns({"folder": F.lit("f"), "path": F.lit("x"), "clock": F.create_map(F.lit("L"), F.lit(1).cast("long"))})
    got = conflicts.take_incoming(records, a, "A").select("id", "refused", F.size("clears").alias("n")).collect()
    assert len(got) == n and all(r.n == 1 for r in got)  # nothing is settled, so each clears itself only
    assert {r.id for r in got if not r.refused} == {f"{k:06d}" for k in range(n) if k % 4 < 3 or k == n - 1}


def test_take_incoming_as_pairs(spark):
    """Records of a few paths against the rule record by record, with equal clocks, no entry and no clock."""
    rng, rows, now = random.Random(8), [], {"p0": {"A": 2, "B": 1}, "p1": {"B": 4}, "p3": {}}
    pick = lambda: {k: rng.randint(1, 4) for k in rng.sample("ABCD", rng.randint(0, 3))}
    for p in range(4):
        for i in range(90 if p == 0 else 12):
            rows.append((f"p{p}", f"{p}-{i}", pick(), None if i == 5 else pick()))
    kind = "folder string, id string, path string, local struct<clock map<string,bigint>>, incoming struct<clock map<string,bigint>>"
    records = spark.createDataFrame([("f", i, p, (lo,), (inc,)) for p, i, lo, inc in rows], kind)
    base = view(spark, DATA, "replica_a").limit(1).drop("clock", "path", "folder")
    entries = spark.createDataFrame([("f", p, c) for p, c in now.items()], "folder string, path string, clock map<string,bigint>").crossJoin(base)
    got = {r.id: (r.refused, r.clears, {k: v for k, v in r.clock.items() if v}) for r in conflicts.take_incoming(records, entries, "A").collect()}
    for p, i, _, inc in rows:
        clock = {k: max(now.get(p, {}).get(k, 0), (inc or {}).get(k, 0)) for k in "ABCD"}
        clock["A"] += 1
        others = [r for r in rows if r[0] == p]
        refused = inc is not None and any(o[3] is not None and below(inc, o[3]) and not below(o[3], inc) for o in others)
        clears = sorted(o[1] for o in others if o[1] == i or (o[3] is not None and p in now and below(o[3], clock) and below(o[2], now[p])))
        assert got[i] == (refused, clears, {k: v for k, v in clock.items() if v}), i
