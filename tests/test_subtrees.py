"""Sweeps over sorted paths against comparing every path with every other one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from arbora import storage
from arbora.operators import diff, events, ranges, subtrees
from arbora.sources import tree

from .test_automata import many_ranges  # noqa: F401  a fixture


def path(rnd):
    return "/".join(rnd.choice(["a", "a!", "a b", "b", "é", "a0"]) for _ in range(rnd.randint(1, 5)))


@pytest.mark.parametrize("proper", [True, False])
@pytest.mark.parametrize("seed", range(2))
def test_above(spark, many_ranges, seed, proper):  # noqa: F811
    rnd = random.Random(seed)
    rows = {(rnd.choice(["hot"] * 8 + ["k", None]), path(rnd)): rnd.randint(0, 99) if rnd.random() < 0.1 else None for _ in range(1500)}
    rows |= {("hot", None): None, ("k", ""): 5}
    want = {}
    for f, p in rows:
        over = [v for (g, r), v in rows.items() if v is not None and g == f and p and r and (p.startswith(r + "/") or (not proper and p == r))]
        want[f, p] = min(over) if over else None
    if not proper:  # a row with a value is met by itself only if it stands above others; those rows aren't asked for
        want = {k: v for k, v in want.items() if rows[k] is None}
    df = spark.createDataFrame([(*k, v) for k, v in rows.items()], "f string, path string, v long").repartition(5)
    got = {(r["f"], r["path"]): r["above"] for r in subtrees.above(df, ["f"], "path", "v", proper).collect()}
    assert {k: got[k] for k in want} == want and len(got) == len(rows)


def test_a_subtree_over_many_ranges(spark, many_ranges):  # noqa: F811
    """One scope above most of a folder, which is several tasks; and shuffled bytes don't grow with the depth."""
    rows = spark.range(6000).select(F.lit("f").alias("folder"), F.concat(F.when(F.col("id") % 5 > 0, "top/x/").otherwise("other/"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("path"), F.lit("File").alias("kind"))
    none = spark.createDataFrame([], "folder string, path string")
    scopes = spark.createDataFrame([("f", "top"), ("f", "top/x/00011"), ("g", "other")], "folder string, scope string")
    got = diff.unseen(rows, none, scopes)
    assert got.count() == 4800 and got.columns == ["folder", "path", "kind"]
    assert subtrees.outermost(rows.select("path").union(spark.createDataFrame([("top",)], "path string")), [], "path").count() == 1201


def test_overflow_and_gaps(spark):
    rnd = random.Random(3)
    rows = [(i % 3, i, path(rnd), rnd.choice(["Tree", "Entry", "Entry", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, event_id long, path string, scope string")
    got = {(r["k"], r["path"]): (r["scope"], r["events"]) for r in events.coalesced(df, ["k"]).collect()}
    want: dict = {}
    for k, _, p, s in rows:
        if s is not None:
            was = want.get((k, p), ("", 0))
            want[k, p] = (max(was[0], s), was[1] + 1)
    assert got == {(k, p): v for (k, p), v in want.items() if not any(g == k and p.startswith(q + "/") and w[0] == "Tree" for (g, q), w in want.items())}
    live = {k: 0 for k in range(3)}
    held: dict = {k: {} for k in range(3)}
    for k, _, p, s in rows:
        if s is not None and not any(p.startswith(q + "/") and t for q, t in held[k].items()):
            held[k][p] = held[k].get(p, False) or s == "Tree"
            if s == "Tree":
                held[k] = {q: t for q, t in held[k].items() if not q.startswith(p + "/")}
        live[k] = max(live[k], len(held[k]))
    told = {r["k"]: r["paths"] for r in events.overflowing(df, ["k"], 1).collect()}
    assert all(told[k] <= live[k] + 1 for k in told)  # a Tree absorbs before it comes
    g = spark.createDataFrame([("a", 5), ("a/b", 6), ("c/d", 3), ("c/d/e", 4), ("a!", 9)], "path string, generation int")
    assert {r["path"] for r in events.open_gaps(g, 4).collect()} == {"a", "c/d/e", "a!"}


def test_export_in_order(spark):
    rows = spark.range(500).select(F.concat(F.lit("f"), (F.col("id") % 2).cast("string")).alias("folder"), F.sha2(F.col("id").cast("string"), 256).alias("path"))
    with storage.scratch():
        at = tree.save(rows, storage.temporary(spark, "export"), 3)
        got = {(r["folder"], r["path"]): r["position"] for r in tree.exported(spark, at).collect()}
    for f in ("f0", "f1"):
        mine = sorted(p for g, p in got if g == f)
        assert len(mine) == 250 and [got[f, p] for p in mine] == list(range(1, 251))


def test_scratch_deletes(spark):
    hadoop = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    there = lambda p: hadoop(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop(p))
    before, others = storage.cut(spark.range(3), "outside"), set(storage._made)
    with storage.scratch():
        ranges.running(spark.range(9).withColumn("g", F.lit(1)), ["g"], [F.col("id")]).collect()
        made = [p for p in storage._made if "ranges-" in p and p not in others]
        assert made and all(map(there, made))
    assert not any(map(there, made)) and there(before._arbora_path)
    storage.discard(before)
    assert not there(before._arbora_path)
