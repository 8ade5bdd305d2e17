"""The stream gives the batches of the batch functions, over several triggers and a restart."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from arbora.operators import events
from arbora.streaming import watch


def test_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(7)
    start, rows, t = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc), [], 0
    kinds = ["Modify(Data)", "Create", "Access", "Remove"]
    for i in range(300):
        t += rnd.choice([10, 50, 400]) * 1000
        rows.append((i, f"k{i % 2}", start + dt.timedelta(microseconds=t), rnd.choice(["a/b", "a/c", "a", "d/e/f", "d"]), rnd.choice(kinds)))
    last = [(1000 + i, f"k{i}", start + dt.timedelta(hours=1), "end", "Access") for i in range(2)] + [(1010 + i, f"k{i}", start + dt.timedelta(hours=3), "end", "Access") for i in range(2)]
    schema = "event_id long, key string, at timestamp, path string, kind string"
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    for part in (rows[:120], rows[120:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: watch.coalesce(watch.read(spark, src))
    watch.drain(stream(), out, ck)
    spark.createDataFrame(last[:2], schema).coalesce(1).write.mode("append").parquet(src)
    watch.drain(stream(), out, ck)  # a restart
    spark.createDataFrame(last[2:], schema).coalesce(1).write.mode("append").parquet(src)
    watch.drain(stream(), out, ck)
    told = spark.createDataFrame(rows, schema).withColumns({"us": F.unix_micros("at"), "scope": events.scope(F.col("kind"))})
    want = events.coalesced(events.batches(told, "key"), ["key", "batch_start"]).select("key", "batch_start", "path", "scope", "events")
    got = spark.read.parquet(out).filter("path != 'end'")
    assert sorted(got.collect()) == sorted(want.collect())


def test_calls_in_the_stream(spark, tmp_path):
    """Restarts, rescans, reloads and dropped events over several triggers and a restart of the query, as in batches; and routes."""
    rnd = random.Random(11)
    start, rows, t = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc), [], 0
    for i in range(400):
        t += rnd.choice([10, 50, 90, 400]) * 1000
        control = rnd.choice([None] * 30 + ["drop"] * 6 + ["restart", "rescan", "reload"])
        rows.append((i, f"k{i % 2}", start + dt.timedelta(microseconds=t), rnd.choice(["a/b", "a/c", "a", "d/e/f", "d"]), rnd.choice(["Modify(Data)", "Create", "Access", "Remove"]), control))
    last = [(1000 + i, f"k{i}", start + dt.timedelta(hours=1), "end", "Access", None) for i in range(2)] + [(1010 + i, f"k{i}", start + dt.timedelta(hours=3), "end", "Access", None) for i in range(2)]
    schema = watch.EVENT + ", control string"
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    known = spark.createDataFrame([("a/b", "File"), ("d/e/f", "File")], "path string, kind string")
    stream = lambda: events.routes(watch.coalesce(watch.read(spark, src, schema)), known)
    for part in (rows[:90], rows[90:250], rows[250:], last[:2], last[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        watch.drain(stream(), out, ck)
    told = spark.createDataFrame(rows, schema).withColumns({"us": F.unix_micros("at"), "scope": events.scope(F.col("kind"))})
    want = events.routes(events.directed(told, "key"), known).select("key", "batch_start", "path", "scope", "events", "route")
    got = spark.read.parquet(out).filter("path != 'end'").select(*want.columns)
    assert sorted(got.collect()) == sorted(want.collect())
    assert {r["scope"] for r in got.collect()} == {"Tree", "Entry", "Full", "Restart", "Rescan", "Reload"}


def test_overflow_in_batches(spark):
    df = spark.createDataFrame([(i, "k", i * 10, f"d/f{i}", "Entry", None) for i in range(6)] + [(9, "j", 0, "x", "Tree", "rescan"), (10, "j", 5, "y", "Tree", None)], "event_id long, key string, us long, path string, scope string, control string")
    got = sorted(tuple(r) for r in events.directed(df, "key", paths_most=4).select("key", "path", "scope", "events").collect())
    assert got == [("j", "", "Full", 1), ("j", "", "Rescan", 1), ("k", "", "Full", 6)]


def test_tree_source(spark, tmp_path):
    from arbora.sources import tree

    (tmp_path / "t" / "sub").mkdir(parents=True)
    (tmp_path / "t" / "a.txt").write_text("x")
    (tmp_path / "t" / "sub" / "b.txt").write_text("yy")
    got = {r["path"]: r["size"] for r in tree.scan(spark, str(tmp_path / "t"), "f").collect()}
    assert got == {"a.txt": 1, "sub/b.txt": 2}


def test_full_batch():
    """Past the limit a batch keeps no paths and asks for a full scan; a Tree makes room before."""
    batch = watch._Batch(0, 0)
    for i in range(watch.MAX_PATHS):
        batch.add(i, f"d/f{i}", "Entry")
    batch.add(5000, "d", "Tree")
    assert not batch.full and batch.rows("k") == [("k", 0, "d", "Tree", 1)]
    for i in range(watch.MAX_PATHS + 5):
        batch.add(6000 + i, f"e{i}", "Entry")
    assert batch.full and batch.rows("k") == [("k", 0, "", "Full", watch.MAX_PATHS + 6)] and batch.state()[4:] == ([], [], [])
