"""Cursors kept by a stream against the batch rule, over kills, repeated batches and compaction."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from arbora.operators import feed
from arbora.sources.fixtures import view
from arbora.streaming import cursors

from .conftest import DATA


def told(pair):
    return [sorted(map(tuple, df.select(sorted(df.columns)).collect())) for df in pair]


def test_killed_between_write_and_commit(spark, tmp_path, monkeypatch):
    """Peers are customers; each batch comes again after its write, and the cursors are those of one batch."""
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    updates = view(spark, DATA, "cursor_updates").select("peer", "folder", "lane", F.col("value").cast("long").alias("value"))
    before = view(spark, DATA, "cursors"), view(spark, DATA, "lane_cursors")
    want = told(feed.advanced(*before, updates, 3))
    stream = lambda: spark.readStream.schema(cursors.UPDATE).option("maxFilesPerTrigger", 1).parquet(src)
    put, failed = cursors.put, set()

    def killed(df, folder, batch):
        put(df, folder, batch)
        if batch not in failed:
            failed.add(batch)
            raise RuntimeError("killed")

    monkeypatch.setattr(cursors, "put", killed)
    for i in range(3):
        updates.filter(F.pmod(F.xxhash64("peer", "value"), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(src)
        with pytest.raises(Exception, match="killed"):
            cursors.drain(stream(), out, ck)
        cursors.drain(stream(), out, ck)
        if i == 1:
            assert cursors.compact(spark, out) == 1 and cursors.compact(spark, out) == 1
    assert failed == {0, 1, 2} and told(cursors.current(spark, out, *before, 3)) == want and len(want[0]) > 100
    assert cursors._numbers(spark, out, "bases") == [1] and cursors._numbers(spark, out, "batches") == [2]
    put(updates.limit(50), out, 0)  # one that a base holds comes once more
    assert told(cursors.current(spark, out, *before, 3)) == want


def test_unfinished_tables_do_not_count(spark, tmp_path):
    out = str(tmp_path / "out")
    assert cursors.kept(spark, out).collect() == [] and cursors.compact(spark, out) == -1
    rows = lambda *r: spark.createDataFrame(r, cursors.UPDATE)
    cursors.put(rows(("p", "A", 0, 5), ("p", "A", 0, 9), ("p", "A", 1, 2)), out, 0)
    cursors.put(rows(("p", "A", 0, 7), ("q", "A", 0, 1)), out, 1)
    (tmp_path / "out" / "bases" / "7").mkdir(parents=True)
    assert sorted(map(tuple, cursors.kept(spark, out).collect())) == [("p", "A", 0, 9), ("p", "A", 1, 2), ("q", "A", 0, 1)]
    cursors.put(rows(("q", "A", 0, 1), ("p", "A", 0, 7)), out, 1)
    assert cursors.compact(spark, out) == 1 and cursors.kept(spark, out).count() == 3
