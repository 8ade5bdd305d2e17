"""Cursors as a sink of a stream: what peers acknowledge, kept so that a repeated batch changes nothing.

A folder holds the acknowledgements of each batch, greatest by peer, folder and lane, under the batch's number, and now and then a
base that sums up all batches up to one.  A batch that comes again, since the query ended between its write and its commit, writes
the same files again; cursors are greatest values, so neither order nor repetition matters to them.  Writes are plain Parquet in
place of what was there, a base counts once its _SUCCESS is there, and batches go only when a later base holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.feed import advanced

UPDATE = "peer string, folder string, lane int, value long"
KEY = ["peer", "folder", "lane"]


def _numbers(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """Of the finished tables of one kind their numbers."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = lambda s: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if s.isDirectory() and done(s))


def _greatest(updates: DataFrame) -> DataFrame:
    return updates.groupBy(*KEY).agg(F.max("value").cast("long").alias("value")).select(*KEY, "value")


def put(updates: DataFrame, folder: str, batch: int) -> None:
    """Keep the acknowledgements of one batch; again: the same."""
    _greatest(updates).write.mode("overwrite").parquet(f"{folder}/batches/{batch}")


def kept(spark: SparkSession, folder: str) -> DataFrame:
    """peer, folder, lane, value: the greatest acknowledgements so far."""
    bases = _numbers(spark, folder, "bases")
    upto = bases[-1] if bases else -1
    paths = [f"{folder}/bases/{n}" for n in bases[-1:]] + [f"{folder}/batches/{n}" for n in _numbers(spark, folder, "batches") if n > upto]
    return _greatest(spark.read.schema(UPDATE).parquet(*paths)) if paths else spark.createDataFrame([], UPDATE)


def compact(spark: SparkSession, folder: str) -> int:
    """Sum up all batches that are there as a new base, and delete those and older bases; the number of the last batch in it (-1: there
    is nothing).  Not beside another compact() of the same folder; put() may go on."""
    batches, bases = _numbers(spark, folder, "batches"), _numbers(spark, folder, "bases")
    last = max([*batches, *bases], default=-1)
    if last < 0 or bases[-1:] == [last]:
        return last
    kept(spark, folder).write.mode("overwrite").parquet(f"{folder}/bases/{last}")
    for kind, old in (("batches", batches), ("bases", bases)):
        for n in old:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}/{n}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return last


def drain(updates: DataFrame, folder: str, checkpoint: str) -> None:
    """Run a stream of updates (peer, folder, lane, value) into the folder over all that is there now."""
    query = updates.writeStream.foreachBatch(lambda df, n: put(df, folder, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current(spark: SparkSession, folder: str, cursors: DataFrame, lane_cursors: DataFrame, lanes: int) -> tuple[DataFrame, DataFrame]:
    """Folders' and lanes' cursors after all that was kept, from what they were before the stream."""
    return advanced(cursors, lane_cursors, kept(spark, folder), lanes)
