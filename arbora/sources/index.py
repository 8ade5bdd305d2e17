"""Indexes laid out for lookups and joins: bucketed by path, sorted, with Bloom filters.

An index is a table of the catalog whose files are bucketed by (folder, path), one file a bucket, and sorted by them.  Two indexes
with the same number of buckets are joined where they lie, without a shuffle or a sort.  A lookup by folder and path reads
footers and the few row groups whose range holds the path; one by path_key those whose Bloom filter may hold it (spellings of one
path are rarely neighbours, so ranges don't tell)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..storage import temporary_table

#: Bytes of a row group: small, so that a lookup reads little; and distinct keys that a row group's Bloom filter is made for.
GROUP_BYTES, GROUP_KEYS = 4 << 20, 50_000


def build(entries: DataFrame, buckets: int = 64, key: Column | None = None, name: str | None = None, path: str | None = None, group_bytes: int = GROUP_BYTES) -> str:
    """Write entries (folder, path, ...) with their path_key as an index, and give its name.  Without a name and a path it is a
    temporary one.  A path or folder that is null is found by no lookup."""
    spark = entries.sparkSession
    if name is None or path is None:
        made, at = temporary_table(spark, "index")
        name, path = name or made, path or at
    keyed = entries.withColumn("path_key", paths.path_key("path") if key is None else key)
    writer = keyed.repartition(buckets, "folder", "path").write.bucketBy(buckets, "folder", "path").sortBy("folder", "path").mode("overwrite").option("path", path)
    bloom = {"parquet.bloom.filter.enabled#path_key": "true", "parquet.bloom.filter.expected.ndv#path_key": str(GROUP_KEYS), "parquet.block.size": str(group_bytes)}
    writer.options(**bloom).saveAsTable(name)
    return name


def at_path(spark: SparkSession, index: str, folder: str, path: str) -> DataFrame:
    """The entry of a path."""
    return spark.table(index).filter((F.col("folder") == folder) & (F.col("path") == path))


def at_key(spark: SparkSession, index: str, folder: str, key: str) -> DataFrame:
    """The entries under a key: a path's spellings."""
    return spark.table(index).filter((F.col("folder") == folder) & (F.col("path_key") == key))


def joined(spark: SparkSession, left: str, right: str, how: str = "inner", prefix: str = "right_") -> DataFrame:
    """Entries of two indexes with the same folder and path: the columns of the left one, and those of the right one with a
    prefix.  Buckets are merged in place."""
    a, b = spark.table(left), spark.table(right)
    named = b.select(*[F.col(c) if c in ("folder", "path") else F.col(c).alias(prefix + c) for c in b.columns])
    return a.hint("merge").join(named.hint("merge"), ["folder", "path"], how)
