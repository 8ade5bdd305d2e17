"""A cache of chunk signatures: key, data, checksum, bytes, used (seconds)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retention import lru

#: Bytes of one record, rows, and the age after which a hit is noted.
MAX_RECORD, MAX_ROWS, TOUCH_S = 2 << 20, 1024, 60


def cache_key(folder: Column, path: Column, stamp: Column, size: Column, min_len: Column) -> Column:
    return F.sha2(F.concat_ws("\n", folder, path, stamp, size.cast("string"), min_len.cast("string")), 256)


def record_limit(capacity_mib: int) -> int:
    return min(MAX_RECORD, capacity_mib << 20)


def get(cache: DataFrame, wanted: DataFrame, capacity_mib: int, now: int) -> DataFrame:
    """Of the wanted keys those with a sound record: key, data and touched (whether its time of use is to be set to now).

    A record counts as absent if it is larger than a record may be or its checksum is another one."""
    limit = record_limit(capacity_mib)
    sound = (F.col("bytes") <= limit) & (F.octet_length("data") <= limit) & (F.sha2("data", 256) == F.col("checksum"))
    hits = cache.filter(sound).join(wanted.select("key").distinct(), "key", "left_semi")
    return hits.select("key", "data", (F.col("used") < now - TOUCH_S).alias("touched"))


def touch(cache: DataFrame, hits: DataFrame, now: int) -> DataFrame:
    """The cache after a get(): hits that are older than TOUCH_S were used now."""
    fresh = hits.filter("touched").select("key", F.lit(now).cast("long").alias("__now"))
    return cache.join(fresh, "key", "left").withColumn("used", F.coalesce("__now", "used")).drop("__now")


def put(cache: DataFrame, puts: DataFrame, capacity_mib: int, now: int, rows: int = MAX_ROWS) -> DataFrame:
    """The cache after records (key, data) are put: they replace those of their keys, then the oldest go until all fit.

    Records over the limit don't enter; of several for a key the largest data counts; without capacity nothing changes."""
    if capacity_mib == 0:
        return cache
    limit = record_limit(capacity_mib)
    new = puts.filter(F.octet_length("data") <= limit).groupBy("key").agg(F.max("data").alias("data"))
    new = new.select("key", "data", F.sha2("data", 256).alias("checksum"), F.octet_length("data").cast("long").alias("bytes"), F.lit(now).cast("long").alias("used"))
    both = cache.select(*new.columns).join(new.select("key"), "key", "left_anti").unionByName(new)
    return lru(both.withColumns({"cache": F.lit(0), "id": F.col("key")}), capacity_mib << 20, rows).drop("cache", "id")


def totals(cache: DataFrame) -> DataFrame:
    """Bytes and rows of a cache."""
    return cache.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("rows"))
