"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a document's hash.  It starts as one bucket; only a bucket over the byte limit
splits, on one more bit, until every bucket fits.  A bucket's final depth is thus the smallest at which its prefix's bytes fit.

Bytes are summed by a prefix long enough for the shards to expect (a few bits over log2 of total / limit).  From there buddies
are merged bit by bit as long as any bucket fits: a bucket that fits while its parent doesn't is final.  The directory has final
buckets only, by the bits that a shard is expected to have: a shorter bucket stands there under each of its continuations, longer
ones share an entry, and a document takes the one whose bits are its own.  Prefixes that are over the limit even at full length
go on with more bits, they alone.

Rows of one id have one hash and can't be told apart by its bits.  Where they don't fit together they are dealt once more, by a
hash of their text and of their number among rows with equal ones, in a second directory (`page` 1), where every row has bits
enough.  Equal rows can change places there, so shards hold the same however the input is partitioned.

Cases: an empty table gives no rows; null texts have 0 bytes; a document over the limit ends alone in its shard (`oversized`);
columns named like those added are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import running
from .common import discard, hash60, written

BITS = 60
#: More bits than the expected depth in the first directory, and in each one below.
SPARE, STEP = 6, 9
#: A directory of at most this many entries is held by the driver and broadcast (40 bytes each).
BROADCAST_ENTRIES = 1 << 15
SHARD_BYTES = 1 << 20


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned(F.col("__h"), BITS - depth)


def _final(sums: DataFrame, base: int, at: int, limit: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """From p (prefixes of `at` bits), bytes and n: the final buckets (depth, q, bytes, n) of at least `base` bits, a table for
    each depth, the longest first; and the tables that were made on the way."""
    fits = (F.col("bytes") <= limit) | (F.col("n") <= 1)
    level, out, made = sums, [], []
    for depth in range(at, base - 1, -1):
        here = F.lit(True) if depth == BITS else fits  # at the last bit all that is left stays together
        if depth == base:
            final = level.filter(here)
        else:
            pair = written(level.groupBy(F.shiftrightunsigned("p", 1).alias("q")).agg(F.collect_list(F.struct("p", "bytes", "n")).alias("both"), F.sum("bytes").alias("bytes"), F.sum("n").alias("n")), f"shard-level-{depth}")
            made.append(pair)
            # Two buddies at most; they are final if they fit and can't merge.
            final = pair.filter(~fits).select(F.explode("both").alias("b")).select("b.*").filter(here)
        out.append(final.select(F.lit(depth).alias("depth"), F.col("p").alias("q"), "bytes", "n"))
        if depth == base:
            break
        level = pair.select(F.col("q").alias("p"), "bytes", "n")
        if pair.filter(fits).isEmpty():  # nor does any shorter prefix
            break
    return out, made


def _directories(lean: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """Directories for __h and n_bytes: p (the first so many bits), depth, q, bytes, n; a row is in the first that has its bits."""
    spark = lean.sparkSession
    total = lean.agg(F.sum("n_bytes")).first()[0] or 0
    expected = max(0, math.ceil(math.log2(max(1.0, total / limit))))
    done, base, left, at = [], 0, lean, min(BITS, expected + SPARE)
    made: list[DataFrame] = []
    while True:
        sums = written(left.groupBy(_prefix(at).alias("p")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n")), f"shard-sums-{at}")
        final, levels = _final(sums, base, at, limit)
        union = final[0]
        for f in final[1:]:
            union = union.unionByName(f)
        bits = max(base, min(at, expected + 1)) if not done else at
        shorter = F.greatest(F.lit(bits) - F.col("depth"), F.lit(0))
        first = F.when(F.col("depth") <= bits, F.expr(f"shiftleft(q, greatest({bits} - depth, 0))")).otherwise(F.expr(f"shiftrightunsigned(q, greatest(depth - {bits}, 0))"))
        entries = union.withColumn("first", first).withColumn("p", F.explode(F.sequence(F.col("first"), F.col("first") + F.pow(F.lit(2.0), shorter).cast("long") - 1)))
        directory = written(entries.select("p", "depth", "q", "bytes", "n"), f"shard-dir-{at}")
        over = sums.filter(~((F.col("bytes") <= limit) | (F.col("n") <= 1))).select("p") if at < BITS else None
        made += [sums, *levels]
        if directory.count() <= BROADCAST_ENTRIES:  # so few that the driver can hold them
            kept = spark.createDataFrame(directory.collect(), directory.schema)
            made.append(directory)
            directory = F.broadcast(kept)
        done.append((bits, directory))
        if over is None or over.isEmpty():
            discard(*made)
            return done
        left = written(left.join(over, _prefix(at) == F.col("p"), "left_semi").select("__h", "n_bytes"), f"shard-left-{at}")
        made.append(left)
        base, at = at, min(BITS, at + STEP)


def _found(rows: DataFrame, directories: list[tuple[int, DataFrame]]) -> DataFrame:
    """rows with depth, shard, shard_bytes and __n of their bucket."""
    out = rows.withColumns({"depth": F.lit(None).cast("int"), "shard": F.lit(None).cast("long"), "shard_bytes": F.lit(None).cast("long"), "__n": F.lit(None).cast("long")})
    for bits, directory in directories:
        found = directory.select(F.col("p").alias("__p"), F.col("depth").alias("__d"), F.col("q").alias("__q"), F.col("bytes").alias("__b"), F.col("n").alias("__m"))
        mine = (_prefix(bits) == F.col("__p")) & (F.expr(f"shiftrightunsigned(__h, {BITS} - __d)") == F.col("__q"))
        out = out.join(found, mine, "left").withColumns({k: F.coalesce(k, v) for k, v in (("depth", "__d"), ("shard", "__q"), ("shard_bytes", "__b"), ("__n", "__m"))})
        out = out.drop("__p", "__d", "__q", "__b", "__m")
    return out


def shard(docs: DataFrame, limit: int = SHARD_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with n_bytes, page (the directory: 0, or 1 for rows dealt by their own hash), depth (int), shard (the
    bucket's bits as a number), shard_bytes and oversized; page, depth and shard together name a shard."""
    rows = docs.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "__h": hash60(F.lit("shard"), F.col(doc_id))})
    lean = written(rows.select("__h", "n_bytes"), "shard-sizes")
    directories = _directories(lean, limit)
    discard(lean)
    out = _found(rows, directories).withColumn("page", F.lit(0).cast("long"))
    deepest = directories[-1][1]
    if not deepest.filter((F.col("depth") == BITS) & (F.col("bytes") > limit) & (F.col("n") > 1)).isEmpty():
        many = (F.col("depth") == BITS) & (F.col("shard_bytes") > limit) & (F.col("__n") > 1)
        alike = out.filter(many).select(*rows.columns).withColumn("__t", hash60(F.lit("page"), F.col(doc_id), F.col(text)))
        # Equal rows are spread by any number of their own, so that a large group of them is many ranges.
        paged = running(alike, ["__t"], [F.xxhash64(F.monotonically_increasing_id())], name="__k").withColumn("__h", hash60(F.col("__t"), F.col("__k"))).drop("__t", "__k")
        paged = written(paged, "shard-pages")
        out = out.filter(~many).unionByName(_found(paged, _directories(paged.select("__h", "n_bytes"), limit)).withColumn("page", F.lit(1).cast("long")))
    return out.withColumn("oversized", (F.col("shard_bytes") > limit) & (F.col("__n") <= 1)).drop("__h", "__n")


def shard_documents(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, depth, shard, shard_bytes of every document."""
    return shard(docs.select("doc_id", "text"), limit).select("doc_id", "n_bytes", "depth", "shard", "page", "shard_bytes", "oversized")


SHARD_SQL = f"""
with d as (
  select doc_id, coalesce(strlen(text), 0)::bigint as n_bytes,
         ('0x' || substr(md5('shard' || chr(31) || coalesce(doc_id::varchar, chr(0))), 1, 15))::bigint as h from documents),
b as (
  select depth, h >> (60 - depth) as p, sum(n_bytes) as bytes, count(*) as n
  from d, (select unnest(range(0, 45)) as depth) group by 1, 2),
f as (
  select d.doc_id, d.n_bytes, b.depth, b.p, b.bytes, b.n, row_number() over (partition by d.doc_id order by b.depth) as k
  from d join b on b.p = d.h >> (60 - b.depth) where b.bytes <= {SHARD_BYTES} or b.n <= 1)
select doc_id, n_bytes, depth::int as depth, p::bigint as shard, 0::bigint as page, bytes::bigint as shard_bytes, bytes > {SHARD_BYTES} and n <= 1 as oversized
from f where k = 1
"""
