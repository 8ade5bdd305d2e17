"""Row numbers and running sums inside groups, where one group may be most of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut


def _same(by: Sequence[str]) -> Column:
    """A row's range and group (__p and by) as another table names them (__q, __b0, ...)."""
    same = F.col("__p") == F.col("__q")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__b{i}"))
    return same


def running(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], sums: Mapping[str, str] | None = None, name: str = "n", drop: Sequence[str] = ()) -> DataFrame:
    """rows with `n` (or `name`: 1, 2, ... in order inside `by`), and for each name in `sums` the sum of that column over the rows
    before.  `order` may name columns; those in `drop` serve the order alone, and don't come back.

    Rows are sorted by ranges of (by, order), numbered and summed inside each range, and then moved on by what the ranges before
    hold: a large group is many ranges, and only a row for each range and group is windowed as a whole.  Numbers alone are places
    in the range less the place where the group begins there, so the rows aren't shuffled again for them."""
    sums = dict(sums or {})
    keys = {f"__o{i}": c for i, c in enumerate(order) if not isinstance(c, str)}
    at = [*by, *[c if isinstance(c, str) else f"__o{i}" for i, c in enumerate(order)]]
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    ranged = cut(rows.withColumns(keys).repartitionByRange(*at).sortWithinPartitions(*at).select("*", F.spark_partition_id().alias("__p"), inside.alias("__i")).drop(*keys, *drop), "ranges")
    here = Window.partitionBy("__p", *by).orderBy("__i")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = Window.partitionBy(*by).orderBy("__p")
    if not sums:
        # Written, so that its size is known and it is broadcast where it is small.
        starts = cut(ranged.groupBy("__p", *by).agg(F.min("__i").alias("__s"), F.count("*").alias("__n")), "ranges-starts")
        starts = starts.select(F.col("__p").alias("__q"), *[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)], (before("__n", ranges) - F.col("__s") + 1).alias("__more"))
        out = ranged.join(starts, _same(by)).withColumn(name, (F.col("__i") + F.col("__more")).cast("long"))
        return out.drop("__p", "__i", "__q", "__more", *[f"__b{i}" for i in range(len(by))])
    local = ranged.withColumns({name: F.row_number().over(here), **{k: before(c, here) for k, c in sums.items()}})
    totals = ranged.groupBy("__p", *by).agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__t{i}") for i, c in enumerate(sums.values())])
    moved = totals.select(F.col("__p").alias("__q"), *[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)], before("__n", ranges).alias("__more"), *[before(f"__t{i}", ranges).alias(f"__more{i}") for i in range(len(sums))])
    # Only a range's first group can go on from ranges before: a row a range at most.
    out = local.join(F.broadcast(moved.filter("__more > 0")), _same(by), "left")
    more = lambda c: F.coalesce(c, F.lit(0))
    out = out.withColumns({name: (F.col(name) + more("__more")).cast("long"), **{k: F.col(k) + more(f"__more{i}") for i, k in enumerate(sums)}})
    return out.drop("__p", "__i", "__q", "__more", *[f"__b{i}" for i in range(len(by))], *[f"__more{i}" for i in range(len(sums))])
