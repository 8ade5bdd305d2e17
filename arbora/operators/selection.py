"""Order statistics of groups of any size: histograms that are refined around the wanted ranks, and the rows of one bin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut, discard

#: Rows that one task may sort; bins of a histogram; open ranks that are broadcast (they are counted first).
LIMIT, BINS, BROADCAST = 100_000, 1024, 10_000


def _same(left: Sequence[str], prefix: str) -> Column:
    out = F.lit(True)
    for i, c in enumerate(left):
        out = out & F.col(c).eqNullSafe(F.col(f"{prefix}{i}"))
    return out


def _met(rows: DataFrame, by: Sequence[str], state: DataFrame) -> DataFrame:
    """rows (by, __v) with each interval of `state` that holds them."""
    named = state.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], *[c for c in state.columns if c not in by])
    named = F.broadcast(named) if state.count() <= BROADCAST else named
    return rows.join(named, _same(by, "__k") & (F.col("__v") >= F.col("lo")) & (F.col("__v") <= F.col("hi"))).drop(*[f"__k{i}" for i in range(len(by))])


def _bin(turn: int) -> Column:
    """0 to BINS - 1 between lo and hi, in odd turns by orders of magnitude; what isn't finite has bins of its own."""
    v, lo, hi = F.col("__v"), F.col("flo"), F.col("fhi")
    if turn % 2:
        # Above 0 for every positive double, and as far below for its negative.
        order = lambda x: F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1100))
        low, high = order(lo), order(hi)
        share = F.try_divide(order(v) - low, high - low)
    else:
        # Two different values never differ by zero, but the difference may be too large for a double.
        share = F.when(hi - lo < float("inf"), F.try_divide(v - lo, hi - lo)).otherwise(F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2))
    inside = F.least(F.greatest(F.floor(F.coalesce(share, F.lit(0.0)) * BINS), F.lit(0)), F.lit(BINS - 1))
    return F.when(F.isnan(v), BINS + 1).when(v == float("inf"), BINS).when(v == float("-inf"), -1).otherwise(inside).cast("int")


def selected(rows: DataFrame, by: Sequence[str], value: str, wanted: DataFrame) -> DataFrame:
    """For wanted (by, target, rank; ranks from 1) the value with that rank in its group, in ascending order, as `value` (double).

    Each pass counts the rows of an interval by bins and goes on with the bin that holds the rank, from its least to its greatest
    value; a rank is found when that is one value, or when the bin is small enough to be sorted.  Every second pass has its bins by
    orders of magnitude, so that values of many scales need few passes.  No group meets in a task.
    Null values don't count; NaN is the greatest; ranks beyond a group's values have no row."""
    rows = rows.select(*by, F.col(value).cast("double").alias("__v")).filter("__v is not null")
    finite = F.when(~F.isnan("__v") & (F.abs("__v") < float("inf")), F.col("__v"))
    ends = [F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.min(finite).alias("flo"), F.max(finite).alias("fhi"), F.count("*").alias("inside")]
    about = rows.groupBy(*by).agg(*ends)
    named = wanted.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], "target", F.col("rank").cast("long").alias("rank"))
    state = about.join(named, _same(by, "__k")).filter("rank between 1 and inside").withColumn("below", F.lit(0).cast("long"))
    columns = [*by, "target", "rank", "lo", "hi", "flo", "fhi", "below", "inside"]
    state, turn = cut(state.select(*columns), "ranks"), 0
    while not (open_ := state.filter((F.col("inside") > LIMIT) & (F.col("lo") < F.col("hi")))).isEmpty():
        bins = _met(rows, by, open_.drop("inside")).groupBy(*by, "target", "rank", "below", _bin(turn).alias("bin")).agg(*ends)
        # At most BINS and three rows for each rank.
        upto = F.sum("inside").over(Window.partitionBy(*by, "target").orderBy("bin")) + F.col("below")
        hit = bins.withColumn("__upto", upto).filter((F.col("rank") > F.col("__upto") - F.col("inside")) & (F.col("rank") <= F.col("__upto"))).withColumn("below", F.col("__upto") - F.col("inside"))
        then = cut(state.filter(~((F.col("inside") > LIMIT) & (F.col("lo") < F.col("hi")))).unionByName(hit.select(*columns)), "ranks")
        discard(state)
        state, turn = then, turn + 1
    one = state.filter("lo = hi").select(*by, "target", F.col("lo").alias("value"))
    few = state.filter("lo < hi").groupBy(*by, "lo", "hi", "below").agg(F.collect_list(F.struct("target", "rank")).alias("targets"))
    place = F.row_number().over(Window.partitionBy(*by, "lo", "hi").orderBy("__v")) + F.col("below")
    ranked = _met(rows, by, few).withColumn("__place", place)
    found = ranked.withColumn("__t", F.explode(F.filter("targets", lambda t: t["rank"] == F.col("__place"))))
    return one.unionByName(found.select(*by, F.col("__t.target").alias("target"), F.col("__v").alias("value")))
