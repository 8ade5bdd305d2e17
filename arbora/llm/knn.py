"""Exact top-k search: Voronoi kNN join under the inner product.

Data and queries are both grouped by pivots (the nearest in Euclidean distance; as many as the root of the rows, between
PIVOTS[0] and PIVOTS[1]).  Summaries describe the groups: a data group by its pivot p, its largest norm N and its k + 1 smallest
distances |v - p| (of distinct ids) and its radius; a query group by its pivot c, its radius u = max |q - c| and its largest norm Q.  For a query
q of the group:

    q.v >= c.p - u |p| - Q |v - p|        q.v <= c.p + u |p| + Q |v - p|        q.v <= Q N

The k + 1 largest of the lower bounds (one of the rows may be the query itself) give the least score that any query of the group
needs.  A data row is sent only to the query groups whose upper bound for it reaches that floor: only necessary rows are
replicated.  The same bounds with the query's own products instead of its group's give each query its own floor, and decide to
which data groups it goes.

Data groups are dealt in parts of PART rows and query groups are packed into blocks of BLOCK_BYTES of queries (larger ones are
cut), so a task holds at most about one part and one block, however large a group is.  Where bounds leave out nothing, a data row
goes to every block: as many copies as the queries have blocks of BLOCK_BYTES.  What is broadcast is a number for each two groups
(at most the square of PIVOTS[1], 8 MB) and the pivots, whatever the number of queries.  Each task keeps the k best at or over the
floor for each of its queries, and a ranking merges them.

Equal vectors are folded first: of rows with the same components only the k + 1 smallest ids, with k rows each at most, can be
among anyone's k best.

Components are integers (floor(256 x), at most a long); bounds are compared with a margin.  Scores are exact: by doubles while
they stay below 2**53, by longs below 2**62, beyond by Python's integers; a score beyond a long counts as the nearest long.

Cases: vectors that are null or hold null or non-finite components take no part, nor do rows without an id; shorter vectors
count as filled up with zeros (an empty one is all zeros); fewer candidates than k give all; an empty table gives no rows; rows
that share an id are rows of their own as candidates; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, written

#: Pivots, least and most; data rows and bytes of queries of one task (about); rows scored at once.
PIVOTS, PART, BLOCK_BYTES, ROWS = (16, 1024), 16_384, 32 << 20, 256
SCALE = 256
LONG, SAFE = (-(2**63), 2**63 - 1), 9.2e18


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and q: floor(256 x) of each component, all as long as the longest; without rows that take no part."""
    bad = F.exists(F.col(embedding), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(F.col(embedding).isNotNull() & F.col(vec_id).isNotNull()).filter(~bad)
    # Doubles beyond a long become the nearest long.
    whole = lambda x: F.greatest(F.lit(-(2.0**63)), F.least(F.lit(9223372036854774784.0), F.floor(x.cast("double") * SCALE).cast("double"))).cast("long")
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(F.col(embedding), whole).alias("q"))
    lengths = rows.agg(F.min(F.size("q")), F.max(F.size("q"))).first()
    if lengths[0] == lengths[1]:
        return rows
    return rows.select("vec_id", F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(lengths[1]) - F.size("q"))).alias("q"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0), np.int64)


def exact_scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, as longs."""
    top = max(1.0, float(np.abs(x.astype(np.float64)).max(initial=0))) * max(1.0, float(np.abs(y.astype(np.float64)).max(initial=0))) * max(1, x.shape[1])
    if top < 2**53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    if top < 2**62:
        return x @ y.T
    return np.clip(x.astype(object) @ y.astype(object).T, *LONG).astype(np.int64)


def _grouped(rows: DataFrame, centre, name: str) -> DataFrame:
    """vec_id, q, g (its pivot), apart (from it) and norm."""

    def group(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = centre.value
        c2 = (c * c).sum(1)
        for page in pages:
            if len(page):
                x = _matrix(page["q"]).astype(np.float64)
                x2 = (x * x).sum(1)
                g = (c2 - 2 * x @ c.T).argmin(1)
                apart = np.sqrt(((x - c[g]) ** 2).sum(1))
                yield page.assign(g=g.astype(np.int32), apart=apart, norm=np.sqrt(x2))

    return written(rows.mapInPandas(group, "vec_id long, q array<long>, g int, apart double, norm double"), name)


class _Bounds:
    """What the summaries tell, without looking at a row."""

    def __init__(self, k: int, pivots: np.ndarray, data: pd.DataFrame, asked: pd.DataFrame, near: dict[int, list[float]]):
        self.k, self.groups, self.of_queries = k, data["g"].to_numpy(), asked["g"].to_numpy()
        self.pivots, self.radius, self.most = pivots[self.groups], data["r"].to_numpy(), data["norm"].to_numpy()
        self.length = np.sqrt((self.pivots**2).sum(1))
        # The smallest distances of each group's rows, by group; a row of distances for each of the k + 1.
        self.near = np.full((k + 1, len(self.groups)), np.inf)
        for j, g in enumerate(self.groups.tolist()):
            for i, x in enumerate(near.get(g, [])):
                self.near[i, j] = x
        self.spread, self.norm = asked["r"].to_numpy(), asked["norm"].to_numpy()
        self.dots = pivots[self.of_queries] @ self.pivots.T if len(asked) else np.zeros((0, len(self.groups)))

    def floor(self, low: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """From lower bounds at distance 0 (queries x groups) and norms: the (k + 1)-th largest lower bound, less a margin."""
        out = np.full(len(low), -np.inf)
        for i in range(len(low)):
            with np.errstate(invalid="ignore"):
                all_ = np.where(np.isinf(self.near), -np.inf, low[i] - norm[i] * self.near).ravel()
            if len(all_) > self.k:
                out[i] = np.partition(all_, len(all_) - self.k - 1)[len(all_) - self.k - 1]
        out -= self.margin(norm)
        # Scores beyond a long count as the nearest long, so that all of them tie.
        return np.where(out < -SAFE, -np.inf, np.minimum(out, SAFE))

    def margin(self, norm: np.ndarray) -> np.ndarray:
        return 1e-9 * (1 + norm * (self.most.max(initial=0) + self.length.max(initial=0)))

    def of_groups(self) -> np.ndarray:
        """Query groups x data groups: the least distance from its pivot at which a row can be needed (above the radius: none)."""
        slack = self.spread[:, None] * self.length
        floor = self.floor(self.dots - slack, self.norm)
        least = (floor[:, None] - self.dots - slack) / np.maximum(self.norm, 1e-9)[:, None]
        never = self.norm[:, None] * self.most < floor[:, None]
        return np.where(never, np.inf, least) - 1e-9 * (1 + self.radius)

    def of_queries_in(self, x: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of queries their floors, and queries x data groups: whether a row there can reach it."""
        dot = x @ self.pivots.T
        floor = self.floor(dot, norm)
        reach = np.minimum(dot + norm[:, None] * self.radius, norm[:, None] * self.most)
        return floor, reach + self.margin(norm)[:, None] >= floor[:, None]


def top_k(queries: DataFrame, data: DataFrame, k: int = 5, pivots: int | None = None, stats: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query (vec_id, q) with the rows of data
    (vec_id, q) of another id; ties to the smaller vec_id.  Into `stats`: how many pairs there are, and are left after routing."""
    spark = data.sparkSession
    same, alike = Window.partitionBy("q", "vec_id").orderBy("vec_id"), Window.partitionBy("q").orderBy("vec_id")
    data = data.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k).select("vec_id", "q")
    data = written(data.withColumn("n", F.dense_rank().over(alike)).filter(F.col("n") <= k + 1).select("vec_id", "q"), "knn-data")
    schema = T.StructType.fromDDL("query_id long, rank int, vec_id long, score long")
    rows = data.count()
    if not rows:
        return spark.createDataFrame([], schema)
    pivots = pivots or min(PIVOTS[1], max(PIVOTS[0], math.isqrt(rows)))
    # At most PIVOTS[1] vectors.
    found = data.select("vec_id", "q").orderBy(F.xxhash64("q"), "vec_id").limit(pivots).select("q").collect()
    centre = spark.sparkContext.broadcast(np.unique(np.array([r["q"] for r in found], np.float64).reshape(len(found), -1), axis=0))
    grouped, asking = _grouped(data, centre, "knn-groups"), _grouped(queries, centre, "knn-queries")
    about = lambda t: t.groupBy("g").agg(F.max("apart").alias("r"), F.max("norm").alias("norm"), F.count("*").alias("n")).orderBy("g").toPandas()
    of_data, of_asked = about(grouped), about(asking)  # a row for each pivot
    # For the floor an id counts once, in one place: among k + 1 ids only one can be the query's.
    homes = grouped.groupBy("vec_id").agg(F.min(F.struct("g", "apart")).alias("h")).select("vec_id", "h.g", "h.apart")
    near: dict[int, list[float]] = {}
    for r in homes.withColumn("i", F.row_number().over(Window.partitionBy("g").orderBy("apart", "vec_id"))).filter(F.col("i") <= k + 1).select("g", "apart").collect():
        near.setdefault(r["g"], []).append(r["apart"])
    bounds = _Bounds(k, centre.value, of_data, of_asked, near)
    shared = spark.sparkContext.broadcast(bounds)
    parts = np.maximum(1, -(-of_data["n"].to_numpy() // PART))
    # Query groups in order are packed into blocks; a larger group has blocks of its own.
    block = max(ROWS, BLOCK_BYTES // (8 * max(1, centre.value.shape[1])))
    first, cuts, at = [], [], 0
    held = 0
    for n in of_asked["n"].tolist():
        if held and held + n > block:
            at, held = at + 1, 0
        first.append(at)
        cuts.append(max(1, -(-n // block)))
        held += n
        if cuts[-1] > 1:
            at, held = at + cuts[-1], 0
    blocks = {g: (a, c) for g, a, c in zip(of_asked["g"].tolist(), first, cuts)}
    dealt_to = spark.sparkContext.broadcast((parts, blocks))
    # Data groups x query groups: the least distance at which the query group can need a row.
    needed = spark.sparkContext.broadcast(bounds.of_groups().T.copy())
    # Query groups of one block, or of one run of blocks, are neighbours: where each such unit begins, its first block, and how many.
    begins = np.flatnonzero(np.append(True, np.diff(first) != 0)) if first else np.zeros(0, np.int64)
    unit_first, unit_cuts = np.array(first, np.int64)[begins], np.array(cuts, np.int64)[begins]

    def route_data(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each row to the blocks of queries that can need it."""
        number = np.full(len(centre.value), -1)
        number[shared.value.groups] = np.arange(len(shared.value.groups))
        for page in pages:
            if len(page):
                j = number[page["g"].to_numpy()]
                part = page["part"].to_numpy() % dealt_to.value[0][j]
                wanted = needed.value[j] <= page["apart"].to_numpy()[:, None]
                row, unit = np.nonzero(np.logical_or.reduceat(wanted, begins, axis=1)) if len(begins) else (np.zeros(0, np.int64),) * 2
                times = unit_cuts[unit]
                block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(unit_first[unit], times)
                row = np.repeat(row, times)
                yield pd.DataFrame({"g": page["g"].to_numpy()[row], "part": part[row].astype(np.int32), "block": block.astype(np.int32), "vec_id": page["vec_id"].to_numpy()[row], "q": page["q"].to_numpy()[row], "apart": page["apart"].to_numpy()[row]})

    def route_queries(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query, with its floor, to the parts of the groups that can hold anything above it."""
        for page in pages:
            if len(page):
                x, norm = _matrix(page["q"]).astype(np.float64), page["norm"].to_numpy()
                floor, reach = shared.value.of_queries_in(x, norm)
                row, j = np.nonzero(reach)
                times = dealt_to.value[0][j]
                row, j = np.repeat(row, times), np.repeat(j, times)
                part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                block = np.array([dealt_to.value[1][g][0] + h % dealt_to.value[1][g][1] for g, h in zip(page["g"].tolist(), page["part"].tolist())], np.int32)
                yield pd.DataFrame({"g": shared.value.groups[j].astype(np.int32), "part": part.astype(np.int32), "block": block[row], "query_id": page["vec_id"].to_numpy()[row], "x": page["q"].to_numpy()[row], "floor": floor[row], "norm": norm[row]})

    spread = F.pmod(F.xxhash64("vec_id"), F.lit(2**31 - 1)).cast("int").alias("part")
    sent = grouped.select("vec_id", "q", "g", "apart", spread).mapInPandas(route_data, "g int, part int, block int, vec_id long, q array<long>, apart double")
    asked = asking.select("vec_id", "q", "g", "norm", spread).mapInPandas(route_queries, "g int, part int, block int, query_id long, x array<long>, floor double, norm double")

    def solve(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})]
        if len(left) and len(right):
            right = right.sort_values("vec_id", kind="stable")
            y, ids, apart = _matrix(right["q"]), right["vec_id"].to_numpy(), right["apart"].to_numpy()
            pivot = centre.value[key[0]]
            for a in range(0, len(left), ROWS):
                page = left.iloc[a : a + ROWS]
                x, floor, norm = _matrix(page["x"]), page["floor"].to_numpy(), np.maximum(page["norm"].to_numpy(), 1e-9)
                far = (floor - x.astype(np.float64) @ pivot) / norm
                near = apart >= far.min() - 1e-6 * (1 + apart)
                if not near.any():
                    continue
                z, mine = y[near], ids[near]
                score = exact_scores(x, z)
                # Nothing under its query's floor is among the k best, and the query itself takes no part.
                ok = (score >= floor[:, None]) & (page["query_id"].to_numpy()[:, None] != mine)
                row, col = np.nonzero(ok)
                value = score[row, col]
                by = np.lexsort((col, -value.astype(np.float64), row)) if abs(value).max(initial=0) < 2**53 else np.lexsort((col, ~value, row))
                row, col, value = row[by], col[by], value[by]
                begin = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
                best = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row)))) < k
                out.append(pd.DataFrame({"query_id": page["query_id"].to_numpy()[row[best]], "vec_id": mine[col[best]], "score": value[best]}))
        return pd.concat(out)

    by_task = ["g", "part", "block"]
    if stats is not None:
        both = asked.groupBy(*by_task).agg(F.count("*").alias("a")).join(sent.groupBy(*by_task).agg(F.count("*").alias("b")), by_task)
        stats |= {"pairs": rows * int(of_asked["n"].sum()), "kept": both.agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0, "pivots": len(centre.value)}
    found = asked.groupBy(*by_task).cogroup(sent.groupBy(*by_task)).applyInPandas(solve, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = written(found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "knn-found")
    discard(data, grouped, asking)
    return out


def knn_join(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The k best of every row whose id is divisible by `every`, against all other rows."""
    rows = quantised(embeddings)
    return top_k(rows.filter(F.col("vec_id") % every == 0), rows, k)


KNN_SQL = """
with u as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
v as (
  select vec_id, list_resize(q, (select max(len(q)) from u), 0) as q from u),
s as (
  select a.vec_id as query_id, b.vec_id, list_inner_product(a.q::double[], b.q::double[])::bigint as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
