"""Centroid clustering: Lloyd's rounds by deltas, in whole numbers.

What a round knows from the one before are the vectors' owners with their distances (a table) and for each centroid the sum and
the number of its vectors (one row a centroid, on the driver).  A round looks only at what changed:

    a vector whose owner's centroid stands still is compared with the centroids that changed, since every other one was no nearer
    than its owner before and is where it was; a vector whose owner moved is compared with all of them;

    only vectors that went from one owner to another are summed: minus their components at the old one, plus at the new one.
    These signed transfers are added up in each task, then over all tasks, and then to the global sums.

Sums and floors are exact whole numbers, so the sums by transfers equal those over all vectors.  There is no shuffle by vector:
what goes over the network is a row for each task and centroid that lost or won something.

Cases: vectors that are null, of another length, or hold a null or non-finite component take no part and have no row; rows that
share an id, or a vector, are rows of their own (as a first centroid the least by hash, then by vector); rows without an id take
part, but none is a first centroid; fewer vectors than centroids give as many centroids as vectors; without a vector there are no
rows; other columns are ignored.  Components beyond 2**61 count as that; sums of distances beyond a long are null, one distance
beyond it counts as the largest long, so that such distances tie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import discard, written

SCALE, DIMENSIONS, CLUSTERS, ROUNDS, SEED = 256, 64, 40, 5, 2
LONG = 2**63 - 1
#: Sums over many rows are kept in two longs: above and below this many bits.
LOW = 32


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of whole vectors x to centroids c, exact (beyond a long: the largest long)."""
    top = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * top * top * x.shape[1] < 2**53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    if 4 * top * top * x.shape[1] < 2**62:
        return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
    out = np.empty((len(x), len(c)), np.int64)
    for j, y in enumerate(c.astype(object)):
        d = ((x.astype(object) - y) ** 2).sum(1)
        out[:, j] = [min(v, LONG) for v in d]
    return out


def reassigned(x: np.ndarray, owner: np.ndarray, apart: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New owners and distances.  owner -1: none yet.  changed: whether a centroid isn't where it was."""
    owner, apart = owner.copy(), apart.copy()
    lost = (owner < 0) | changed[np.maximum(owner, 0)]
    if lost.any():
        d = distances(x[lost], centroids)
        best = d.argmin(1)  # the first of the least: ties go to the smaller number
        owner[lost], apart[lost] = best, d[np.arange(len(best)), best]
    there = np.flatnonzero(changed)
    if len(there) and not lost.all():
        d = distances(x[~lost], centroids[there])
        at = d.argmin(1)
        near, best = d[np.arange(len(at)), at], there[at]
        o, a = owner[~lost], apart[~lost]
        nearer = (near < a) | ((near == a) & (best < o))
        owner[~lost], apart[~lost] = np.where(nearer, best, o), np.where(nearer, near, a)
    return owner, apart


def _assigned(state: DataFrame, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """The table of the next round: vec_id, q, was (the owner before), owner, apart."""
    shared = state.sparkSession.sparkContext.broadcast((centroids, changed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, moved = shared.value
        for b in batches:
            if b.num_rows:
                was = b.column("owner").to_numpy()
                owner, apart = reassigned(vectors.matrix(b, "q"), was, b.column("apart").to_numpy(), c, moved)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("q"), pa.array(was), pa.array(owner.astype(np.int32)), pa.array(apart)], ["vec_id", "q", "was", "owner", "apart"])

    return state.select("vec_id", "q", "owner", "apart").mapInArrow(run, "vec_id long, q array<long>, was int, owner int, apart long")


def _transfers(state: DataFrame, k: int) -> tuple[list[list[int]], list[int]]:
    """For each centroid what its sum and number change by: only vectors whose owner changed are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros((k, DIMENSIONS), np.int64), np.zeros((k, DIMENSIONS), np.int64), np.zeros(k, np.int64)
        for b in batches:
            if b.num_rows:
                q, was, owner = vectors.matrix(b, "q"), b.column("was").to_numpy(), b.column("owner").to_numpy()
                for side, sign in ((was, -1), (owner, 1)):
                    ok = side >= 0
                    np.add.at(high, side[ok], sign * (q[ok] >> LOW))
                    np.add.at(low, side[ok], sign * (q[ok] & (2**LOW - 1)))
                    np.add.at(n, side[ok], sign)
        c, i = np.nonzero((n != 0)[:, None] | (high != 0) | (low != 0))
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (c.astype(np.int32), i.astype(np.int32), n[c], high[c, i], low[c, i])], ["c", "i", "n", "high", "low"])

    parts = state.filter("was <> owner").select("q", "was", "owner").mapInArrow(run, "c int, i int, n long, high long, low long")
    by, number = [[0] * DIMENSIONS for _ in range(k)], [0] * k
    big = lambda name: F.sum(F.col(name).cast("decimal(38,0)")).alias(name)
    for r in parts.groupBy("c", "i").agg(F.sum("n").alias("n"), big("high"), big("low")).collect():  # at most a row for each centroid and dimension
        by[r["c"]][r["i"]] = (int(r["high"]) << LOW) + int(r["low"])
        number[r["c"]] = r["n"]
    return by, number


def start(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the least hashes of seed and id."""
    hashed = rows.filter("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    return np.array([r["q"] for r in hashed.orderBy("h", "q").limit(k).select("q").collect()], np.int64).reshape(-1, DIMENSIONS)


def cluster(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, stats: list | None = None) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) as a written table, and the final centroids.  Into `stats`, for each assignment: centroids that
    had changed, and vectors that went to another owner."""
    rows = embeddings.filter(vectors.finite("embedding") & (F.size("embedding") == DIMENSIONS)).select(F.col("vec_id").cast("long").alias("vec_id"), vectors.whole("embedding", SCALE).alias("q"))
    centroids = start(rows, k, seed)
    state = rows.select("vec_id", "q", F.lit(-1).alias("owner"), F.lit(0).cast("long").alias("apart"))
    if not len(centroids):
        return state.filter("false").select("vec_id", F.col("owner").alias("cluster"), F.col("apart").alias("distance")), centroids
    k = len(centroids)
    sums, number = [[0] * DIMENSIONS for _ in range(k)], [0] * k
    changed = np.ones(k, bool)
    for turn in range(rounds + 1):
        before, state = state, written(_assigned(state, centroids, changed), "lloyd")
        discard(before)
        if stats is not None:
            stats.append((int(changed.sum()), state.filter("was <> owner").count()))
        if turn == rounds:
            break
        delta, count = _transfers(state, k)
        sums = [[a + b for a, b in zip(x, y)] for x, y in zip(sums, delta)]
        number = [a + b for a, b in zip(number, count)]
        then = np.array([[v // n for v in s] if n else old.tolist() for s, n, old in zip(sums, number, centroids)], np.int64)
        changed = (then != centroids).any(1)
        centroids = then
        if not changed.any():  # every later round would find the same
            break
    return state.select("vec_id", F.col("owner").alias("cluster"), F.col("apart").alias("distance")), centroids


def cluster_digests(embeddings: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = embeddings.sparkSession
    found, centroids = cluster(embeddings)
    digests = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    long = lambda c: F.expr(f"try_cast({c} as bigint)")
    each = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    all_ = each.agg(F.sum("s").alias("t"))
    # A row for each centroid.
    told = each.crossJoin(F.broadcast(all_)).join(spark.createDataFrame(digests, "cluster int, centroid_sha256 string"), "cluster").select("cluster", long("s").alias("cluster_inertia"), long("t").alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(i: int) -> str:
    """Assignment i to the centroids c{i}, and the centroids after it."""
    floor = "(s - ((s % n) + n) % n) // n"
    return f"""
d{i} as materialized (
  select v.row, v.vec_id, v.q, c.c, (list_inner_product(v.q, v.q) - 2 * list_inner_product(v.q, c.q) + list_inner_product(c.q, c.q))::bigint as d
  from v cross join c{i} c),
a{i} as materialized (
  select row, any_value(vec_id) as vec_id, any_value(q) as q, min(struct_pack(d := d, c := c)) as best from d{i} group by row),
m{i} as (
  select best.c as c, i, sum(q[i]::bigint)::bigint as s, count(*) as n from a{i}, range(1, {DIMENSIONS + 1}) r(i) group by 1, 2),
n{i} as (select c, list(({floor})::double order by i) as q from m{i} group by c),
c{i + 1} as materialized (select c.c, coalesce(n.q, c.q) as q from c{i} c left join n{i} n on n.c = c.c)"""


CLUSTER_SQL = f"""
with v as materialized (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as q
  from embeddings
  where embedding is not null and len(embedding) = {DIMENSIONS} and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
c0 as materialized (
  select (row_number() over (order by sha256('{SEED}:' || vec_id), q) - 1)::int as c, q from v where vec_id is not null
  order by c limit {CLUSTERS}),{','.join(_round(i) for i in range(ROUNDS + 1))},
e as (
  select vec_id, best.c as cluster, best.d as distance, (sum(best.d) over (partition by best.c))::bigint as cluster_inertia, (sum(best.d) over ())::bigint as inertia
  from a{ROUNDS})
select e.*, sha256(array_to_string(list_transform(c.q, lambda x: x::bigint), ',')) as centroid_sha256 from e join c{ROUNDS} c on c.c = e.cluster
"""
