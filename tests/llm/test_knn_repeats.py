"""Rows that share an id, against the query's SQL."""

from __future__ import annotations

import math

import numpy as np

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from arbora.llm import knn


def test_repeated_ids(spark, tmp_path):
    rows = [(0, [1.0, 2.0])] * 7 + [(3, [1.0, 2.0])] + [(50, [2.0, 1.0])] + [(51, [2.0, 1.0])] * 7 + [(i, [1.0, i / 100]) for i in range(10, 20)]
    rows += [(100, [3.0, i / 8]) for i in range(8)] + [(101, [0.5, 0.5])]
    schema = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32()))])
    pq.write_table(pa.Table.from_pylist([{"vec_id": i, "embedding": v} for i, v in rows], schema), tmp_path / "embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet')")
    got = knn.knn_join(spark.read.parquet(f"{tmp_path}/embeddings.parquet")).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(c.execute(knn.KNN_SQL).fetchall())

def brute_knn(rows, k=5):
    out = []
    for i, q in rows:
        if i % 50 == 0:
            best = sorted(((max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), -j) for j, v in rows if j != i), reverse=True)[:k]
            out += [(i, n + 1, -j, s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_large_components(spark):
    """Scores beyond doubles and beyond longs, and vectors of several lengths."""
    rows = [(i, [1e6 + i / 256, 3e7 * (i % 3 - 1), 5.0 * i, 1e13 * (i % 2)]) for i in range(120)] + [(500, []), (501, [1.0])]
    whole = [(i, [math.floor(256 * x) for x in v] + [0] * (4 - len(v))) for i, v in rows]
    got = knn.knn_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == brute_knn(whole)


def test_pruning_of_groups(spark):
    """In grouped data most pairs are left out by the summaries' bounds, without losing a neighbour; tiny blocks and parts
    change nothing."""
    rnd = np.random.Generator(np.random.PCG64(1))
    x = rnd.normal(0, 6, (20, 16))[rnd.integers(0, 20, 1500)] + rnd.normal(0, 0.05, (1500, 16))
    rows = [(i, [float(z) for z in v]) for i, v in enumerate(x)]
    whole, stats = [(i, [math.floor(256 * z) for z in v]) for i, v in rows], {}
    q = knn.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    asked = q.filter("vec_id % 50 = 0")
    assert sorted(map(tuple, knn.top_k(asked, q, 5, stats=stats).collect())) == brute_knn(whole)
    assert stats["kept"] < 0.4 * stats["pairs"]
    was = knn.PART, knn.BLOCK_BYTES, knn.ROWS
    try:
        knn.PART, knn.BLOCK_BYTES, knn.ROWS = 20, 1, 3
        assert sorted(map(tuple, knn.top_k(asked, q, 5).collect())) == brute_knn(whole)
    finally:
        knn.PART, knn.BLOCK_BYTES, knn.ROWS = was
