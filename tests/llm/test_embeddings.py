"""Near vectors, whitening and clusters against SQL and plain versions, on odd rows too."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from arbora.llm import codes, lloyd, queries, whiten

from ..conftest import DATA
from ..support import rows_of

SCHEMA = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32()), ("x", pa.int32()), ("node", pa.string()), ("cluster", pa.int32()), ("q", pa.int32())])


def stored(tmp_path, rows):
    """The rows as a table with more columns, some with names that the operators use."""
    path = str(tmp_path / "embeddings.parquet")
    pq.write_table(pa.Table.from_pylist([{"vec_id": i, "embedding": v, "x": 1, "node": "n", "cluster": 7, "q": 3} for i, v in rows], SCHEMA), path)
    return path


def against(spark, tmp_path, rows, operator, sql):
    path = stored(tmp_path, rows)
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from read_parquet('{path}')")
    found = c.execute(sql)
    want = rows_of([d[0] for d in found.description], found.fetchall())
    df = operator(spark.read.parquet(path))
    assert rows_of(df.columns, df.collect()) == want
    return want


def directions(rnd, n, size=64):
    x = rnd.normal(size=(n, size))
    return x / np.linalg.norm(x, axis=1)[:, None]


def around(rnd, centre, n, cos):
    """n unit vectors whose cosine with the centre is `cos`."""
    u = rnd.normal(size=(n, len(centre)))
    u -= (u @ centre)[:, None] * centre
    return cos * centre + math.sqrt(1 - cos * cos) * u / np.linalg.norm(u, axis=1)[:, None]


def odd(size=64):
    nan, inf = float("nan"), float("inf")
    return [None, [0.0] * size, [nan] + [1.0] * (size - 1), [inf] + [1.0] * (size - 1), [None] + [1.0] * (size - 1)]


def planted(rnd):
    """Noise, tight and loose groups, a chain, copies, scaled copies, negatives and odd rows."""
    x = [*directions(rnd, 150)]
    tight, loose = directions(rnd, 1)[0], directions(rnd, 1)[0]
    x += [*around(rnd, tight, 60, 0.995), *around(rnd, tight, 25, 0.96), *around(rnd, loose, 40, 0.95)]
    chain = directions(rnd, 1)[0]
    for _ in range(12):
        chain = around(rnd, chain, 1, 0.92)[0]
        x.append(chain)
    x += [x[0]] * 9 + [x[160]] * 30 + [x[1] * 5, x[2] * 1e-20, x[3] * 1e18, -x[4], -x[5]]
    order = rnd.permutation(len(x))
    return [(int(i), x[j].tolist()) for i, j in zip(order, range(len(x)))]


def test_near_vectors(spark, tmp_path):
    rnd = np.random.default_rng(5)
    rows = planted(rnd)
    rows += [(5000 + i, v) for i, v in enumerate(odd())] + [(None, rows[3][1]), (7, rows[9][1]), (7, rows[40][1]), (8000, rows[2][1][:40]), (8001, []), (8002, rows[2][1][:40])]
    want = against(spark, tmp_path, rows, codes.near_vectors, codes.CODES_SQL)
    assert max(r[want[0].index("n_links")] for r in want[1]) > 90


def test_large_cells_are_dealt(spark, tmp_path, monkeypatch):
    """Many parts of a cell, cores against what is near them, and blocks that don't fill up."""
    monkeypatch.setattr(codes, "PART", 20)
    monkeypatch.setattr(codes, "BLOCK", 7)
    against(spark, tmp_path, planted(np.random.default_rng(8)), codes.near_vectors, codes.CODES_SQL)


@pytest.mark.parametrize("size", [1, 2, 8])
def test_few_dimensions(spark, tmp_path, size):
    rnd = np.random.default_rng(size)
    against(spark, tmp_path, [(i, v.tolist()) for i, v in enumerate(directions(rnd, 120, size))], codes.near_vectors, codes.CODES_SQL)


def test_recall_at_the_threshold(spark):
    """Pairs just over the threshold, with as many cells as a table of some 100,000 vectors has."""
    rnd = np.random.default_rng(2)
    a = directions(rnd, 4000)
    b = np.vstack([around(rnd, v, 1, 0.901) for v in a])
    pages = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.vstack([a, b]))], "vec_id long, embedding array<double>")
    codes_each, codes.EACH = codes.EACH, 6
    try:
        stats: dict = {}
        got = codes.near_vectors(pages, stats=stats)
        linked = got.filter("n_links > 0").count() / 8000
    finally:
        codes.EACH = codes_each
    assert linked >= 0.99
    # The codes leave little to be recomputed: the links, and a ten-thousandth of the rest.
    assert stats["estimated"] < 0.6 * stats["pairs"] and stats["recomputed"] < 4000 + 1e-3 * stats["pairs"]


def test_estimates():
    """Unbiased over rotations, inside the bounds, and no link below a code's least value."""
    rnd = np.random.default_rng(3)
    o = directions(rnd, 1)[0]
    q = around(rnd, o, 1, 0.8)[0]
    seen = []
    for seed in range(400):
        turn = codes.rotation(64, seed)
        code, factor = codes.encoded(o[None], turn)
        s = codes.signs(code, 64)[0].astype(float)
        seen.append(float(s @ (q @ turn)) / factor[0])
        assert abs(seen[-1] - 0.8) <= 4 * math.sqrt((1 - factor[0] ** 2) / factor[0] ** 2 / 63)
    assert abs(np.mean(seen) - 0.8) < 4 * np.std(seen) / 20
    turn = codes.rotation(64)
    a = directions(rnd, 3000)
    b = np.vstack([around(rnd, v, 1, 0.9001) for v in a])
    code, factor = codes.encoded(a, turn)
    assert ((codes.signs(code, 64) * (b @ turn)).sum(1) >= codes.least(factor, 64, 0.9)).all()


def whitened(rows, components=16):
    """What the contract says, by a full eigensolver: {vec_id: (n, deviation, explained, |whitened|)}."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    size = max(len(v) for _, v in kept)
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] + [1_000_000] * (size - len(v)) for _, v in kept])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    e, u = np.linalg.eigh((fit - fit.mean(0)).T @ (fit - fit.mean(0)) / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    w = (x - fit.mean(0)) @ u / np.sqrt(e)
    deviation = [sum(int(d) ** 2 for d in r) for r in (n * x - s)]
    return n, e / np.trace(np.cov(fit.T, bias=True)), [(i, d, r) for (i, _), d, r in zip(kept, deviation, w)]


def test_whitening(spark, tmp_path):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(300, 100)) * np.linspace(1, 4, 100) ** 2 @ np.linalg.qr(rnd.normal(size=(100, 100)))[0]
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(x)] + [(i, np.float32(x[0]).tolist()) for i in range(400, 420)]
    rows += [(900 + i, v) for i, v in enumerate(odd(100)) if v is None or v[0] != 0] + [(950, np.float32(x[1][:60]).tolist())]
    stats: dict = {}
    got = whiten.whiten(spark.read.parquet(stored(tmp_path, rows)), stats=stats).toPandas()
    n, explained, want = whitened(rows)
    assert len(got) == 16 * len(want) and set(got["n"]) == {n} and got["identity_error"].max() <= 1e-9 and got["identity_error"].nunique() == 1
    assert len(stats["residuals"]) > 4 and stats["residuals"][-1] <= whiten.ENOUGH
    table = got.pivot(index="vec_id", columns="component", values="whitened")
    mine, theirs = np.array([table.loc[i] for i, _, _ in want]), np.array([w for _, _, w in want])
    assert np.abs(mine * np.sign((mine * theirs).sum(0)) - theirs).max() < 1e-6
    one = got[got["component"] == 1].set_index("vec_id")["deviation"]
    assert [int(one.loc[i]) for i, _, _ in want] == [d for _, d, _ in want]
    assert np.allclose(got.groupby("component")["explained"].first(), explained, rtol=1e-9)


def test_whitening_of_the_table(spark):
    got = queries.QUERIES["op12_lobpcg_whitening"](spark, DATA).toPandas()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    _, _, want = whitened(rows)
    table = got.pivot(index="vec_id", columns="component", values="whitened")
    mine, theirs = np.array([table.loc[i] for i, _, _ in want]), np.array([w for _, _, w in want])
    assert len(got) == 16 * len(rows) and np.abs(mine * np.sign((mine * theirs).sum(0)) - theirs).max() < 1e-7


def test_whitening_of_little(spark):
    make = lambda rows: whiten.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert make([]).collect() == [] and make([(1, None)]).collect() == [] and make([(1, [])]).collect() == []
    assert make([(1, [0.5, 2.0]), (2, [0.5, 2.0])]).collect() == []  # one distinct vector
    got = make([(1, [0.5, 2.0]), (None, [1.5, 2.0]), (3, [1.5, 2.0])]).collect()  # one direction; the other can't be whitened
    assert [(r["vec_id"], r["component"], abs(r["whitened"])) for r in sorted(got, key=str)] == [(1, 1, 1.0), (3, 1, 1.0), (None, 1, 1.0)]
    big = make([(1, [1e300, 0.0]), (2, [-1e300, 1.0])]).collect()  # counts as 2**61
    assert {r["deviation"] for r in big} == {None} and {r["explained"] for r in big} == {1.0}


def test_clusters(spark, tmp_path):
    rnd = np.random.default_rng(6)
    x = [*(directions(rnd, 160) * 3), *around(rnd, directions(rnd, 1)[0], 60, 0.97)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(i, x[0].tolist()) for i in range(300, 330)]
    rows += [(900 + i, v) for i, v in enumerate(odd())] + [(950, [1.0] * 63), (951, [1.0] * 65), (952, []), (7, x[20].tolist()), (None, x[30].tolist())]
    against(spark, tmp_path, rows, lloyd.cluster_digests, lloyd.CLUSTER_SQL)


def test_few_vectors_and_ties(spark, tmp_path):
    against(spark, tmp_path, [(i, [float(i % 3)] * 64) for i in range(25)], lloyd.cluster_digests, lloyd.CLUSTER_SQL)  # equal first centroids
    (tmp_path / "b").mkdir()
    against(spark, tmp_path / "b", [(1, None)], lloyd.cluster_digests, lloyd.CLUSTER_SQL)


def test_deltas(spark):
    """Later rounds move few vectors, and the result is that of plain rounds; numbers beyond 2**53 and 2**62 too."""
    rnd = np.random.default_rng(9)
    for scale in (1.0, 1e4, 1e5):
        x = (rnd.normal(size=(500, 64)) + 4 * rnd.integers(0, 2, (500, 64))) * scale
        stats: list = []
        found, centroids = lloyd.cluster(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), stats=stats)
        q = np.floor(256 * x).astype(np.int64).astype(object)
        c = lloyd.start(spark.createDataFrame([(i, v) for i, v in enumerate(q.tolist())], "vec_id long, q array<long>"), 40, 2).astype(object)
        apart = lambda: [[sum((a - b) ** 2) for b in c] for a in q]
        for _ in range(5):
            d = apart()
            own = [min(range(40), key=lambda j: (r[j], j)) for r in d]
            c = np.array([sum(q[k] for k in range(500) if own[k] == j) // own.count(j) if j in own else c[j] for j in range(40)], dtype=object)
        d = apart()
        want = {k: min((r[j], j) for j in range(40)) for k, r in enumerate(d)}
        assert {r["vec_id"]: (r["distance"], r["cluster"]) for r in found.collect()} == {k: (min(v, 2**63 - 1), j) for k, (v, j) in want.items()}
        assert centroids.astype(object).tolist() == c.tolist()
        assert stats[0] == (40, 500) and all(m < 250 for _, m in stats[1:])


def test_reassignment_looks_at_changes_only():
    x, c = np.array([[0], [10], [21]]), np.array([[0], [10], [20]])
    owner, apart = lloyd.reassigned(x, np.full(3, -1), np.zeros(3, np.int64), c, np.ones(3, bool))
    assert owner.tolist() == [0, 1, 2] and apart.tolist() == [0, 0, 1]
    moved = np.array([[5], [10], [20]])
    owner, apart = lloyd.reassigned(x, owner, apart, moved, np.array([True, False, False]))
    assert owner.tolist() == [0, 1, 2] and apart.tolist() == [25, 0, 1]


def test_tables_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert codes.near_vectors(empty).collect() == [] and lloyd.cluster_digests(empty).collect() == []
    only = spark.createDataFrame([(4, None), (None, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, codes.near_vectors(only).collect()), key=str) == [(4, 0, 4, True), (None, 0, None, None)]


def test_repeats_of_one_vector(spark):
    """A third of all rows is one vector: every copy has a row, and no pair of copies is made."""
    rows = spark.range(30_000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("embedding"))
    got = {tuple(r) for r in codes.near_vectors(rows).groupBy("n_links", "component_id").count().collect()}
    assert got == {(9999, 0, 10_000), (19_999, 1, 20_000)}
