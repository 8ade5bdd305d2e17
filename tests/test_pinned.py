"""Values that pin semantics, and invariants."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from arbora.functions import clocks, paths
from arbora.operators import chunks, diff, events, feed, ranges, reconcile, retention


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def m(**devices):
    return F.create_map(*[F.lit(x) for k, v in devices.items() for x in (k, v)]).cast("map<string,bigint>") if devices else F.create_map().cast("map<string,bigint>")


def test_clocks(spark):
    a, b = m(a=2, b=1), m(a=1, b=2)
    r = one(spark, r=clocks.relation(a, b), x=clocks.relation(clocks.merge(a, b), a), e=clocks.relation(m(a=1), m(a=1, b=0)), n=clocks.relation(m(), m(a=1)), t=clocks.text(clocks.bump(m(b=3), "a")), d=clocks.text(clocks.drop_device(a, "a")))
    assert (r["r"], r["x"], r["e"], r["n"], r["t"], r["d"]) == ("Concurrent", "After", "Equal", "Before", "a:1,b:3", "b:1")


def test_merge_laws(spark):
    rnd = random.Random(3)
    rows = [tuple({k: rnd.randint(1, 3) for k in "abc" if rnd.random() < 0.7} for _ in range(3)) for _ in range(60)]
    df = spark.createDataFrame(rows, "a map<string,bigint>, b map<string,bigint>, c map<string,bigint>")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    t, mg = clocks.text, clocks.merge
    laws = df.select((t(mg(a, b)) == t(mg(b, a))).alias("x"), (t(mg(a, mg(b, c))) == t(mg(mg(a, b), c))).alias("y"), (t(mg(a, a)) == t(a)).alias("z"), clocks.includes(a, mg(a, b)).alias("w"))
    assert laws.filter("not (x and y and z and w)").count() == 0


@pytest.mark.parametrize("path,bad", [("", 1), ("../x", 1), ("/etc/passwd", 1), ("a/../b", 1), ("a//b", 1), (".arbora/key", 1), ("a/./b", 1), ("a\\b", 1), ("a/.ARBORA/x", 1), ("src/main.rs", 0)])
def test_paths(spark, path, bad):
    assert bool(len(one(spark, v=paths.violations(F.lit(path)))["v"])) == bool(bad)


def test_key_and_globs(spark):
    df = spark.createDataFrame([("É.txt",), ("é.TXT",), (None,)], "path string")
    keys = [r[0] for r in df.select(paths.path_key("path")).collect()]
    assert keys[0] == keys[1] and keys[2] is None
    said = lambda p, *g: one(spark, x=paths.excluded(F.lit(p), g))["x"]
    assert said("a/node_modules/x", "node_modules") and not said("a/node_modules2/x", "node_modules")
    assert said("a/b/c.tmp", "*.tmp") and said("build/x", "build") and not said("rebuild/x", "build")
    assert said("a/b", "a/?") and said("x/ab.c", "[a-b]b.{c,d}") and not said("x/cb.c", "[a-b]b.{c,d}")
    assert paths.parse_ignore(" a \n\n# c\nb\n") == ["a", "b"]
    assert one(spark, x=paths.ancestors(F.lit("a/b/c")))["x"] == ["a", "a/b"] and one(spark, x=paths.ancestors(F.lit("a")))["x"] == []


def entries(spark, rows):
    return spark.createDataFrame(rows, "folder string, path string, kind string, size long, hash string, target string, mode int, clock map<string,bigint>, seq long, stamp string")


def test_lanes_drain_once(spark):
    rows = [("f", f"p{i}", "File", 12 if i % 5 == 0 else 2 << 20, "h", None, 420, {"a": 1}, i + 1, "") for i in range(60)]
    e = entries(spark, rows).cache()
    seen = []
    for index in range(3):
        after = 0
        while True:
            page, upto = feed.lane_page(e, "f", after, 3, index, size=8)
            seen += [r["path"] for r in page.collect()]
            then = upto.first()["upto"]
            if then == after:
                break
            after = then
    assert sorted(seen) == sorted(r[1] for r in rows)


def test_cursor_floor(spark):
    cursors = spark.createDataFrame([("p", "f", 10)], "peer string, folder string, value int")
    none = spark.createDataFrame([], "peer string, folder string, lanes int, lane int, value int")
    up = spark.createDataFrame([("p", "f", 0, 100), ("p", "f", 1, 80), ("p", "f", 2, 70)], "peer string, folder string, lane int, value int")
    got, lanes = feed.advanced(cursors, none, up, 3)
    assert got.first()["value"] == 70
    back = spark.createDataFrame([("p", "f", 1, 20)], "peer string, folder string, lane int, value int")
    assert feed.advanced(got, lanes, back, 3)[0].first()["value"] == 70


def test_event_storm_and_trees(spark):
    storm = spark.range(2000).select(F.lit("k").alias("key"), F.lit("x").alias("path"), (F.col("id") * 20).alias("us"), F.col("id").alias("event_id"), F.lit("Entry").alias("scope"))
    b = events.batches(storm, "key")
    assert b.agg(F.max("batch")).first()[0] == 1 and events.counters(b, ["key", "batch"]).first()["coalesced"] == 1999
    rows = [("k", "src/main.rs", "Entry"), ("k", "src/other.rs", "Entry"), ("k", "src-other/file", "Entry"), ("k", "src", "Tree")]
    left = {r["path"] for r in events.coalesced(spark.createDataFrame(rows, "key string, path string, scope string"), ["key"]).collect()}
    assert left == {"src", "src-other/file"}
    many = spark.range(4106).select(F.lit("k").alias("key"), F.col("id").cast("string").alias("path"), F.lit("Entry").alias("scope"))
    assert events.overflowing(many, ["key"]).count() == 1


def test_batches_by_age(spark):
    df = spark.createDataFrame([("k", i, i * 90_000) for i in range(30)], "key string, event_id long, us long")
    got = [r["batch"] for r in events.batches(df, "key").orderBy("event_id").collect()]
    assert got == [1 + (i * 90_000 > 1_000_000) + (i * 90_000 > 1_080_000 + 1_000_000) for i in range(30)]


def test_gating_and_limits(spark):
    r = one(spark, a=chunks.worthwhile(F.lit(1 << 20), F.lit(4096), F.lit(16 << 20)), b=chunks.worthwhile(F.lit(1 << 20), F.lit(512 * 1024), F.lit(16 << 20)), c=events.suggested_limit(F.lit(800000), F.lit(524288)), d=events.suggested_limit(F.lit(100), F.lit(524288)))
    assert (r["a"], r["b"], r["c"], r["d"]) == (True, False, 1048576, 524288)


def test_retention(spark):
    two = spark.createDataFrame([("f", "b", 2, 5), ("f", "a", 1, 5)], "folder string, id string, saved_at long, bytes long")
    assert [r["id"] for r in retention.versions(two, 10, None, 0).orderBy("saved_at").collect()] == ["a", "b"]
    assert retention.versions(two, 0, 0).count() == 0  # dated in the future
    assert retention.lru(spark.createDataFrame([("c", 1, 1, 700), ("c", 2, 2, 700)], "cache string, id int, used int, bytes int"), 1000).first()["id"] == 2
    assert retention.enabled({"versions_days": None, "partial_days": 3}) == ["partials"]


def test_thermal(spark):
    df = spark.createDataFrame([("s", i, float(t)) for i, t in enumerate([74, 75, 74, 70, 200, 72])], "sensor string, at int, celsius double")
    assert [r["hot"] for r in events.thermal(df, "sensor", 75.0).orderBy("at").collect()] == [False, True, True, False, True, True]


def test_skips(spark):
    df = spark.createDataFrame([("k", i, i != 0) for i in range(6)], "key string, n long, useful boolean")
    assert [r["skipped"] for r in chunks.skips(df, ["key"], "n").orderBy("n").collect()] == [False, True, True, True, False, False]


def naive_boundaries(body, p):
    gear, out, start, h = chunks.gear_table(), [], 0, 0
    for i, byte in enumerate(body):
        h = (h * 2 + int(gear[byte])) % 2**64
        n = i + 1 - start
        if (n >= p.min and h & p.mask == 0) or n >= p.max or i + 1 == len(body):
            out.append(i + 1)
            start, h = i + 1, 0
    return out


def test_boundaries():
    rnd = random.Random(5)
    for body in (bytes(rnd.randrange(256) for _ in range(20000)), b"\x00" * 5000, b"x", b""):
        for floor in (16, 64, 256):
            p = chunks.Parameters(floor, 16 * floor, 4 * floor - 1)
            assert chunks.boundaries(body, p) == naive_boundaries(body, p)
    assert chunks.parameters(32 << 20, 0) == (16384, 16 * 16384, 4 * 16384 - 1)


def test_convergence(spark):
    """Two sides that apply each other's versions without conflicts end equal."""
    a = entries(spark, [("f", "x", "File", 1, "h1", None, 420, {"a": 1}, 1, ""), ("f", "y", "File", 1, "h2", None, 420, {"a": 2, "b": 1}, 2, ""), ("f", "z", "Deleted", 0, "", None, 420, {"a": 3}, 3, "")])
    b = entries(spark, [("f", "y", "File", 1, "h3", None, 420, {"a": 1, "b": 1}, 1, ""), ("f", "w", "File", 1, "h4", None, 420, {"b": 5}, 2, "")])

    def side(mine, theirs):
        got = reconcile.outcomes(mine, theirs)
        assert got.filter("outcome = 'conflict'").count() == 0
        new = got.filter("outcome = 'place'").select("folder", "path", *[F.col(f"remote.{c}").alias(c) for c in ("kind", "size", "hash", "target", "mode")], "clock", F.lit(99).cast("long").alias("seq"), F.lit("").alias("stamp"))
        return diff.latest(mine, new).select("folder", "path", "kind", "hash", clocks.text(F.col("clock")).alias("clock"))

    assert sorted(side(a, b).collect()) == sorted(side(b, a).collect())


def test_empty_and_null(spark):
    none = entries(spark, [])
    assert diff.decide(none, none.drop("clock", "seq"), "a").count() == 0
    assert reconcile.plan_summary(reconcile.pairing_plan(none, none)).count() == 0
    assert events.coalesced(spark.createDataFrame([("k", "a", None)], "key string, path string, scope string"), ["key"]).count() == 0


def fold(outcomes):
    out, left = [], 0
    for good in outcomes:
        out.append(left > 0)
        left = left - 1 if left else (0 if good else 3)
    return out


def test_skips_fold(spark):
    """Folding runs between calm places gives what folding all attempts does."""
    rnd = random.Random(9)
    rows, want = [], {}
    for k in range(40):
        share = rnd.choice([0.02, 0.3, 0.5, 0.9, 1.0])
        outcomes = [rnd.random() < share for _ in range(rnd.randint(1, 300))]
        rows += [(k, i, g) for i, g in enumerate(outcomes)]
        want |= {(k, i): x for i, x in enumerate(fold(outcomes))}
    got = chunks.skips(spark.createDataFrame(rows, "k int, i long, useful boolean").repartition(3), ["k"], "i").collect()
    assert {(r["k"], r["i"]): r["skipped"] for r in got} == want


def test_running(spark):
    rnd = random.Random(4)
    rows = [("hot" if rnd.random() < 0.7 else rnd.choice(["a", "b", None]), i, rnd.randint(0, 9)) for i in range(2000)]
    rnd.shuffle(rows)
    got = {r["i"]: (r["n"], r["s"]) for r in ranges.running(spark.createDataFrame(rows, "g string, i long, x long").repartition(5), ["g"], [F.col("x"), F.col("i")], {"s": "x"}).collect()}
    for g in ("hot", "a", "b", None):
        total = 0
        for n, (_, i, x) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1]))):
            assert got[i] == (n + 1, total)
            total += x


def replayed(puts, budget, most, item_bytes):
    """key -> (position, bytes) that a cache holds after puts (cache, position, key, bytes)."""
    held: dict = {}
    for _, i, k, n in puts:
        if not 0 < n <= min(item_bytes, budget):
            continue
        held.pop(k, None)
        while held and (sum(x for _, x in held.values()) + n > budget or len(held) >= most):
            held.pop(min(held, key=lambda q: held[q][0]))
        held[k] = (i, n)
    return held


@pytest.mark.parametrize("ranges_", [4, 9])
def test_scan_cache(spark, ranges_):
    """Against the cache itself, with sizes that fall too; caches of one range and of several."""
    rnd = random.Random(5 + ranges_)
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": str(ranges_)}
    was = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        puts = [(1 if rnd.random() < 0.1 else 0, i, f"k{rnd.randrange(12)}", rnd.choice([0, 1, 3, 10, 30, 31, 45, 60])) for i in range(400)]
        puts += [(2, 0, "a", 60), (2, 1, "b", 60), (2, 2, "b", 10), (3, 0, "a", 101), (None, 5, "x", 7)]
        for budget, most in ((100, 8), (100, 3), (40, 50), (10_000, 50), (10_000, 5)):
            got = retention.scan_cache(spark.createDataFrame(puts, "cache int, position long, key string, bytes long").repartition(3), budget, most, 61)
            want = {(c, k, *v) for c in (0, 1, 2, 3, None) for k, v in replayed([p for p in puts if p[0] == c], budget, most, 61).items()}
            assert {(r["cache"], r["key"], r["position"], r["bytes"]) for r in got.collect()} == want
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_reuse_by_content(spark):
    """cdc_reuse's counts against chunks that are cut and compared here."""
    import hashlib

    rnd = random.Random(6)
    bodies = [bytes(rnd.randrange(256) for _ in range(n)) for n in (0, 10, 3000, 20000)]
    edited = [b[: len(b) // 3] + b"!!" + b[len(b) // 3 :] for b in bodies]
    frame = lambda rows: spark.createDataFrame(list(enumerate(map(bytearray, rows))), "doc_id int, body binary")
    got = {r["doc_id"]: (r["size"], r["reused"], r["operations"]) for r in chunks.reuse(chunks.plan(chunks.signature(frame(edited), keep=("doc_id",), min_floor=64), chunks.signature(frame(bodies), keep=("doc_id",), min_floor=64), ["doc_id"]), ["doc_id"]).collect()}

    def cut(body):
        ends = chunks.boundaries(body, chunks.parameters(len(body), 0, 64)) if body else []
        return [(hashlib.sha256(body[a:b]).hexdigest(), b - a) for a, b in zip([0, *ends], ends)]

    for i, (a, b) in enumerate(zip(bodies, edited)):
        old, new = set(cut(a)), cut(b)
        assert got[i] == (len(b), sum(n for h, n in new if (h, n) in old), len(new))


def test_snapshot_is_written_in_order(spark, tmp_path):
    from arbora.sources import tree

    rows = [("f", f"p{(i * 7919) % 100:03}", "File", i, "h", None, 420, {"a": 1}, i + 1, "") for i in range(100)]
    at = tree.save(entries(spark, rows).repartition(4), str(tmp_path / "index"), 1)
    got = [r["path"] for r in spark.read.parquet(at).orderBy(F.input_file_name(), F.monotonically_increasing_id()).select("path").collect()]
    assert got == sorted(got) and len(got) == 100


def test_formats_of_keys_whose_product_leaves_64_bits(spark, tmp_path):
    from arbora import catalog

    keys = [(1, 2), (2_000_000, 3_000_000), (36_000_001, 899_999), (5_000_000, 70_007), (9 * 10**15, 9 * 10**17), (0, 5), (3, None)]
    spark.createDataFrame(keys, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["id"]: r["bytes"] for r in catalog.QUERIES["text_formats"](spark, str(tmp_path)).collect()}
    assert got[1] == "2 B" and got[0] == "0 B" and got[2_000_000] == "12000000.00 TB"
    assert got[36_000_001] == "1166398768.80 TB" and got[5_000_000] == "1750175.00 TB"
    assert len(got) == len(keys) and got[9 * 10**15].startswith("729000000") and got[3] == "0 B"


def test_backlog_against_comparing_all(spark, monkeypatch):
    """Cursors at, between, before and beyond entries, in several stretches of numbers with holes, against all pairs."""
    rnd = random.Random(12)
    rows = [(f, f"p{s}", rnd.choice(["File", "File", "Deleted"]), rnd.choice([5, 3 << 20]), s) for f in "ab" for s in sorted(rnd.sample(range(1, 200_000), 300))]
    known = {(f"q{i}", f): rnd.choice([0, 200_001, rnd.choice(rows)[4], rnd.randrange(200_000)]) for i in range(20) for f in "abc"}
    own = {(p, f, n, k): rnd.choice(rows)[4] for p, f in list(known)[::2] + [("only", "a")] for n in (2, 3) for k in range(n) if rnd.random() < 0.6}
    entries_ = spark.createDataFrame(rows, "folder string, path string, kind string, size long, seq int")
    lane = {(r["folder"], r["seq"]): r["lane"] for r in entries_.select("folder", "seq", feed.lane(F.col("path"), F.col("kind"), F.col("size"), 3).alias("lane")).collect()}
    cursors = spark.createDataFrame([(*k, v) for k, v in known.items()], "peer string, folder string, value long")
    lanes = spark.createDataFrame([(*k, v) for k, v in own.items()], "peer string, folder string, lanes int, lane int, value long")
    want = {}
    for p, f in {*known, *[k[:2] for k in own]}:
        at = [own.get((p, f, 3, k), known.get((p, f), 0)) for k in range(3)]
        left = [r for r in rows if r[0] == f and r[4] > at[lane[f, r[4]]]]
        want[p, f] = (len(left), sum(r[2] == "File" for r in left), sum(r[3] for r in left if r[2] == "File"))
    numbered = []
    monkeypatch.setattr(feed, "running", lambda held, *a, **k: (numbered.append(held.count()), ranges.running(held, *a, **k))[1])
    df = feed.backlog(entries_, cursors, lanes, 3)
    assert max(numbered) <= 3 * 3 * (2 + (200_000 >> 14))  # stretches are sorted by ranges, entries aren't
    assert {(r["peer"], r["folder"]): (r["entries"], r["files"], r["bytes"]) for r in df.collect()} == want


def test_numbers_need_no_second_shuffle(spark):
    """The rows are shuffled into ranges; numbering them joins what ranges and groups begin with."""
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 5000).alias("x"), F.lit("y").alias("z"))
    told = ranges.running(rows, ["g"], ["x", -F.col("g")], drop=["z"])
    assert told.columns == ["g", "x", "n"]
    plan = told.select("x", "n")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan
    got = {r["x"]: r["n"] for r in told.collect()}
    for g in range(3):
        assert [got[x] for x in sorted(i * 7919 % 5000 for i in range(5000) if i % 3 == g)] == list(range(1, sum(i % 3 == g for i in range(5000)) + 1))


def test_parents_are_computed_once(spark):
    """What entries come from isn't run for both sides of the join, and is hashed, not sorted."""
    rows = spark.createDataFrame([("f", "a", 1, False, True), ("f", "a", 4, False, False), ("f", "a/b", 2, False, True), ("f", "a/b/c", 3, True, False), ("f", "x/y", 9, True, False)], "folder string, path string, seq long, large boolean, directory boolean")
    newest = diff.latest(rows)
    assert "SortAggregate" not in newest._jdf.queryExecution().sparkPlan().toString()
    df = reconcile.required_parents(newest, F.col("large"), F.col("directory"))
    assert "max_by" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in df.collect()} == {("f", "a/b/c", 4, 1), ("f", "x/y", 0, 1)}
