"""Automata over blocks of rows against folds of whole keys."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arbora.operators import automata, events, report, subtrees


@pytest.fixture
def many_ranges(spark):
    """As many ranges as there are partitions, however small."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    was, parts = spark.conf.get(key), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(key, "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.set(key, was)
    spark.conf.set("spark.sql.shuffle.partitions", parts)


def keyed(rnd, n):
    """Keys of which one has most rows, and one is null."""
    return ["hot" if rnd.random() < 0.7 else rnd.choice(["a", "b", "c", None]) for _ in range(n)]


def by_key(rows):
    for k in ("hot", "a", "b", "c", None):
        yield [r for r in rows if r[0] == k]


@pytest.mark.parametrize("seed", range(3))
def test_stepped(spark, many_ranges, seed):
    rnd = random.Random(seed)
    table = [[rnd.randrange(5) for _ in range(5)] for _ in range(3)]
    rows = [(k, i, rnd.choice([0, 1, 1, 2, None])) for i, k in enumerate(keyed(rnd, 3000))]
    want = {}
    for mine in by_key(rows):
        state = 2
        for _, i, said in mine:
            want[i] = state
            state = table[said or 0][state]
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    got = automata.stepped(spark.createDataFrame(shuffled, "k string, i long, said int"), ["k"], ["i"], "said", table, begin=2)
    assert {r["i"]: r["state"] for r in got.collect()} == want


def naive(rows, window, gap):
    """i -> (begins, began, turn), rows in order."""
    out, began, turn, last, tag = {}, None, 0, None, None
    for _, i, t, g in rows:
        new = last is None or g is None or tag is None or g != tag or (gap is not None and t - last > gap) or t >= began + window
        if new:
            began, turn = t, turn + 1
        out[i], last, tag = (new, began, turn), t, g
    return out


@pytest.mark.parametrize("seed,window,gap,tags", [(1, 30, None, [1]), (2, 200, 9, [1]), (3, 50, None, [1, 1, 1, 1, 2, None]), (4, 10**6, None, [1]), (5, 10**6, 12, [7, 7, 7, 8]), (6, 1, None, [1]), (7, 700, None, [1])])
def test_renewed(spark, many_ranges, seed, window, gap, tags):
    rnd = random.Random(seed)
    rows, t, tag = [], 0, tags[0]
    for i, k in enumerate(keyed(rnd, 3000)):
        t += rnd.choice([0, 0, 1, 2, 5])
        tag = rnd.choice(tags) if rnd.random() < 0.03 else tag
        rows.append((k, i, t, tag))
    want: dict = {}
    for mine in by_key(rows):
        want |= naive(mine, window, gap)
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "k string, i long, t long, g int").repartition(4)
    got = automata.renewed(df, ["k"], ["t", "i"], "t", window, "g", gap).collect()
    assert {r["i"]: (r["begins"], r["began"], r["turn"]) for r in got} == want and len(got) == 3000


def test_a_key_is_many_tasks(spark, many_ranges):
    """A key with most of the rows is several blocks, and none of its rows is gathered."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id", F.lit(True).alias("said"))
    blocks = automata._blocks(rows, ["k"], ["id"], ["said"], "__x int", "int", lambda columns, edges: ([[0] * len(columns["said"])], [0] * (len(edges) - 1)))
    assert blocks.filter("k = 'hot'").select("__p").distinct().count() >= 3
    assert blocks.filter("__exit is not null").count() <= 2 * 9
    plan = automata.stepped(rows, ["k"], ["id"], "said", [[0], [0]])._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan.split("Generate")[0]


def test_nothing_to_go_through(spark):
    none = spark.createDataFrame([], "k string, i long, t long, g int")
    assert automata.renewed(none, ["k"], ["t", "i"], "t", 5, "g").collect() == [] and automata.stepped(none, ["k"], ["i"], "g", [[0]]).collect() == []
    with pytest.raises(ValueError):
        automata.stepped(none, ["k"], ["i"], "g", [[1]])


def test_suppression_of_a_hot_key(spark, many_ranges):
    """One key says the same for a long time, in several ranges; long details are never equal."""
    rnd = random.Random(3)
    rows, t = [], 0
    for i in range(4000):
        t += rnd.choice([0, 1, 3])
        rows.append((i, "u" if rnd.random() < 0.9 else "v", t, "error" if rnd.random() < 0.97 else "index", rnd.choice(["same"] * 30 + ["x" * 600])))
    want, last = set(), {}
    for i, k, t, kind, detail in rows:
        if k not in last or last[k][:2] != (kind, detail) or t - last[k][2] >= 30:
            want.add(i)
            last[k] = (kind, detail[:500], t)
    got = report.suppressed(spark.createDataFrame(rows, "event_id long, k string, at long, kind string, detail string"), "k").collect()
    assert {r["event_id"] for r in got} == want and max(len(r["detail"]) for r in got) == 500


def test_batches_of_a_hot_key(spark, many_ranges):
    """A key that never falls silent: batches go on across ranges."""
    rnd = random.Random(8)
    rows, t = [], 0
    for i in range(5000):
        t += rnd.choice([0, 10_000, 60_000, 99_999])
        rows.append((i, "hot" if i % 3 else f"k{i % 7}", t))
    want: dict = {}
    for k in {r[1] for r in rows}:
        first = last = None
        n = 0
        for i, _, t in [r for r in rows if r[1] == k]:
            if first is None or t > min(first + events.MAX_US, last + events.GAP_US):
                first, n = t, n + 1
            want[i], last = (first, n), t
    got = events.batches(spark.createDataFrame(rows, "event_id long, k string, us long"), "k")
    assert {r["event_id"]: (r["batch_start"], r["batch"]) for r in got.collect()} == want


def test_a_range_is_gone_through_in_pages(spark):
    """However many rows a range has, the pass holds a page of them, and says the same."""
    rows = spark.range(0, 100_000, 1, 3).select(F.expr("id div 60000").alias("k"), "id", (F.col("id") * 3).alias("t"), F.lit("x").alias("g"))
    sizes = automata._blocks(rows.coalesce(1), ["k"], ["id"], ["t"], "__x long", "int", lambda columns, edges: ([[len(columns["t"])] * len(columns["t"])], [0] * (len(edges) - 1)))
    assert max(r[0] for r in sizes.select("__x").distinct().collect()) <= 1 << 15
    order = [r["id"] for r in sizes.orderBy("__p", "__i").select("id").collect()]
    assert order == list(range(100_000))
    got = automata.renewed(rows, ["k"], ["t", "id"], "t", 1000, "g")
    turn = F.expr("id % 60000 * 3 div 1002")
    assert got.filter((F.col("turn") != turn + 1) | (F.col("began") != F.col("k") * 180_000 + turn * 1002) | (F.col("begins") != (F.col("t") == F.col("began")))).count() == 0


def test_large_rows_are_small_pages():
    batch = pa.record_batch({"x": ["y" * (1 << 20)] * 40})
    pages = list(automata._pages(iter([batch.slice(i, 1) for i in range(40)]), 1000))
    assert [len(p) for p in pages][0] < 40 and sum(map(len, pages)) == 40
    assert [len(p) for p in automata._pages(iter([pa.record_batch({"x": list(range(25))}), pa.record_batch({"x": [1]})]), 10)] == [10, 10, 6]


@pytest.fixture
def passes(monkeypatch):
    """What the passes of a rule make, in their order."""
    made = []
    for module in (automata, subtrees):
        monkeypatch.setattr(module, "_blocks", lambda *a, f=module._blocks, **b: made.append(f(*a, **b)) or made[-1])
    return made


def page_sizes(passes):
    """The rows of the largest page of each pass."""
    return [df.groupBy("__p").count().agg(F.max("count")).first()[0] for df in passes]


def many(spark):
    """160,000 events of one key in batches of 1,001; each tenth is on a folder, and the nine after it are below it."""
    i = F.col("id")
    path = F.concat(F.lit("d"), F.expr("string(id div 10)"), F.when(i % 10 > 0, F.concat(F.lit("/f"), i.cast("string"))).otherwise(""))
    return spark.range(160_000).select(i.alias("event_id"), F.lit("u").alias("k"), (i * 1000).alias("us"), path.alias("path"), F.when(i % 10 > 0, "Entry").otherwise("Tree").alias("scope"))


def test_coalescing_holds_pages(spark, passes):
    """Neither batches nor what they leave hold a range in a task's Python."""
    left = events.coalesced(events.batches(many(spark), "k"), ["k", "batch"])
    got = {(r["batch"], r["path"]) for r in left.select("batch", "path").collect()}
    alone = [i for i in range(160_000) if i % 10 == 0 or i // 1001 != (i - i % 10) // 1001]
    assert got == {(i // 1001 + 1, f"d{i // 10}/f{i}" if i % 10 else f"d{i // 10}") for i in alone}
    sizes = page_sizes(passes)
    assert len(sizes) == 2 and max(sizes) <= 1 << 15


def test_directing_holds_pages(spark, passes):
    """What batches ask for takes three passes, and none holds a range; a rescan in the first batch makes it a full scan."""
    asked = events.directed(many(spark).withColumn("control", F.when(F.col("event_id") == 5, "rescan")), "k")
    got = {(r["batch"], r["path"], r["scope"]) for r in asked.select("batch", "path", "scope").collect()}
    alone = [i for i in range(1001, 160_000) if i % 10 == 0 or i // 1001 != (i - i % 10) // 1001]
    want = {(i // 1001 + 1, f"d{i // 10}/f{i}" if i % 10 else f"d{i // 10}", "Entry" if i % 10 else "Tree") for i in alone}
    assert got == want | {(1, "", "Rescan"), (1, "", "Full")}
    sizes = page_sizes(passes)
    assert len(sizes) == 3 and max(sizes) <= 1 << 15


def test_suppression_holds_pages(spark, passes):
    """One key says the same without end, in one pass that holds no range."""
    said = spark.range(160_000).select(F.col("id").alias("event_id"), F.lit("u").alias("k"), F.col("id").alias("at"), F.lit("error").alias("kind"), F.lit("same").alias("detail"))
    assert {r["event_id"] for r in report.suppressed(said, "k").select("event_id").collect()} == set(range(0, 160_000, 30))
    sizes = page_sizes(passes)
    assert len(sizes) == 1 and max(sizes) <= 1 << 15
