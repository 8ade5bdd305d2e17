"""The change feed as a stream: every version once over restarts, lanes and pages as the batch rules have them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from arbora.operators import feed
from arbora.sources.changes import ChangeReader, ChangeSource
from arbora.sources.fixtures import view

from .conftest import DATA


@pytest.fixture(scope="module")
def journal(spark):
    spark.dataSource.register(ChangeSource)
    rows = view(spark, DATA, "journal").filter("folder = 'N'").withColumn("seq", F.col("seq").cast("long"))
    return rows.withColumn("size", F.when(F.col("seq") % 5 == 0, F.col("size") * 100).otherwise(F.col("size"))).drop("folder").cache()


def _drain(spark, src, out, ck, lanes, rows=700):
    stream = spark.readStream.format("arbora_changes").option("path", src).option("lanes", lanes).option("rows", rows).load()
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None


@pytest.mark.parametrize("lanes", [1, 3])
def test_drained_with_restarts(spark, journal, tmp_path, lanes):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    head = journal.agg(F.max("seq")).first()[0]
    assert head > 1000
    cuts = [0, head // 3, head // 3 + 1, head]
    for low, high in zip(cuts, cuts[1:]):
        journal.filter(F.col("seq").between(low + 1, high)).repartition(3).write.mode("append").parquet(src)
        for _ in range(2):  # the second time there is nothing new
            _drain(spark, src, out, ck, lanes)
    got = spark.read.parquet(out)
    want = journal.withColumn("lane", feed.lane(F.col("path"), F.col("kind"), F.col("size"), lanes))
    names = sorted(want.columns)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, want.select(names).collect()))
    assert {r[0] for r in got.select("lane").distinct().collect()} == set(range(lanes))
    # A page is a legal batch, and a lane's pages follow on each other without overlap.
    batches = got.withColumn("batch", F.concat_ws(":", "lane", "prior")).withColumn("position", F.col("seq"))
    assert feed.illegal_batches(batches, lanes).count() == 0
    pages = got.groupBy("lane", "prior").agg(F.max("upto").alias("upto"), F.min("upto").alias("same"), F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))
    for p in pages.collect():
        assert p.upto == p.same and p.prior < p.first <= p.last <= p.upto and p.n <= (1 if p.lane else feed.PAGE)
    spans = sorted((p.lane, p.prior, p.upto) for p in pages.collect())
    assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:]) if a[0] == b[0])


def test_first_pages_are_those_of_the_batch_rule(spark, journal, tmp_path):
    src = str(tmp_path / "src")
    journal.repartition(4).write.parquet(src)
    _drain(spark, src, str(tmp_path / "out"), str(tmp_path / "ck"), 3, rows=10**6)
    got = spark.read.parquet(str(tmp_path / "out"))
    entries = journal.withColumn("folder", F.lit("N"))
    for lane in range(3):
        page, upto = feed.lane_page(entries, "N", 0, 3, lane)
        mine = got.filter((F.col("lane") == lane) & (F.col("prior") == 0))
        assert sorted(r[0] for r in mine.select("seq").collect()) == sorted(r[0] for r in page.select("seq").collect())
        assert {r[0] for r in mine.select("upto").collect()} == {upto.first()[0]}


def test_an_interrupted_batch_comes_again(spark, journal, tmp_path):
    """The sink fails after it has its rows; the next start gives the same batch once more, under the same number."""
    src, ck = str(tmp_path / "src"), str(tmp_path / "ck")
    journal.filter("seq <= 900").repartition(2).write.parquet(src)
    seen: dict[int, list[list[int]]] = {}

    def take(df, n):
        seen.setdefault(n, []).append(sorted(r[0] for r in df.select("seq").collect()))
        if n == 0 and len(seen[0]) == 1:
            journal.filter("seq > 900").write.mode("append").parquet(src)  # more comes before the restart
            raise RuntimeError("killed")

    def start():
        stream = spark.readStream.format("arbora_changes").option("path", src).option("rows", 100).load()
        stream.writeStream.foreachBatch(take).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="killed"):
        start()
    start()  # ends the batch that was open
    start()
    assert seen[0] == [list(range(1, 901))] * 2
    rest = sorted(s for n, runs in seen.items() if n for s in runs[-1])
    assert rest == list(range(901, journal.agg(F.max("seq")).first()[0] + 1))


def test_tasks_are_bounded_and_read_only_their_files(spark, journal, tmp_path):
    src = str(tmp_path / "src")
    for low in range(0, 900, 300):
        journal.filter(F.col("seq").between(low + 1, low + 300)).coalesce(1).write.mode("append").parquet(src)
    source = ChangeSource({"path": src, "lanes": "2", "rows": "150"})
    reader = source.streamReader(source.schema())
    assert isinstance(reader, ChangeReader) and reader.latestOffset() == {"seq": 900}
    parts = reader.partitions({"seq": 0}, {"seq": 900})
    assert len(parts) == 12 and all(p.upto - p.after <= 150 and len(p.files) == 1 for p in parts)
    assert reader.partitions({"seq": 900}, {"seq": 900}) == []
    for bad in ({"lanes": "0"}, {"lanes": "9"}, {"rows": "0"}):
        with pytest.raises(ValueError):
            ChangeSource({"path": src, **bad}).streamReader(source.schema())
