"""Indexes laid out for lookups, and the walk over real trees."""

from __future__ import annotations

import hashlib
import os
import socket

import pytest
from pyspark.sql import functions as F

from arbora import storage
from arbora.operators import diff
from arbora.sources import index, tree, walk


def entries(spark, n=20_000):
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, "f").otherwise("g").alias("folder"), F.concat(F.lit("Dir/"), F.sha2(F.col("id").cast("string"), 256)).alias("path"), F.col("id").alias("size"), F.sha2(F.concat(F.lit("x"), F.col("id").cast("string")), 256).alias("hash"))


def scanned(df):
    """Rows that the scan of a query gave, after it ran."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.head().metrics().get("numOutputRows").get().value()


def test_join_in_place(spark):
    with storage.scratch():
        a = index.build(entries(spark), 4, key=F.lower("path"))
        b = index.build(entries(spark).filter("size % 2 = 0"), 4, key=F.lower("path"))
        df = index.joined(spark, a, b)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert df.filter("hash = right_hash and size = right_size and path_key = right_path_key").count() == 10_000
        assert index.joined(spark, a, b, "left").filter("right_size is null").count() == 10_000
    assert not spark.catalog.tableExists(a)


def test_lookups_skip_row_groups(spark):
    with storage.scratch():
        name = index.build(entries(spark), 4, key=F.lower("path"), group_bytes=32 << 10)
        one = spark.table(name).filter("size = 4711").first()
        by_path, by_key = index.at_path(spark, name, one["folder"], one["path"]), index.at_key(spark, name, one["folder"], one["path"].lower())
        assert by_path.collect() == by_key.collect() == [one]
        assert scanned(by_path) < 5_000 and scanned(by_key) < 15_000
        # No range of keys tells that this one isn't there; the filters do.
        assert scanned(index.at_key(spark, name, "f", "dir/" + "8" * 64)) < 3_000
        assert index.at_path(spark, name, "nowhere", one["path"]).count() == 0


@pytest.fixture
def forest(tmp_path):
    root = tmp_path / "t"
    for i in range(30):
        (root / f"d{i % 5}" / f"e{i % 3}").mkdir(parents=True, exist_ok=True)
        (root / f"d{i % 5}" / f"e{i % 3}" / f"f{i}.txt").write_bytes(b"%d" % i * i)
    (root / "link").symlink_to("d1/nothing")
    (root / "d2" / "loop").symlink_to("..")
    (root / "empty").mkdir()
    os.chmod(root / "d0" / "e0" / "f0.txt", 0o640)
    return root


def test_walk(spark, forest):
    with socket.socket(socket.AF_UNIX) as s:
        s.bind(str(forest / "s"))
        want = {}
        for at, names, files in os.walk(forest):
            for n in [*names, *files]:
                p = os.path.join(at, n)
                want[os.path.relpath(p, forest)] = os.lstat(p)
        for tasks in (1, 4, 64):
            listing = tree.walked(spark, str(forest), "f", tasks=tasks)
            got = {r["path"]: r for r in listing.collect()}
            assert set(got) == set(want) and listing.count() == len(want)
    for p, st in want.items():
        r = got[p]
        assert (r["mode"], r["ino"], r["dev"], r["size"]) == (st.st_mode, st.st_ino, st.st_dev, st.st_size)
        assert (r["mtime"] * 10**9 + r["mtime_nsec"], r["ctime"] * 10**9 + r["ctime_nsec"]) == (st.st_mtime_ns, st.st_ctime_ns)
    assert got["s"]["kind"] == "Other" and got["link"]["target"] == "d1/nothing" and got["d2/loop"]["kind"] == "Symlink" and got["empty"]["kind"] == "Directory"
    seen = {r["path"]: r for r in tree.observed(listing).collect()}
    assert "s" not in seen and seen["d0/e0/f0.txt"]["mode"] == 0o640 and seen["link"]["hash"] == hashlib.sha256(b"d1/nothing").hexdigest()
    assert seen["d3/e1/f13.txt"]["hash"] == hashlib.sha256(b"13" * 13).hexdigest() and seen["d3/e1/f13.txt"]["size"] == 26 and len(seen["link"]["stamp"].split(":")) == 7
    quick = tree.walked(spark, str(forest), "f", content=False)
    assert quick.filter("hash is not null").count() == 0 and quick.count() == len(want)


def test_a_file_is_hashed_in_pieces(spark, tmp_path):
    size = (2 << 30) + 5
    with open(tmp_path / "big", "wb") as f:
        f.truncate(size)
    told = hashlib.sha256()
    piece = bytes(1 << 24)
    for _ in range(size >> 24):
        told.update(piece)
    told.update(bytes(size % (1 << 24)))
    (r,) = tree.observed(tree.walked(spark, str(tmp_path), "f")).collect()
    assert (r["size"], r["hash"]) == (size, told.hexdigest())


def test_what_cannot_be_read(spark, forest, monkeypatch):
    """The walk goes on past it, and deletions are put off."""
    scandir, lstat = os.scandir, os.lstat

    def closed(path):
        if str(path).endswith("d1"):
            raise PermissionError(13, "closed")
        return scandir(path)

    def gone(path, **more):
        if str(path).endswith("/f7.txt"):
            raise FileNotFoundError(2, "gone")
        return lstat(path, **more)

    monkeypatch.setattr(os, "scandir", closed)
    monkeypatch.setattr(os, "lstat", gone)
    for tasks in (1, 3, 50):
        reader = walk.TreeReader(str(forest), "f", tasks, True)
        rows = {(r[1], r[2] == "Error"): r for part in reader.partitions() for r in reader.read(part)}
        assert {p: r[-1] for (p, bad), r in rows.items() if bad} == {"d1": "EACCES", "d2/e1/f7.txt": "ENOENT"} and ("d3/e1/f13.txt", False) in rows
    monkeypatch.undo()
    listing = tree.walked(spark, str(forest / "nowhere"), "f")
    assert [(r["path"], r["error"]) for r in listing.collect()] == [("", "ENOENT")]
    assert [(r["message"], r["total"]) for r in diff.scan_errors(tree.failures(listing)).collect()] == [("ENOENT", 1)]


def test_wide_folders_are_dealt(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(walk, "FILES", 10)
    for i in range(95):
        (tmp_path / f"f{i}").write_text("x")
    reader = walk.TreeReader(str(tmp_path), "f", 4, False)
    parts = reader.partitions()
    assert len(parts) == 10 and sorted(r[1] for p in parts for r in reader.read(p)) == sorted(f"f{i}" for i in range(95))
