"""Timers of the stream against a replay with a clock that is set by hand."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from arbora.streaming import retries, watch


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    retries.enable(spark)
    yield spark
    spark.conf.set(key, was)


def replay(rows):
    """One folder: the loop goes second by second, first what is due, then what happens then."""
    out, retry, watch_at = [], None, None
    failures, backoff, tries = 0, 30, 0
    happen = {}
    for r in rows:
        happen.setdefault(r["at"], []).append(r)
    for now in range(min(happen), max(happen) + 1000):
        for r in [*happen.get(now, []), None]:
            for due in sorted(x for x in (retry and (retry[0], "scan"), watch_at and (watch_at[0], "watch")) if x):
                if due[0] > now:
                    continue
                if due[1] == "scan":
                    merged = {}
                    for p, s in retry[3]:
                        merged[p] = "Tree" if "Tree" in (s, merged.get(p)) else "Entry"
                    out += [(retry[0], "scan", retry[1], retry[2], p, s) for p, s in merged.items()] or [(retry[0], "scan", retry[1], retry[2], None, None)]
                    retry = None
                else:
                    out.append((watch_at[0], "watch", watch_at[1], watch_at[2], None, None))
                    watch_at = None
            if r is None:
                continue
            if r["what"] == "scan":
                if r["ok"]:
                    failures, retry = 0, None
                elif not r["full"] and failures < 3:
                    failures += 1
                    retry = (now + 2**failures, failures, 2**failures, r["paths"])
            elif r["what"] == "watch" and r["ok"]:
                backoff, tries, watch_at = 30, 0, None
            elif r["what"] == "rescan":
                tries += 1
                watch_at = (now, tries, 0)
            else:
                wait = max(backoff, r["rescan_s"], 5) if r["what"] == "watch" and r["quota"] else backoff
                tries += 1
                watch_at = (now + wait, tries, wait)
                backoff = min(backoff * 2, 300)
    return sorted(out, key=repr)


def outcomes(seed, folders=6, n=60):
    rng, rows = random.Random(seed), []
    for k in range(folders):
        at = 1000
        for i in range(n):
            at += rng.choice([0, 1, 2, 3, 5, 9, 40, 150])
            what = rng.choices(["scan", "watch", "restart", "rescan"], [6, 3, 1, 0.5])[0]
            paths = [(f"d{rng.randrange(3)}", rng.choice(["Tree", "Entry"])) for _ in range(rng.randrange(4))]
            rows.append({"event_id": len(rows), "key": f"k{k}", "at": at, "what": what, "ok": rng.random() < 0.3, "full": rng.random() < 0.2, "quota": rng.random() < 0.3, "rescan_s": rng.choice([0, 60, 400]), "paths": paths})
    return rows


def run(spark, tmp_path, rows, cuts):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    made = spark.createDataFrame([tuple(r[c] for c in ("event_id", "key", "at", "what", "ok", "full", "quota", "rescan_s", "paths")) for r in rows], retries.OUTCOME.replace("at timestamp", "at long"))
    made = made.withColumn("at", F.timestamp_seconds("at"))
    last = max(r["at"] for r in rows)
    for low, high in zip([0, *cuts], [*cuts, last]):
        made.filter((F.col("at") > F.timestamp_seconds(F.lit(low))) & (F.col("at") <= F.timestamp_seconds(F.lit(high)))).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(retries.OUTCOME).parquet(src)
        watch.drain(retries.timed(stream, "0 seconds"), out, ck)
    # Time goes on, far beyond all timers.
    spark.sql(f"select -1L as event_id, 'clock' as key, timestamp_seconds({last + 5000}) as at, 'scan' as what, true as ok, true as full, false as quota, 0L as rescan_s, cast(null as array<struct<path string, scope string>>) as paths").write.mode("append").parquet(src)
    watch.drain(retries.timed(spark.readStream.schema(retries.OUTCOME).parquet(src), "0 seconds"), out, ck)
    got = spark.read.parquet(out).select("key", F.unix_seconds("due"), "what", "attempt", "delay_s", "path", "scope").collect()
    told = {}
    for key, *row in got:
        told.setdefault(key, []).append(tuple(row))
    return {k: sorted(v, key=repr) for k, v in told.items()}


def test_attempts_as_replayed(rocks, tmp_path):
    rows = outcomes(5)
    want = {k: replay([r for r in rows if r["key"] == k]) for k in sorted({r["key"] for r in rows})}
    times = sorted(r["at"] for r in rows)
    one = run(rocks, tmp_path / "one", rows, [])
    assert one == want and sum(map(len, want.values())) > 100
    # Cut into triggers with restarts between: the same.
    assert run(rocks, tmp_path / "cut", rows, [times[len(times) // 3], times[len(times) // 2]]) == want


def test_fixed_delays(rocks, tmp_path):
    """Three retries of a pass that goes on failing, 2, 4 and 8 s later; watches after 30 s and twice as long up to 300 s."""
    row = lambda at, what, **more: {"event_id": at, "key": "k", "at": at, "what": what, "ok": False, "full": False, "quota": False, "rescan_s": 0, "paths": [("a", "Entry"), ("a", "Tree")], **more}
    scans = [row(at, "scan") for at in (100, 110, 120, 130, 140)]
    watches = [row(at, "watch") for at in (1000, 2000, 3000, 4000, 5000)] + [row(6000, "watch", quota=True, rescan_s=900), row(8000, "watch", ok=True), row(8001, "restart"), row(9000, "rescan")]
    got = run(rocks, tmp_path, scans + watches, [])["k"]
    assert [g for g in got if g[1] == "scan"] == [(102, "scan", 1, 2, "a", "Tree"), (114, "scan", 2, 4, "a", "Tree"), (128, "scan", 3, 8, "a", "Tree")]
    assert [(g[0], g[2], g[3]) for g in got if g[1] == "watch"] == [(1030, 1, 30), (2060, 2, 60), (3120, 3, 120), (4240, 4, 240), (5300, 5, 300), (6900, 6, 900), (8031, 1, 30), (9000, 2, 0)]
