"""Status and activity: rates, suppression, filters, formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import automata, selection

#: What makes an event an issue, how many events stay, and how long a detail may be.
ISSUES = ("error", "conflict", "fail", "pending", "reject", "overflow", "approval", "warning")
RECEIVED, EVENTS, DETAIL = 16, 64, 500


def rates(samples: DataFrame, by: str, at: str = "at", total: str = "total") -> DataFrame:
    """samples with the change of `total` per second since the one before."""
    w = Window.partitionBy(by).orderBy(at)
    dt = F.col(at) - F.lag(at).over(w)
    return samples.withColumn("rate", F.when(dt > 0, F.greatest(F.col(total) - F.lag(total).over(w), F.lit(0)) / dt))


def rate_history(samples: DataFrame, stale: int = 5, keep: int = 60) -> DataFrame:
    """The last samples since the process (pid, started) changed, their rate zero when older than `stale` at the time."""
    w = Window.partitionBy("source").orderBy("at")
    new = (F.lag("pid").over(w) != F.col("pid")) | (F.lag("started").over(w) != F.col("started"))
    runs = samples.withColumn("run", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w))
    last = runs.groupBy("source").agg(F.max("run").alias("run"))
    newest = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("at")))
    shown = F.when(F.col("at") - F.col("updated") >= stale, 0.0).otherwise(F.col("rate"))
    return runs.join(last, ["source", "run"]).withColumn("n", newest).filter(F.col("n") <= keep).withColumn("rate", shown).drop("run")


def suppressed(events: DataFrame, by: str, within: int = 30) -> DataFrame:
    """Events that are kept: one whose kind and detail are those of the last kept one, less than `within` seconds before, is
    dropped, and doesn't restart the time.

    Details longer than DETAIL are cut when kept, so they never equal the next one."""
    tag = F.when(F.length("detail") <= DETAIL, F.concat(F.length("kind").cast("string"), F.lit(":"), "kind", "detail"))
    rows = events.withColumns({"__at": F.col("at").cast("long"), "__tag": tag})
    kept = automata.renewed(rows, [by], ["__at", "event_id"], "__at", within, "__tag").filter("begins")
    return kept.select(*[c for c in events.columns if c != "detail"], F.substring("detail", 1, DETAIL).alias("detail"))


def ring(events: DataFrame, by: str) -> DataFrame:
    """The newest events of each key: `received` ones beyond the newest RECEIVED go first, then all beyond EVENTS."""
    received = F.col("kind") == "received"
    a = F.row_number().over(Window.partitionBy(by, received).orderBy(F.desc("at"), F.desc("event_id")))
    kept = events.withColumn("a", a).filter(~received | (F.col("a") <= RECEIVED))
    b = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("at"), F.desc("event_id")))
    return kept.withColumn("b", b).filter(F.col("b") <= EVENTS).drop("a", "b")


def accepts(kind: Column, view: str) -> Column:
    """Whether a view shows an event: all, index, issues or activity."""
    issue = F.lit(False)
    for word in ISSUES:
        issue = issue | F.contains(kind, F.lit(word))
    return {"all": F.lit(True), "index": kind == "received", "issues": issue, "activity": kind != "received"}[view]


def matches(kind: Column, folder: Column, detail: Column, query: str) -> Column:
    line = F.concat_ws(" ", kind, F.coalesce(folder, F.lit("")), detail)
    return F.contains(F.lower(line), F.lit(query.lower()))


def alive(pid: Column, updated: Column, now: Column) -> Column:
    return (pid != 0) & (now - updated < 5)


def phase(error: Column, native: Column, partial: Column) -> Column:
    return F.when(error.isNotNull(), "incomplete").when(native & partial, "partial").when(native, "watching").otherwise("polling")


def connected(lanes: DataFrame) -> DataFrame:
    """Peers with a lane online, and how many."""
    return lanes.select("peer", "lane").distinct().groupBy("peer").agg(F.count("*").alias("lanes"))


def bytes_text(n: Column) -> Column:
    n = F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), 0.0).otherwise(F.greatest(n, F.lit(0.0)))
    out = F.format_string("%.0f B", n)
    for scale, unit in ((1e3, "kB"), (1e6, "MB"), (1e9, "GB"), (1e12, "TB")):
        out = F.when(n >= scale, F.format_string(f"%.2f {unit}", n / scale)).otherwise(out)
    return out


def count_text(n: Column) -> Column:
    return F.format_number(n, 0)


def age_text(n: Column) -> Column:
    part = lambda x: F.floor(x).cast("string")
    return F.when(n < 60, F.concat(n.cast("string"), F.lit("s"))).when(n < 3600, F.concat(part(n / 60), F.lit("m "), (n % 60).cast("string"), F.lit("s"))).otherwise(F.concat(part(n / 3600), F.lit("h "), part(n % 3600 / 60), F.lit("m")))


def cleaned(text: Column) -> Column:
    """Without control characters and those that turn the direction of text."""
    return F.regexp_replace(text, "[\\x00-\\x1f\\x7f-\\x9f\\u202a-\\u202e\\u2066-\\u2069]", "")


def distribution(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """Least, median, nearest-rank 95th percentile and largest, and the number of samples that have a value."""
    about = samples.groupBy(*by).agg(F.min(value).alias("least"), F.max(value).alias("largest"), F.count(value).alias("samples")).filter("samples > 0")
    n = F.col("samples")
    ranks = F.array(F.expr("(samples + 1) div 2"), F.expr("samples div 2 + 1"), F.ceil(n * 95 / 100))
    found = selection.selected(samples, by, value, about.select(*by, F.posexplode(ranks).alias("target", "rank")))
    at = lambda i: F.max(F.when(F.col("target") == i, F.col("value")))
    told = found.groupBy(*by).agg(((at(0) + at(1)) / 2).alias("median"), at(2).alias("p95"))
    same = F.lit(True)
    for c in by:
        same = same & about[c].eqNullSafe(told[c])
    return about.join(told, same).select(*[about[c] for c in by], "least", "median", F.col("p95").cast(samples.schema[value].dataType).alias("p95"), "largest", "samples")
