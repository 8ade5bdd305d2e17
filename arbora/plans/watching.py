"""Queries on watcher events, schedules and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events, report
from ..sources.fixtures import sql_with, view
from .base import query, table

GAP, MOST = 1_800_000_000, 7_200_000_000
_SCOPE = "case when kind = 'Access' then null when kind = 'Modify(Data)' then 'Entry' else 'Tree' end"
_BATCH = sql_with("fs_events") + f""", e as (select *, {_SCOPE} as scope, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as n from fs_events),
r as (select user_id, event_id, n, us, us as first, us as last, 1 as batch from e where n = 1
  union all select e.user_id, e.event_id, e.n, e.us, case when e.us > least(r.first + {MOST}, r.last + {GAP}) then e.us else r.first end, e.us, r.batch + case when e.us > least(r.first + {MOST}, r.last + {GAP}) then 1 else 0 end
  from r join e on e.user_id = r.user_id and e.n = r.n + 1),
b as (select e.user_id, e.event_id, e.path, e.scope, r.batch, r.first as batch_start from e join r using (user_id, event_id)),
p as (select user_id, batch, path, max(scope) as scope, count(*) as events from b where scope is not null group by 1, 2, 3),
c as (select * from p where not exists (select 1 from p q where q.user_id = p.user_id and q.batch = p.batch and q.scope = 'Tree' and starts_with(p.path, q.path || '/')))"""
_BATCH = _BATCH.replace("with fs_events", "with recursive fs_events", 1)


def _events(spark, d):
    e = view(spark, d, "fs_events")
    return e.withColumns({"us": F.unix_micros(F.col("ts").cast("timestamp")), "scope": events.scope(F.col("kind"))})


def _shorter(df):
    """Every third event is on a folder, so that trees have something below them."""
    return df.withColumn("path", F.when(F.col("event_id") % 3 == 0, F.substring_index("path", "/", 2)).otherwise(F.col("path")))


def _batched(spark, d, short=False):
    e = _events(spark, d)
    return events.batches(_shorter(e) if short else e, "user_id", "us", GAP, MOST)


_SHORT = _BATCH.replace("as (select *, case when kind", "as (select * replace (case when event_id % 3 = 0 then array_to_string(string_split(path, '/')[1:2], '/') else path end as path), case when kind", 1)


@query("event_scope", f"{sql_with('fs_events')} select kind, {_SCOPE} as scope, count(*) as events from fs_events group by 1, 2")
def event_scope(spark, d):
    return _events(spark, d).groupBy("kind", "scope").agg(F.count("*").alias("events"))


@query("event_control", f"{sql_with('fs_events')} select control, count(*) as events from (select case when event_id % 101 = 0 then 'restart' when event_id % 97 = 0 then 'rescan' when event_id % 89 = 0 then 'drop' when path like '%/d3/%' then 'drop' end as control from fs_events) group by 1")
def event_control(spark, d):
    i = F.col("event_id")
    c = events.control(F.col("path"), i % 101 == 0, i % 97 == 0, i % 89 == 0, ["d3"])
    return _events(spark, d).groupBy(c.alias("control")).agg(F.count("*").alias("events"))


@query("event_batches", f"{_BATCH} select user_id, event_id, batch::int as batch, batch_start from b")
def event_batches(spark, d):
    return _batched(spark, d).select("user_id", "event_id", "batch", "batch_start")


@query("event_coalesce", f"{_SHORT} select user_id, batch::int as batch, path, scope, events from c")
def event_coalesce(spark, d):
    return events.coalesced(_batched(spark, d, True), ["user_id", "batch"])


_CONTROL = "case when event_id % 101 = 0 then 'restart' when event_id % 97 = 0 then 'rescan' when event_id % 89 = 0 or path like '%/d3/%' then 'drop' when event_id % 83 = 0 then 'reload' end"


_DIRECTED = _SHORT.replace("order by ts, event_id) as n from fs_events", f"order by ts, event_id) as n, {_CONTROL} as control from fs_events where ({_CONTROL}) is distinct from 'drop'")
_DIRECTED = _DIRECTED.replace("e.scope, r.batch", "e.scope, e.control, r.batch").replace("p as (select", "u as (select user_id, batch, control, count(*) as n from b where control is not null group by 1, 2, 3),\np as (select")
_DIRECTED = _DIRECTED.replace("from b where scope is not null", "from b where scope is not null and not exists (select 1 from u where u.user_id = b.user_id and u.batch = b.batch)")


@query(
    "directed_batches",
    f"{_DIRECTED} select user_id, batch::int as batch, path, scope, events from c union all select user_id, batch::int, '', upper(control[1]) || control[2:], n from u union all select user_id, batch::int, '', 'Full', sum(n)::bigint from u group by 1, 2",
)
def directed_batches(spark, d):
    i = F.col("event_id")
    called = F.when(i % 101 == 0, "restart").when(i % 97 == 0, "rescan").when((i % 89 == 0) | F.col("path").like("%/d3/%"), "drop").when(i % 83 == 0, "reload")
    return events.directed(_shorter(_events(spark, d).withColumn("control", called)), "user_id", "us", GAP, MOST).select("user_id", "batch", "path", "scope", "events")


def _held(source: str, by: str) -> str:
    """CTEs: `full_`, the batches of `source` (by, event_id, path, scope) and the most paths each held at a time."""
    return f"""one as (select {by}, path, min(event_id) as f from {source} where scope is not null group by all), tr as (select {by}, path as parent, min(event_id) as t from {source} where scope = 'Tree' group by all),
gone as (select one.*, (select min(t) from tr where {' and '.join(f'tr.{c} = one.{c}' for c in by.split(', '))} and starts_with(one.path, tr.parent || '/')) as g from one),
step as (select {by}, f as place, 1 as d from gone where g is null or f < g union all select {by}, g, -1 from gone where f < g),
full_ as (select {by}, max(held)::bigint as held from (select {by}, sum(d) over (partition by {by} order by place, d) as held from step) group by all)"""


@query("event_counters", f"{_SHORT}, {_held('b', 'user_id, batch')}, l as (select user_id, batch, count(*) as paths from c group by 1, 2), s as (select user_id, batch, count(*) as events, count(*) filter (where scope is null) as ignored from b group by 1, 2), t as (select s.*, case when held > 4 then 0 else coalesce(paths, 0) end as paths, case when held > 4 then 1 else 0 end as overflows from s left join l using (user_id, batch) left join full_ using (user_id, batch)) select user_id, batch::int as batch, events, ignored, paths, events - ignored - paths as coalesced, overflows from t")
def event_counters(spark, d):
    return events.counters(_batched(spark, d, True), ["user_id", "batch"], 4)


_ALL = f"{sql_with('fs_events')}, e as (select user_id, event_id, case when event_id % 3 = 0 then array_to_string(string_split(path, '/')[1:2], '/') else path end as path, {_SCOPE} as scope from fs_events), {_held('e', 'user_id')}"


@query("overflow_batches", f"{_ALL} select user_id, held as paths from full_ where held > 8")
def overflow_batches(spark, d):
    return events.overflowing(_shorter(_events(spark, d)), ["user_id"], 8)


@query("scan_routes", f"{_SHORT}, k as (select distinct path from fs_events where event_id % 2 = 0) select user_id, batch::int as batch, path, case when scope = 'Tree' or k.path is null then 'tree' else 'entry' end as route from c left join k using (path)")
def scan_routes(spark, d):
    known = _events(spark, d).filter("event_id % 2 = 0").select("path", F.lit("File").alias("kind"))
    return events.routes(events.coalesced(_batched(spark, d, True), ["user_id", "batch"]), known).select("user_id", "batch", "path", "route")


@query("retry_merge", f"{sql_with('fs_events')}, e as (select path, max({_SCOPE}) as scope, max(event_id % 4) as attempt from fs_events where kind <> 'Access' group by 1) select path, scope, attempt, pow(2, attempt)::bigint as delay_s from e where attempt < 3")
def retry_merge(spark, d):
    pending = _events(spark, d).filter("scope is not null").select("path", "scope", (F.col("event_id") % 4).alias("attempt"))
    return events.retried(pending)


@query("retry_backoff", "select s_suppkey as id, case when s_suppkey % 3 = 0 then greatest(least(300, 30 * pow(2, s_suppkey % 6))::bigint, s_suppkey * 7, 5) else least(300, 30 * pow(2, s_suppkey % 6))::bigint end as seconds from supplier")
def retry_backoff(spark, d):
    i = F.col("s_suppkey")
    return table(spark, d, "supplier").select(i.alias("id"), events.watch_backoff(i % 6, i % 3 == 0, i * 7).alias("seconds"))


@query("coverage_gaps", f"{sql_with('fs_events')}, g as (select distinct case when event_id % 3 = 0 then array_to_string(string_split(path, '/')[1:2], '/') else path end as path from fs_events where event_id % 10 >= 4) select path from g where not exists (select 1 from g h where starts_with(g.path, h.path || '/'))")
def coverage_gaps(spark, d):
    g = _shorter(_events(spark, d)).select("path", (F.col("event_id") % 10).alias("generation"))
    return events.open_gaps(g, 4)


@query("watch_demand", f"{sql_with('replica_a')}, f as (select folder, folder like '%1' as paused, count(*) filter (where kind = 'Directory' and path not like '%/d5/%') as directories from replica_a group by 1) select folder, paused, directories, directories + 2 as watches from f")
def watch_demand(spark, d):
    a = view(spark, d, "replica_a")
    folders = a.select("folder").distinct().withColumn("paused", F.col("folder").like("%1"))
    return events.watch_demand(a, folders, F.col("path").like("%/d5/%"))


@query("watch_limit", "select o_orderkey as id, greatest(ceil((o_custkey * 997 + greatest(floor(o_custkey * 997 / 4), 65536)) / 65536.0)::bigint * 65536, 524288) as suggested from orders")
def watch_limit(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), events.suggested_limit(F.col("o_custkey") * 997, F.lit(524288)).cast("long").alias("suggested"))


_TEMP = "select event_id as tick, user_id as sensor, case when event_id % 50 = 0 then -1.0 else 60 + event_id * 37 % 25 end as celsius from {events}"


@query(
    "thermal_state",
    "with t as (" + _TEMP.replace("{events}", "events") + """), s as (select *, case when celsius < 0 or celsius > 150 or celsius >= 75 then 1 when celsius <= 70 then 0 end as said from t)
    select tick, sensor, coalesce(last_value(said ignore nulls) over (partition by sensor order by tick rows between unbounded preceding and current row), 0) = 1 as hot from s""",
)
def thermal_state(spark, d):
    t = spark.sql(_TEMP, events=table(spark, d, "events")).withColumn("celsius", F.col("celsius").cast("double"))
    return events.thermal(t, "sensor", 75.0, at="tick").select("tick", "sensor", "hot")


@query("hottest_sensor", "with t as (" + _TEMP.replace("{events}", "events") + ") select tick % 100 as tick, max(celsius)::double as celsius from t where sensor % 2 = 0 and celsius between 0 and 150 group by 1")
def hottest_sensor(spark, d):
    t = spark.sql(_TEMP, events=table(spark, d, "events")).withColumns({"celsius": F.col("celsius").cast("double"), "at": F.col("tick") % 100, "driver": (F.col("sensor") % 2).cast("string")})
    return events.hottest(t, ["0"]).withColumnRenamed("at", "tick")


@query("rate_series", "select user_id, event_id, case when event_id > lag(event_id) over w then greatest(floor(value * 100)::bigint - lag(floor(value * 100)::bigint) over w, 0)::double / (event_id - lag(event_id) over w) end as rate from events window w as (partition by user_id order by event_id)")
def rate_series(spark, d):
    e = table(spark, d, "events").withColumn("total", F.floor(F.col("value") * 100))
    return report.rates(e, "user_id", "event_id").select("user_id", "event_id", "rate")


def _said(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.when(F.col("event_type").isin("click", "view"), "received").otherwise(F.col("event_type")).alias("kind"), F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string")).alias("detail"))


@query(
    "event_suppression",
    """with recursive e as (select *, row_number() over (partition by user_id order by t, event_id) as n from (select event_id, user_id, epoch_us(ts) // 1000000 as t, case when event_type in ('click', 'view') then 'received' else event_type end as kind from events)),
    s as (select user_id, event_id, n, kind, t as kept_at, kind as kept_kind, true as keep from e where n = 1
      union all select e.user_id, e.event_id, e.n, e.kind, case when e.kind = s.kept_kind and e.t - s.kept_at < 36000 then s.kept_at else e.t end, case when e.kind = s.kept_kind and e.t - s.kept_at < 36000 then s.kept_kind else e.kind end, not (e.kind = s.kept_kind and e.t - s.kept_at < 36000)
      from s join e on e.user_id = s.user_id and e.n = s.n + 1)
    select user_id, event_id from s where keep""",
)
def event_suppression(spark, d):
    return report.suppressed(_said(spark, d), "user_id", 36000).select("user_id", "event_id")


@query("activity_ring", "with e as (select event_id, user_id, ts, case when event_type in ('click', 'view') then 'received' else event_type end as kind from events), k as (select * from e qualify kind <> 'received' or row_number() over (partition by user_id, kind = 'received' order by ts desc, event_id desc) <= 16) select user_id, event_id from k qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 64")
def activity_ring(spark, d):
    return report.ring(_said(spark, d).drop("detail"), "user_id").select("user_id", "event_id")


@query("activity_filter", "select event_type, event_type like '%error%' as issues, event_type = 'view' as index_, contains(lower(event_type || ' f' || user_id % 2 || ' x'), 'w f1') as found, count(*) as events from events group by all")
def activity_filter(spark, d):
    k = F.col("event_type")
    shown = report.accepts(F.when(k == "view", "received").otherwise(k), "index")
    folder = F.concat(F.lit("f"), (F.col("user_id") % 2).cast("string"))
    return table(spark, d, "events").groupBy(k, report.accepts(k, "issues").alias("issues"), shown.alias("index_"), report.matches(k, folder, F.lit("x"), "W F1").alias("found")).agg(F.count("*").alias("events"))


@query("latency_distribution", "with e as (select event_type, value, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as n from events) select event_type, min(value) as least, quantile_cont(value, 0.5) as median, max(value) filter (where r = ceil(n * 0.95)) as p95, max(value) as largest, count(*) as samples from e group by 1")
def latency_distribution(spark, d):
    return report.distribution(table(spark, d, "events"), ["event_type"], "value")


@query(
    "text_formats",
    """select o_orderkey as id, case when n >= 1e12 then printf('%.2f TB', n / 1e12 + 1e-9) when n >= 1e9 then printf('%.2f GB', n / 1e9 + 1e-9) when n >= 1e6 then printf('%.2f MB', n / 1e6 + 1e-9) when n >= 1e3 then printf('%.2f kB', n / 1e3 + 1e-9) else printf('%.0f B', n) end as bytes,
    format('{:,}', o_orderkey * 977) as count, case when a < 60 then a || 's' when a < 3600 then floor(a / 60)::bigint || 'm ' || a % 60 || 's' else floor(a / 3600)::bigint || 'h ' || floor(a % 3600 / 60)::bigint || 'm' end as age
    from (select o_orderkey, (o_orderkey * o_orderkey * o_custkey)::double as n, o_orderkey * 13 as a from orders)""",
)
def text_formats(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    # Keys of large tables leave 64 bits, and odd ones 38 digits.
    whole = lambda x: x.cast("decimal(19,0)")
    exact = F.try_multiply(F.try_multiply(whole(k), whole(k)), whole(c)).cast("double")
    n = F.coalesce(exact, k.cast("double") * k.cast("double") * c.cast("double"))
    return table(spark, d, "orders").select(k.alias("id"), report.bytes_text(n).alias("bytes"), report.count_text(k * 977).alias("count"), report.age_text(k * 13).alias("age"))


@query("clean_text", "select doc_id, md5(regexp_replace(text, '[\\x00-\\x1f\\x7f-\\x{9f}\\x{202a}-\\x{202e}\\x{2066}-\\x{2069}]', '', 'g')) as cleaned from documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(report.cleaned(F.col("text"))).alias("cleaned"))


@query("folder_phase", "select s_suppkey as id, case when s_suppkey % 5 = 0 then 'incomplete' when s_suppkey % 2 = 0 and s_suppkey % 3 = 0 then 'partial' when s_suppkey % 2 = 0 then 'watching' else 'polling' end as phase, s_suppkey % 7 <> 0 and s_suppkey % 11 < 5 as alive from supplier")
def folder_phase(spark, d):
    i = F.col("s_suppkey")
    return table(spark, d, "supplier").select(i.alias("id"), report.phase(F.when(i % 5 == 0, "x"), i % 2 == 0, i % 3 == 0).alias("phase"), report.alive(i % 7, F.lit(100) - i % 11, F.lit(100)).alias("alive"))


@query("connected_peers", "select user_id as peer, count(distinct event_id % 3) as lanes from events group by 1")
def connected_peers(spark, d):
    return report.connected(table(spark, d, "events").select(F.col("user_id").alias("peer"), (F.col("event_id") % 3).alias("lane")))


@query(
    "rate_history",
    """with e as (select user_id as source, event_id as place, event_id // 300 as pid, event_id - event_id % 8 as updated, value as rate from events),
    n as (select *, coalesce(lag(pid) over (partition by source order by place) <> pid, true) as new from e), r as (select *, sum(new::int) over (partition by source order by place) as run from n),
    k as (select r.*, row_number() over (partition by source order by place desc) as k from r join (select source, max(run) as run from r group by 1) l using (source, run))
    select source, place as "at", case when place - updated >= 5 then 0 else rate end::double as rate from k where k <= 5""",
)
def rate_history(spark, d):
    i = F.col("event_id")
    samples = table(spark, d, "events").select(F.col("user_id").alias("source"), i.alias("at"), F.expr("event_id div 300").alias("pid"), F.lit(0).alias("started"), (i - i % 8).alias("updated"), F.col("value").cast("double").alias("rate"))
    return report.rate_history(samples, 5, 5).select("source", "at", "rate")
