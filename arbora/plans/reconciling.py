"""Queries on reconciliation, pairing and conflicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clocks
from ..operators import conflicts, diff, reconcile
from ..operators.diff import KEY, packed
from ..sources.fixtures import sql_with, view
from .base import bytes_eq, clock_text, content_eq, query, rel, table
from .diffing import _ACTION, _FRESH

AB = sql_with("replica_a", "replica_b")
_OUT = f"""o as (
  select b.folder, b.path, case when a.folder is null then 'Absent' else {rel('a', 'b')} end as relation,
    case when a.folder is null then 'place' when {rel('a', 'b')} = 'After' then 'skip' when {rel('a', 'b')} = 'Equal' then case when {content_eq('a', 'b')} then 'skip' else 'conflict' end
         when {rel('a', 'b')} = 'Concurrent' and not {content_eq('a', 'b')} then 'conflict' else 'place' end as outcome,
    coalesce(a.ca, 0) as la, coalesce(a.cb, 0) as lb, b.ca as ra, b.cb as rb, b.kind as rkind, b.size as rsize, b.hash as rhash, b.target as rtarget, b.mode as rmode, b.id
  from replica_b b left join replica_a a using (folder, path))"""
_PLAN = f"""m as (
  select b.folder, b.path, case when a.folder is null and b.kind = 'Deleted' then null when a.folder is not null and {content_eq('a', 'b')} then 'history' when a.folder is not null and {rel('a', 'b')} in ('Concurrent', 'Equal') then 'conflict'
    when a.folder is not null and {rel('a', 'b')} = 'After' then 'send' else 'receive' end as action, b.size, b.kind from replica_b b left join replica_a a using (folder, path)),
plan as (
  select * from m where action is not null
  union all select folder, path, 'send-new', size, null from replica_a a where kind <> 'Deleted' and not exists (select 1 from replica_b b where b.folder = a.folder and lower(b.path) = lower(a.path)))"""
_CID = f"sha256(concat_ws(chr(10), path, rkind, rsize::varchar, rhash, coalesce(rtarget, ''), rmode::varchar, {clock_text('ra', 'rb')}))"


def _ab(spark, d):
    return view(spark, d, "replica_a"), view(spark, d, "replica_b")


@query("pairing_merge_summary", f"{AB}, {_PLAN} select folder, action, count(*) as paths, sum(size)::bigint as bytes from plan group by 1, 2")
def pairing_merge_summary(spark, d):
    a, b = _ab(spark, d)
    return reconcile.plan_summary(reconcile.pairing_plan(a, b, key=F.lower("path")))


@query("pairing_merge_plan", f"{AB}, {_PLAN} select folder, path, action from plan")
def pairing_merge_plan(spark, d):
    a, b = _ab(spark, d)
    return reconcile.pairing_plan(a, b).select("folder", "path", "action")


_SEED = f"""seed as (
  select b.folder, b.path, case when a.folder is not null and {content_eq('a', 'b')} then 'history' when a.folder is null or a.kind = 'Deleted' then 'delete' else 'replace' end as action, b.kind as rkind, a.kind as lkind,
    coalesce(a.kind, 'Deleted') as kind, coalesce(a.size, 0) as size, coalesce(a.hash, '') as hash, coalesce(a.mode, b.mode) as mode, greatest(coalesce(a.ca, 0), b.ca) as ca, greatest(coalesce(a.cb, 0), b.cb) as cb
  from replica_b b left join replica_a a using (folder, path))"""


@query("pairing_seed_plan", f"{AB}, {_SEED} select folder, path, action from seed union all select folder, path, 'send-new' from replica_a a where kind <> 'Deleted' and not exists (select 1 from replica_b b where b.folder = a.folder and b.path = a.path)")
def pairing_seed_plan(spark, d):
    a, b = _ab(spark, d)
    return reconcile.pairing_plan(a, b, mode="seed-local", key=F.lower("path")).select("folder", "path", "action")


@query("seed_result", f"{AB}, {_SEED} select folder, path, action, kind, size::bigint as size, hash, mode::int as mode, {clock_text('ca + 1', 'cb')} as clock from seed")
def seed_result(spark, d):
    a, b = _ab(spark, d)
    got = reconcile.seed_result(reconcile.pairing_plan(a, b, mode="seed-local", key=F.lower("path")), "A")
    return got.select("folder", "path", "action", "kind", F.col("size").cast("long").alias("size"), "hash", F.col("mode").cast("int").alias("mode"), clocks.text(F.col("clock")).alias("clock"))


@query("kind_clashes", f"{AB} select a.folder, a.path, a.kind as local_kind, b.kind as remote_kind from (select * replace (case when id % 46 = 0 then 'File' else kind end as kind) from replica_a) a join replica_b b using (folder, path) where a.kind <> 'Deleted' and b.kind <> 'Deleted' and (a.kind = 'Directory') <> (b.kind = 'Directory')")
def kind_clashes(spark, d):
    a, b = _ab(spark, d)
    a = a.withColumn("kind", F.when(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long") % 46 == 0, "File").otherwise(F.col("kind")))
    return reconcile.kind_clashes(reconcile.pairing_plan(a, b, key=F.lower("path"))).select("folder", "path", F.col("local.kind").alias("local_kind"), F.col("remote.kind").alias("remote_kind"))


@query("plan_order_page", f"{AB}, {_PLAN} select row_number() over (order by folder, path) - 1 as position, folder, path, action from plan order by folder, path limit 50 offset 100")
def plan_order_page(spark, d):
    from pyspark.sql import Window

    a, b = _ab(spark, d)
    page = reconcile.page(reconcile.pairing_plan(a, b, key=F.lower("path")), 100, 50)
    return page.select((F.row_number().over(Window.orderBy("folder", "path")) + 99).cast("long").alias("position"), "folder", "path", "action")


@query("stale_plan", f"{AB}, {_PLAN}, n as (select folder, path from replica_a where id % 9 = 0 and kind <> 'Deleted') select folder, path, action from plan join n using (folder, path)")
def stale_plan(spark, d):
    a, b = _ab(spark, d)
    plan = reconcile.pairing_plan(a, b, key=F.lower("path"))
    moved = (F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long") % 9 == 0) & (F.col("kind") != "Deleted")
    now = a.withColumn("stamp", F.when(moved, "new").otherwise(F.col("stamp")))
    return plan.select("folder", "path", "action").join(reconcile.stale(plan, now).select(*KEY), KEY)


@query("apply_outcomes", f"{AB}, {_OUT} select folder, path, relation, outcome, case when outcome = 'place' then {clock_text('greatest(la, ra)', 'greatest(lb, rb)')} else {clock_text('la', 'lb')} end as clock from o")
def apply_outcomes(spark, d):
    return reconcile.outcomes(*_ab(spark, d)).select("folder", "path", "relation", "outcome", F.coalesce(clocks.text(F.col("clock")), F.lit("")).alias("clock"))


@query(
    "wants_payload",
    f"""{AB} select b.folder, b.path, b.size from replica_b b left join replica_a a using (folder, path)
    where b.kind = 'File' and not coalesce(a.folder is not null and ({rel('a', 'b')} = 'After' or {rel('a', 'b')} = 'Equal' and {content_eq('a', 'b')}), false) and not coalesce(a.kind <> 'Deleted' and {bytes_eq('a', 'b')}, false)""",
)
def wants_payload(spark, d):
    return reconcile.wanted(*_ab(spark, d)).select("folder", "path", "size")


@query("publication_order", f"{AB} select folder, path, row_number() over (partition by folder order by kind = 'Deleted', case when kind = 'Deleted' then -length(path) else length(path) end, path) as position from replica_b")
def publication_order(spark, d):
    return reconcile.publication_order(view(spark, d, "replica_b")).select("folder", "path", "position")


@query("changed_destinations", f"{sql_with('replica_a', 'snapshot')} select a.folder, a.path, a.stamp as expected, s.stamp as found from replica_a a left join snapshot s using (folder, path) where a.stamp is distinct from s.stamp")
def changed_destinations(spark, d):
    return reconcile.changed_since(view(spark, d, "replica_a"), view(spark, d, "snapshot"))


_TREE = """t as materialized (
  select folder, path, kind, seq, size from journal
  union all select distinct folder, split_part(path, '/', 1), case when l.k % 13 = 0 then 'File' else 'Directory' end, l.k, 0
  from (select folder, path, cast(substr(split_part(path, '/', 1), 2) as bigint) as k from journal) l where l.k % 5 <> 0)"""


@query(
    "required_parent_seq",
    f"""{sql_with('journal').replace('journal as (', 'journal as materialized (', 1)}, {_TREE}, e as (select folder, path, max(seq) as seq, arg_max(kind, seq) as kind, arg_max(size, seq) as size from t group by 1, 2),
    m as (select *, split_part(path, '/', 1) as top, max(seq) filter (path = split_part(path, '/', 1)) over w as up, max(kind) filter (path = split_part(path, '/', 1)) over w as up_kind from e window w as (partition by folder, split_part(path, '/', 1)))
    select folder, path, coalesce(up, 0)::bigint as required_seq, (case when coalesce(up_kind, '') <> 'Directory' then 1 else 0 end)::bigint as violations from m where kind = 'File' and size >= 1048576 and path <> top""",
)
def required_parent_seq(spark, d):
    from ..operators.diff import latest
    from ..operators.feed import bulk

    j = view(spark, d, "journal")
    k = F.substring_index("path", "/", 1)
    up = j.select("folder", k.alias("path"), F.expr("cast(substring(substring_index(path, '/', 1), 2) as bigint)").alias("seq")).filter("seq % 5 <> 0")
    up = up.select("folder", "path", F.when(F.col("seq") % 13 == 0, "File").otherwise("Directory").alias("kind"), "seq", F.lit(0).cast("long").alias("size"))
    # An order's directory comes once for each of its lines; the latest version is the same.
    large = bulk(F.col("kind"), F.col("size")).alias("large")
    flagged = lambda rows: rows.select("folder", "path", F.col("seq").cast("long").alias("seq"), large, (F.col("kind") == "Directory").alias("directory"))
    return reconcile.required_parents(latest(flagged(j), flagged(up)), F.col("large"), F.col("directory"))


_FOLD = "select s_suppkey as folder, case s_suppkey % 3 when 0 then 'two-way' when 1 then 'send-only' else 'receive-only' end as mode, s_suppkey % 4 <> 1 as approved, s_suppkey % 5 <> 2 as ready, s_suppkey % 7 = 3 as paused from supplier"


@query("common_folders", f"with f as ({_FOLD}) select l.folder, l.mode as local_mode, r.mode as remote_mode, l.mode <> 'receive-only' and r.mode <> 'send-only' as sends, l.mode <> 'send-only' and r.mode <> 'receive-only' as receives, l.mode = r.mode and l.mode <> 'two-way' as mismatch from f l join (select folder * 2 as folder, mode from f) r using (folder) where approved and ready and not paused")
def common_folders(spark, d):
    f = spark.sql(_FOLD.replace("from supplier", "from {supplier}"), supplier=table(spark, d, "supplier"))
    return reconcile.common_folders(f, f.select((F.col("folder") * 2).alias("folder"), "mode"))


def _records(spark, d):
    a, b = _ab(spark, d)
    return conflicts.records(reconcile.outcomes(a, b)), a, b


_REC = f"{AB}, {_OUT}, c as (select folder, {_CID} as id, path, la, lb, ra, rb from o where outcome = 'conflict')"


@query("conflict_records", f"{_REC} select folder, id, path from c")
def conflict_records(spark, d):
    return _records(spark, d)[0].select("folder", "id", "path")


@query("conflict_save", f"{_REC} select folder, count(*) as records from c group by 1")
def conflict_save(spark, d):
    c = _records(spark, d)[0]
    return conflicts.counts(conflicts.save(c.filter("length(path) % 2 = 0"), c)).withColumnRenamed("conflicts", "records")


@query("conflict_counts", f"{_REC} select folder, count(*) as conflicts from c group by 1")
def conflict_counts(spark, d):
    return conflicts.counts(_records(spark, d)[0])


@query("conflict_page", f"{_REC}, p as (select folder, id, path, row_number() over (order by folder, path, id) as n, count(*) over () as total from c where contains(lower(path), 'en/d') or contains(lower(folder), 'en/d') or contains(id, 'EN/d')) select folder, id, path, total > 55 as more from p where n > 5 and n <= 55")
def conflict_page(spark, d):
    return conflicts.page(_records(spark, d)[0], "EN/d", offset=5).select("folder", "id", "path", "more")


@query("clear_resolved", f"{_REC} select folder, id, path from c join (select folder, path, greatest(ca - 1 + id % 3, 0) as na, cb + id % 2 as nb from replica_b) n using (folder, path) where not (la <= na and lb <= nb and ra <= na and rb <= nb)")
def clear_resolved(spark, d):
    c, _, b = _records(spark, d)
    k = F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long")
    at = lambda dev: F.coalesce(F.col("clock")[dev], F.lit(0))
    now = b.select("folder", "path", F.create_map(F.lit("A"), F.greatest(at("A") - 1 + k % 3, F.lit(0)), F.lit("B"), at("B") + k % 2).alias("clock"))
    return conflicts.clear_resolved(c, now).select("folder", "id", "path")


@query("resolve_keep_local", f"{_REC} select folder, id, path, {clock_text('greatest(la, ra) + 1', 'greatest(lb, rb)')} as clock from c")
def resolve_keep_local(spark, d):
    c, a, _ = _records(spark, d)
    return conflicts.keep_local(c, a, "A").select("folder", "id", "path", clocks.text(F.col("clock")).alias("clock"))


_MANY = f"""{_REC}, w as (select folder, id, path, la, lb, ra, rb from c union all select folder, id || 'x', path, la, lb, ra + case when length(path) % 2 = 0 then 1 else 0 end, rb from c where length(path) % 3 = 0)"""


@query(
    "resolve_take_incoming",
    f"""{_MANY}, m as (select folder, id, path, ra, rb, la, lb, greatest(la, ra) + 1 as na, greatest(lb, rb) as nb from w)
    select m.folder, m.id, m.path, bool_or(o.id <> m.id and m.ra <= o.ra and m.rb <= o.rb and (m.ra < o.ra or m.rb < o.rb)) as refused,
      count(*) filter (where o.id = m.id or (o.ra <= m.na and o.rb <= m.nb and o.la <= m.la and o.lb <= m.lb)) as clears, any_value({clock_text('m.na', 'm.nb')}) as clock
    from m join w o on o.folder = m.folder and o.path = m.path group by 1, 2, 3""",
)
def resolve_take_incoming(spark, d):
    c, a, _ = _records(spark, d)
    later = F.when(F.length("path") % 2 == 0, clocks.bump(F.col("incoming.clock"), "A")).otherwise(F.col("incoming.clock"))
    more = c.filter("length(path) % 3 = 0").withColumn("id", F.concat("id", F.lit("x"))).withColumn("incoming", F.col("incoming").withField("clock", later))
    got = conflicts.take_incoming(c.unionByName(more), a, "A")
    return got.select("folder", "id", "path", "refused", F.size("clears").cast("long").alias("clears"), clocks.text(F.col("clock")).alias("clock"))


@query(
    "conflict_preview",
    "select doc_id, case when doc_id % 9 = 0 then '(directory)' when strlen(text) > 4 * 16384 then 'Preview unavailable: preview omitted: file exceeds 64 KiB; compare it externally' when doc_id % 4 = 0 then 'Preview unavailable: preview differs from indexed version; refresh after a scan' when text = '' then '(empty file)' else text end as preview from documents",
)
def conflict_preview(spark, d):
    docs = table(spark, d, "documents")
    kind = F.when(F.col("doc_id") % 9 == 0, "Directory").otherwise("File")
    size = F.octet_length("text") + F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)
    shown = conflicts.preview(kind, F.when(F.octet_length("text") > 64 * 1024, F.octet_length("text")).otherwise(size), F.sha2("text", 256), F.col("text").cast("binary"))
    return docs.select("doc_id", shown.alias("preview"))


@query("reviewed_unchanged", f"{sql_with('replica_a')} select folder, count(*) filter (where id % 9 <> 0) as same, count(*) filter (where id % 9 = 0) as changed from replica_a group by 1")
def reviewed_unchanged(spark, d):
    a = view(spark, d, "replica_a")
    moved = F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long") % 9 == 0
    both = packed(a, "seen").join(packed(a.withColumn("stamp", F.when(moved, "new").otherwise(F.col("stamp"))), "now"), KEY)
    ok = conflicts.reviewed(F.col("now"), F.col("seen"))
    return both.groupBy("folder").agg(F.count(F.when(ok, 1)).alias("same"), F.count(F.when(~ok, 1)).alias("changed"))


@query("conflict_list", f"{_REC} select folder, path, id from c order by folder, path, id")
def conflict_list(spark, d):
    return conflicts.listed(_records(spark, d)[0]).select("folder", "path", "id")


@query("conflicts_at_paths", f"{_REC} select folder, id, path from c where path like '%1.txt'")
def conflicts_at_paths(spark, d):
    c, a, _ = _records(spark, d)
    return conflicts.at_paths(c, a.filter("path like '%1.txt'")).select("folder", "id", "path")


@query("conflict_by_id", f"{_REC} select folder, id, path from c where path like '%0.txt'")
def conflict_by_id(spark, d):
    c = _records(spark, d)[0]
    return conflicts.by_id(c, c.filter("path like '%0.txt'")).select("folder", "id", "path")


@query(
    "predicted_clocks",
    f"""{sql_with('replica_a', 'replica_b', 'snapshot')}, {_OUT}, {_FRESH}, y as (select *, {_ACTION.format(adopt='')} as action from x)
    select y.folder, y.path, action, {clock_text("coalesce(ca, 0) + case when action in ('change', 'delete') then 1 else 0 end", 'coalesce(cb, 0)')} as clock from y join (select folder, path from o where outcome = 'conflict') c using (folder, path)""",
)
def predicted_clocks(spark, d):
    c, a, _ = _records(spark, d)
    got = diff.predicted(a, view(spark, d, "snapshot"), "A", c)
    return got.select("folder", "path", "action", F.coalesce(clocks.text(F.col("clock")), F.lit("")).alias("clock"))


@query("plan_header", f"{AB}, {_PLAN} select 1 as format, 'A' as device, 'src3' as folder, 7::bigint as counter, count(*) as items from plan where folder = 'src3'")
def plan_header(spark, d):
    return reconcile.header(reconcile.pairing_plan(*_ab(spark, d), key=F.lower("path")), "A", "src3", 7)


@query(
    "plan_header_faults",
    f"{sql_with('replica_a')}, f as (select folder, concat_ws(',', case when folder like '%1' then 'several headers' end, case when folder like '%2' then 'another format' end, case when folder like '%3' then 'stale' end) as faults from (select distinct folder from replica_a)) select * from f where faults <> ''",
)
def plan_header_faults(spark, d):
    heads = view(spark, d, "replica_a").groupBy("folder").agg(F.max("seq").alias("head"))
    last = F.substring("folder", -1, 1)
    made = heads.select("folder", F.when(last == "2", 2).otherwise(1).alias("format"), F.when(last == "3", F.col("head") - 1).otherwise(F.col("head")).alias("counter"))
    return reconcile.header_faults(made.unionByName(made.filter("folder like '%1'")), heads).select("folder", F.array_join("faults", ",").alias("faults"))


@query("plan_audit", f"{AB}, {_PLAN} select folder, path, lower(path) as path_key, action, action not in ('send-new') as remote, action <> 'receive' or exists (select 1 from replica_a a where a.folder = plan.folder and a.path = plan.path) as local from plan")
def plan_audit(spark, d):
    a, b = _ab(spark, d)
    kept = reconcile.audit(reconcile.pairing_plan(a, b, key=F.lower("path")), key=F.lower("path"))
    return kept.select("folder", "path", "path_key", "action", F.col("remote").isNotNull().alias("remote"), F.col("local").isNotNull().alias("local"))
