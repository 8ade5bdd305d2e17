"""Queries on clocks, entries, paths and snapshot diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import clocks, entries, paths
from ..operators import diff
from ..sources import index, tree
from ..sources.fixtures import sql_with, view
from .base import bytes_eq, clock_text, content_eq, query, rel, table

AB = sql_with("replica_a", "replica_b")
PATTERNS = ["en/d3", "*7.txt", "d5"]


def _pair(spark: SparkSession, d: str) -> DataFrame:
    return diff.packed(view(spark, d, "replica_a"), "a").join(diff.packed(view(spark, d, "replica_b"), "b"), diff.KEY)


@query("clock_relation_counts", f"{AB} select a.folder, {rel('a', 'b')} as relation, count(*) as paths from replica_a a join replica_b b using (folder, path) group by 1, 2")
def clock_relation_counts(spark, d):
    return _pair(spark, d).groupBy("folder", clocks.relation(F.col("a.clock"), F.col("b.clock")).alias("relation")).agg(F.count("*").alias("paths"))


@query("clock_merge", f"{AB} select folder, path, {clock_text('greatest(a.ca, b.ca)', 'greatest(a.cb, b.cb)')} as clock from replica_a a join replica_b b using (folder, path)")
def clock_merge(spark, d):
    return _pair(spark, d).select("folder", "path", clocks.text(clocks.merge(F.col("a.clock"), F.col("b.clock"))).alias("clock"))


@query("clock_steps", f"{sql_with('replica_a')} select folder, path, {clock_text('ca + 1', 'cb')} as bumped, {clock_text('0', 'cb')} as without, ca <= 2 and cb <= 1 as included from replica_a")
def clock_steps(spark, d):
    a, limit = view(spark, d, "replica_a"), F.create_map(F.lit("A"), F.lit(2).cast("long"), F.lit("B"), F.lit(1).cast("long"))
    c = F.col("clock")
    return a.select("folder", "path", clocks.text(clocks.bump(c, "A")).alias("bumped"), clocks.text(clocks.drop_device(c, "A")).alias("without"), clocks.includes(c, limit).alias("included"))


@query("same_content_matrix", f"{AB} select {bytes_eq('a', 'b')} as bytes, {content_eq('a', 'b')} as content, a.kind, count(*) as paths from replica_a a join replica_b b using (folder, path) group by 1, 2, 3")
def same_content_matrix(spark, d):
    a, b = F.col("a"), F.col("b")
    return _pair(spark, d).groupBy(entries.same_bytes(a, b).alias("bytes"), entries.same_content(a, b).alias("content"), a["kind"].alias("kind")).agg(F.count("*").alias("paths"))


@query(
    "path_violations",
    r"""with u as (select page_id, (case when page_id % 5 = 0 then regexp_replace(b, '^([^/]*)/', '\1//') else b end) || case when page_id % 7 = 0 then '/../x' when page_id % 11 = 0 then '\x' else '' end as path
      from (select page_id, regexp_replace(url, '^https?://[^/]*/', '') as b from pages))
    select page_id, path, concat_ws(',', case when path = '' then 'empty' end, case when strlen(path) > 4096 then 'too long' end, case when contains(path, '\') then 'backslash' end,
      case when path <> '' and len(list_filter(string_split(path, '/'), lambda p: p in ('', '.', '..'))) > 0 then 'component' end,
      case when len(list_filter(string_split(path, '/'), lambda p: lower(p) in ('.arbora', '.arboraignore'))) > 0 then 'reserved' end) as violations from u""",
)
def path_violations(spark, d):
    pages = table(spark, d, "pages")
    base = F.regexp_replace("url", "^https?://[^/]*/", "")
    first = F.when(F.col("page_id") % 5 == 0, F.regexp_replace(base, "^([^/]*)/", "$1//")).otherwise(base)
    end = F.when(F.col("page_id") % 7 == 0, "/../x").when(F.col("page_id") % 11 == 0, "\\x").otherwise("")
    return pages.select("page_id", F.concat(first, end).alias("path")).select("page_id", "path", F.array_join(paths.violations(F.col("path")), ",").alias("violations"))


@query(
    "path_ancestors",
    f"""{sql_with('fs_events')}, p as (select path, string_split(path, '/') as s from fs_events)
    select ancestor, count(*) as paths from (select unnest(list_transform(range(1, len(s)), lambda n: array_to_string(s[1:n], '/'))) as ancestor from p) group by 1""",
)
def path_ancestors(spark, d):
    return view(spark, d, "fs_events").select(F.explode(paths.ancestors(F.col("path"))).alias("ancestor")).groupBy("ancestor").agg(F.count("*").alias("paths"))


@query("excluded_paths", f"{sql_with('replica_a')} select folder, path, path like 'en/d3/%' or path like '%7.txt' or path like '%/d5/%' or path like 'd5/%' as excluded from replica_a")
def excluded_paths(spark, d):
    return view(spark, d, "replica_a").select("folder", "path", paths.excluded(F.col("path"), PATTERNS).alias("excluded"))


@query("path_keys", f"{sql_with('replica_a')} select folder, upper(path) as path, lower(nfc_normalize(upper(path))) as path_key from replica_a")
def path_keys(spark, d):
    return view(spark, d, "replica_a").select("folder", F.upper("path").alias("path")).withColumn("path_key", paths.path_key("path"))


@query("content_hash", "select doc_id, sha256(text) as hash, strlen(text)::bigint as size from documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", entries.content_hash(F.col("text")).alias("hash"), F.octet_length("text").cast("long").alias("size"))


@query(
    "entry_violations",
    f"""{sql_with('replica_a')} select folder, path, concat_ws(',', case when ca + cb <= 0 then 'clock counter' end, 'device', case when kind = 'File' and not regexp_matches(h, '^[0-9a-f]{{64}}$') then 'file hash' end, case when m < 0 or m > 511 then 'mode' end, case when kind = 'Symlink' and h <> sha256(target) then 'target' end) as violations
    from (select *, case when id % 40 = 0 then 1023 else mode end as m, case when id % 58 = 0 then 'x' else hash end as h from replica_a)""",
)
def entry_violations(spark, d):
    a = view(spark, d, "replica_a").withColumn("id", F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long"))
    mode = F.when(F.col("id") % 40 == 0, 1023).otherwise(F.col("mode"))
    hash_ = F.when(F.col("id") % 58 == 0, "x").otherwise(F.col("hash"))
    return a.select("folder", "path", F.array_join(entries.violations(F.col("path"), F.col("kind"), F.col("size"), hash_, F.col("target"), mode, F.col("clock")), ",").alias("violations"))


_FRESH = f"""x as (
  select coalesce(o.folder, s.folder) as folder, coalesce(o.path, s.path) as path, o.folder is not null as known, s.folder is not null as seen, o.kind as okind, o.ca, o.cb, o.mode as omode,
         coalesce(s.kind, 'Deleted') as kind, coalesce(s.hash, '') as hash, s.target, case when s.folder is null then o.mode else s.mode end as mode, coalesce(s.size, 0) as size,
         o.folder is not null and {content_eq('o', 's')} as same
  from replica_a o full join snapshot s on o.folder = s.folder and o.path = s.path)"""
_ACTION = "case when not seen and (not known or okind = 'Deleted') then 'none' when coalesce(same, false) then 'restamp' {adopt} when not seen then 'delete' else 'change' end"


@query(
    "snapshot_diff",
    f"""{sql_with('replica_a', 'snapshot')}, {_FRESH}, y as (select *, {_ACTION.format(adopt='')} as action from x)
    select folder, path, action, kind, {clock_text("coalesce(ca, 0) + case when action in ('change', 'delete') then 1 else 0 end", 'coalesce(cb, 0)')} as clock from y""",
)
def snapshot_diff(spark, d):
    got = diff.decide(view(spark, d, "replica_a"), view(spark, d, "snapshot"), "A")
    return got.select("folder", "path", "action", "fresh.kind", F.coalesce(clocks.text(F.col("clock")), F.lit("")).alias("clock"))


@query(
    "adopt_received",
    f"""{sql_with('replica_a', 'replica_b', 'snapshot', 'receiving')}, {_FRESH}, y as (
      select x.*, r.ca as ra, r.cb as rb, r.folder is not null and (not known or ((x.ca <= r.ca and x.cb <= r.cb) and (x.ca < r.ca or x.cb < r.cb)))
        and case when r.kind = 'Deleted' then x.kind = 'Deleted' else {content_eq('r', 'x')} end as fits
      from x left join receiving r on r.folder = x.folder and r.path = x.path), z as (select *, {_ACTION.format(adopt="when coalesce(fits, false) then 'adopt'")} as action from y)
    select folder, path, action, case when action = 'adopt' then {clock_text('greatest(coalesce(ca, 0), ra)', 'greatest(coalesce(cb, 0), rb)')} else {clock_text("coalesce(ca, 0) + case when action in ('change', 'delete') then 1 else 0 end", 'coalesce(cb, 0)')} end as clock from z""",
)
def adopt_received(spark, d):
    got = diff.decide(view(spark, d, "replica_a"), view(spark, d, "snapshot"), "A", receiving=view(spark, d, "receiving"))
    return got.select("folder", "path", "action", F.coalesce(clocks.text(F.col("clock")), F.lit("")).alias("clock"))


@query("needs_hash", f"{sql_with('replica_a', 'snapshot')} select s.folder, count(*) as paths, sum(s.size)::bigint as bytes from snapshot s left join replica_a o using (folder, path) where not coalesce(o.kind <> 'Deleted' and o.stamp = s.stamp and o.mode = s.mode, false) group by 1")
def needs_hash(spark, d):
    return diff.needs_hash(view(spark, d, "replica_a"), view(spark, d, "snapshot")).groupBy("folder").agg(F.count("*").alias("paths"), F.sum("size").alias("bytes"))


@query("deletion_inference", f"{sql_with('replica_a', 'snapshot')} select folder, path, kind, size from replica_a a where kind <> 'Deleted' and not exists (select 1 from snapshot s where s.folder = a.folder and s.path = a.path)")
def deletion_inference(spark, d):
    return diff.unseen(view(spark, d, "replica_a"), view(spark, d, "snapshot")).select("folder", "path", "kind", "size")


@query(
    "scoped_deletion",
    f"""{sql_with('replica_a', 'snapshot')} select folder, path, kind from replica_a a where kind <> 'Deleted' and (path = 'en/d2' or path like 'en/d2/%' or path = 'fr' or path like 'fr/%')
    and not exists (select 1 from snapshot s where s.folder = a.folder and s.path = a.path)""",
)
def scoped_deletion(spark, d):
    a = view(spark, d, "replica_a")
    scopes = a.select("folder").distinct().select("folder", F.explode(F.array(F.lit("en/d2"), F.lit("fr"))).alias("scope"))
    return diff.unseen(a, view(spark, d, "snapshot"), scopes).select("folder", "path", "kind")


@query(
    "tombstones",
    f"""{sql_with('replica_a', 'snapshot')} select folder, path, 'Deleted' as kind, 0::bigint as size, '' as hash, mode, '' as stamp, {clock_text('ca + 1', 'cb')} as clock from replica_a a
    where kind <> 'Deleted' and not exists (select 1 from snapshot s where s.folder = a.folder and s.path = a.path)""",
)
def tombstones(spark, d):
    got = diff.decide(view(spark, d, "replica_a"), view(spark, d, "snapshot"), "A").filter("action = 'delete'")
    return got.select("folder", "path", "fresh.kind", "fresh.size", "fresh.hash", "fresh.mode", "fresh.stamp", clocks.text(F.col("clock")).alias("clock"))


@query(
    "seq_assignment",
    f"""{sql_with('replica_a', 'snapshot')}, {_FRESH}, y as (select *, {_ACTION.format(adopt='')} as action from x), h as (select folder, max(seq) as head from replica_a group by 1)
    select folder, path, kind, coalesce(head, 0) + row_number() over (partition by folder order by kind = 'Deleted', case when kind = 'Deleted' then -length(path) else length(path) end, path) as seq
    from y left join h using (folder) where action in ('change', 'delete')""",
)
def seq_assignment(spark, d):
    a = view(spark, d, "replica_a")
    heads = a.groupBy("folder").agg(F.max("seq").alias("head"))
    return diff.applied(a, diff.decide(a, view(spark, d, "snapshot"), "A"), heads).select("folder", "path", "kind", "seq")


@query("folder_totals", f"{sql_with('replica_a')} select folder, count(*) filter (where kind = 'File') as files, coalesce(sum(size) filter (where kind = 'File'), 0)::bigint as bytes from replica_a group by 1")
def folder_totals(spark, d):
    return diff.totals(view(spark, d, "replica_a"))


_TWO = "select folder, path from replica_a union all select folder, upper(path) from replica_a where id % 50 = 0"


@query("path_collisions", f"{sql_with('replica_a')} select folder, lower(path) as path_key, count(distinct path) as paths, min(path) as first_path, max(path) as last_path from ({_TWO}) group by 1, 2 having count(distinct path) > 1")
def path_collisions(spark, d):
    a = view(spark, d, "replica_a").select("folder", "path")
    more = a.filter(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long") % 50 == 0).select("folder", F.upper("path").alias("path"))
    return diff.collisions(a.union(more))


@query(
    "path_aliases",
    f"""{sql_with('replica_a')}, n as (select folder, upper(path) as path, path as local_path, true as case_only, id % 30 = 0 as duplicate from replica_a where id % 3 = 0
      union all select folder, upper(left(path, 2)) || substr(path, 3), path, true, true from replica_a where id % 30 = 0
      union all select folder, replace(path, '.txt', 'e' || chr(769) || '.txt'), replace(path, '.txt', 'é.txt'), false, false from replica_a where id % 3 = 1)
    select * from n""",
)
def path_aliases(spark, d):
    """Incoming paths in other cases, in another Unicode form, and pairs that mean one local path."""
    a = view(spark, d, "replica_a").withColumn("id", F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long"))
    named = lambda end: F.replace(F.col("path"), F.lit(".txt"), F.lit(end))
    local = a.withColumn("path", F.when(F.col("id") % 3 == 1, named("é.txt")).otherwise(F.col("path")))
    asked = a.filter("id % 3 = 0").select("folder", F.upper("path").alias("path"))
    asked = asked.union(a.filter("id % 30 = 0").select("folder", F.concat(F.upper(F.substring("path", 1, 2)), F.expr("substring(path, 3)")).alias("path")))
    return diff.aliases(asked.union(a.filter("id % 3 = 1").select("folder", named("e\u0301.txt").alias("path"))), local)


@query(
    "scan_with_errors",
    f"""{sql_with('replica_a', 'snapshot')}, {_FRESH}, y as (select *, {_ACTION.format(adopt='')} as action from x)
    select folder, case when action = 'delete' then 'none' else action end as action, count(*) as paths from y group by 1, 2""",
)
def scan_with_errors(spark, d):
    return diff.decide(view(spark, d, "replica_a"), view(spark, d, "snapshot"), "A", errors=2).groupBy("folder", "action").agg(F.count("*").alias("paths"))


@query("ignore_patterns", r"select doc_id, len(p) as patterns, md5(array_to_string(p, chr(10))) as listed from (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' and not starts_with(x, '#')) as p from documents)")
def ignore_patterns(spark, d):
    p = paths.ignore_patterns(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(p).cast("long").alias("patterns"), F.md5(F.array_join(p, "\n")).alias("listed"))


@query("latest_entries", f"{sql_with('journal')} select folder, count(*) as paths, sum(size)::bigint as bytes, sum(seq)::bigint as seqs from (select *, row_number() over (partition by folder, path order by seq desc) as r from journal) where r = 1 group by 1")
def latest_entries(spark, d):
    return diff.latest(view(spark, d, "journal")).groupBy("folder").agg(F.count("*").alias("paths"), F.sum("size").alias("bytes"), F.sum("seq").alias("seqs"))


@query("scan_errors", f"{sql_with('fs_events')} select * from (select path as scan, event_id as at, kind as message, row_number() over (partition by path order by event_id, kind) as rank, count(*) over (partition by path) as total from fs_events where kind = 'Remove') where rank <= 32")
def scan_errors(spark, d):
    errors = view(spark, d, "fs_events").filter("kind = 'Remove'").select(F.col("path").alias("scan"), F.col("event_id").alias("at"), F.col("kind").alias("message"))
    return diff.scan_errors(errors).select("scan", "at", "message", F.col("rank").cast("long").alias("rank"), "total")


_LIST = """select source as folder, concat(lang, '/d', cast(doc_id % 7 as string), '/', cast(doc_id as string), '.txt') as path, case when doc_id % 23 = 0 then 'Directory' when doc_id % 29 = 0 then 'Symlink' when doc_id % 31 = 0 then 'Socket' else 'File' end as kind,
  doc_id % 2 as dev, doc_id as ino, OCT as size, 7 + doc_id % 3 as mtime, doc_id * 10 as mtime_nsec, 8 as ctime, 5 as ctime_nsec, case when doc_id % 11 = 0 then 33261 else 33188 end as mode, concat('../', lang) as target, text as body from {documents}"""


@query(
    "listing_snapshot",
    "with l as (" + _LIST.replace("{documents}", "documents").replace("OCT", "strlen(text)::bigint") + """)
    select folder, path, kind, case when kind = 'File' then size else 0 end as size, case kind when 'File' then sha256(body) when 'Symlink' then sha256(target) else '' end as hash, case when kind = 'Symlink' then target end as target,
      (mode & 511)::int as mode, concat_ws(':', dev, ino, size, mtime, mtime_nsec, ctime, ctime_nsec) as stamp from l where kind <> 'Socket'""",
)
def listing_snapshot(spark, d):
    rows = spark.sql(_LIST.replace("OCT", "cast(octet_length(text) as bigint)"), documents=table(spark, d, "documents"))
    return tree.observed(rows.drop("body"), rows.select("folder", "path", "body"))


@query("snapshot_export", f"{sql_with('replica_a')} select folder, path, kind, size, hash, row_number() over (partition by folder order by path) as position from replica_a where kind <> 'Deleted'")
def snapshot_export(spark, d):
    """The live entries as an exported index, read back in the order in which they were written."""
    live = view(spark, d, "replica_a").filter("kind <> 'Deleted'")
    at = tree.save(live.select("folder", "path", "kind", "size", "hash"), storage.temporary(spark, "export"), 1)
    return tree.exported(spark, at).select("folder", "path", "kind", "size", "hash", "position")


def _indexed(spark, d, buckets=8):
    return [index.build(view(spark, d, name).select("folder", "path", "kind", "size", "hash"), buckets) for name in ("replica_a", "replica_b")]


@query("indexed_join", f"{AB} select a.folder, count(*) as paths, count(*) filter (where a.hash = b.hash) as same, sum(b.size - a.size)::bigint as growth from replica_a a join replica_b b using (folder, path) group by 1")
def indexed_join(spark, d):
    """Two bucketed indexes compared in place."""
    both = index.joined(spark, *_indexed(spark, d))
    return both.groupBy("folder").agg(F.count("*").alias("paths"), F.count(F.when(F.col("hash") == F.col("right_hash"), 1)).alias("same"), F.sum(F.col("right_size") - F.col("size")).alias("growth"))


@query("indexed_lookup", f"{AB}, l as (select folder, max(path) as path from replica_a where kind = 'File' group by 1) select 'path' as by, a.folder, a.path, a.size, a.hash from replica_a a join l using (folder, path) where folder = (select min(folder) from l) union all select 'key', a.folder, a.path, a.size, a.hash from replica_a a join l using (folder, path) where folder = (select max(folder) from l)")
def indexed_lookup(spark, d):
    """One entry by its path, and one by another spelling of it."""
    at = _indexed(spark, d)[0]
    last = spark.table(at).filter("kind = 'File'").groupBy("folder").agg(F.max("path").alias("path"))
    low, high = last.orderBy("folder").first(), last.orderBy(F.desc("folder")).first()
    found = index.at_path(spark, at, low["folder"], low["path"]).withColumn("by", F.lit("path"))
    other = index.at_key(spark, at, high["folder"], high["path"].upper().lower()).withColumn("by", F.lit("key"))
    return found.unionByName(other).select("by", "folder", "path", "size", "hash")


_TREE = """select concat(lang, '/d', cast(doc_id % 7 as string), '/', cast(doc_id as string), case when doc_id % 23 = 0 then '' else '.txt' end) as path, case when doc_id % 23 = 0 then 'Directory' when doc_id % 29 = 0 then 'Symlink' else 'File' end as kind,
  text as body, concat('../', lang) as target, case when doc_id % 11 = 0 or doc_id % 23 = 0 then 493 else 420 end as mode from {documents}"""


@query(
    "walked_snapshot",
    "with t as (" + _TREE.replace("{documents}", "documents") + """), u as (select path, kind, case when kind = 'File' then strlen(body) else 0 end::bigint as size, case kind when 'File' then sha256(body) when 'Symlink' then sha256(target) else '' end as hash, case when kind = 'Symlink' then target end as target, mode from t
      union all select distinct p, 'Directory', 0, '', null, 493 from (select string_split(path, '/') as s from t), (values (1), (2)) v(n), lateral (select array_to_string(s[1:n], '/') as p))
    select 'docs' as folder, path, kind, size, hash, target, case when kind = 'Symlink' then 511 else mode end::int as mode from u""",
)
def walked_snapshot(spark, d):
    """Documents as files, directories and links of a real tree in the shared folder, listed and hashed by the walk."""
    root = storage.mounted(spark, storage.temporary(spark, "tree")) + "/t"
    tree.laid_out(spark.sql(_TREE, documents=table(spark, d, "documents")), root)
    return tree.observed(tree.walked(spark, root, "docs", tasks=16)).select("folder", "path", "kind", "size", "hash", "target", "mode")
