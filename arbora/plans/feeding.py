"""Queries on change feeds, retention and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clocks
from ..operators import cache, chunks, conflicts, feed, reconcile, retention
from ..sources.fixtures import sql_with, view
from .base import clock_text, query, table
from .reconciling import _OUT

LANES = 3
_LANE = "case when kind <> 'File' or size < 1048576 then 0 else 1 + ('0x' || substr(sha256(path), 1, 15))::bigint % 2 end"
_J = sql_with("journal", "cursors", "lane_cursors") + f""", jl as (select *, {_LANE} as lane from journal),
known as (select peer, folder from cursors union select peer, folder from lane_cursors),
eff as (select k.peer, k.folder, l.lane, coalesce(o.value, c.value, 0) as cursor from known k cross join (values (0), (1), (2)) l(lane)
  left join lane_cursors o on o.peer = k.peer and o.folder = k.folder and o.lane = l.lane and o.lanes = 3 left join cursors c on c.peer = k.peer and c.folder = k.folder)"""
_PEER = "substr(peer, 2)::bigint"


def _cursors(spark, d):
    return view(spark, d, "cursors"), view(spark, d, "lane_cursors")


@query("change_feed", f"{sql_with('journal')} select seq, path, kind, size from journal where folder = 'A' and seq > 1000 order by seq limit 128")
def change_feed(spark, d):
    return feed.change_feed(view(spark, d, "journal"), "A", 1000, 128).select("seq", "path", "kind", "size")


@query("feed_heads", f"{sql_with('journal')} select folder, max(seq) as head from journal group by 1")
def feed_heads(spark, d):
    return feed.heads(view(spark, d, "journal"))


@query("lane_assignment", f"{_J} select folder, lane, count(*) as entries, sum(size)::bigint as bytes from jl group by 1, 2")
def lane_assignment(spark, d):
    j = view(spark, d, "journal")
    return j.groupBy("folder", feed.lane(F.col("path"), F.col("kind"), F.col("size"), LANES).alias("lane")).agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"))


def _page_sql(index: int) -> str:
    cls = "kind = 'File' and size >= 1048576" if index else "(kind <> 'File' or size < 1048576)"
    return f"select {index} as lane, seq, path from (select * from jl where folder = 'A' and seq > 500 and {cls} order by seq limit 128) where lane = {index} " + ("order by seq limit 1" if index else "")


@query("lane_page", f"{_J}, a as ({_page_sql(0)}), b as ({_page_sql(1)}), c as ({_page_sql(2)}) select * from a union all select * from b union all select * from c")
def lane_page(spark, d):
    j = view(spark, d, "journal")
    pages = [feed.lane_page(j, "A", 500, LANES, i)[0].select(F.lit(i).alias("lane"), "seq", "path") for i in range(LANES)]
    return pages[0].unionAll(pages[1]).unionAll(pages[2])


@query("lane_page_upto", f"{_J}, a as ({_page_sql(0)}), b as ({_page_sql(1)}), c as ({_page_sql(2)}) select 0 as lane, max(seq)::bigint as upto from a union all select 1, max(seq) from b union all select 2, max(seq) from c union all select 9, (select max(seq) from journal where folder = 'A')")
def lane_page_upto(spark, d):
    j = view(spark, d, "journal")
    head = j.filter("folder = 'A'").agg(F.max("seq").alias("h")).first()["h"]
    ups = [feed.lane_page(j, "A", 500, LANES, i)[1].select(F.lit(i).alias("lane"), "upto") for i in range(LANES)]
    last = feed.lane_page(j, "A", head - 1, LANES, 0)[1].select(F.lit(9).alias("lane"), "upto")
    return ups[0].unionAll(ups[1]).unionAll(ups[2]).unionAll(last)


@query("effective_cursors", f"{_J} select peer, folder, lane, cursor from eff")
def effective_cursors(spark, d):
    return feed.effective_cursors(*_cursors(spark, d), LANES)


@query(
    "lane_cursor_floor",
    f"""{sql_with('cursors', 'lane_cursors', 'cursor_updates')}, m as (select peer, folder, lane, max(value) as value from (select peer, folder, lane, value from lane_cursors where lanes = 3 union all select * from cursor_updates) group by 1, 2, 3),
    k as (select distinct peer, folder from cursor_updates),
    e as (select k.peer, k.folder, l.lane, coalesce(m.value, c.value, 0) as v from k cross join (values (0), (1), (2)) l(lane) left join m on m.peer = k.peer and m.folder = k.folder and m.lane = l.lane left join cursors c on c.peer = k.peer and c.folder = k.folder)
    select peer, folder, max(value) as value from (select * from cursors union all select peer, folder, min(v) from e group by 1, 2) group by 1, 2""",
)
def lane_cursor_floor(spark, d):
    return feed.advanced(*_cursors(spark, d), view(spark, d, "cursor_updates"), LANES)[0]


@query(
    "lane_cursors_advanced",
    f"{sql_with('lane_cursors', 'cursor_updates')} select peer, folder, lanes, lane, max(value) as value from (select * from lane_cursors union all select peer, folder, 3, lane, value from cursor_updates) group by 1, 2, 3, 4",
)
def lane_cursors_advanced(spark, d):
    return feed.advanced(*_cursors(spark, d), view(spark, d, "cursor_updates"), LANES)[1]


@query(
    "backlog_by_peer",
    f"""{_J} select k.peer, k.folder, count(j.seq) as entries, count(*) filter (where j.kind = 'File') as files, coalesce(sum(j.size) filter (where j.kind = 'File'), 0)::bigint as bytes
    from known k left join (select eff.peer, eff.folder, jl.* exclude (folder) from jl join eff on eff.folder = jl.folder and eff.lane = jl.lane and jl.seq > eff.cursor where jl.path not like '%/l5') j on j.peer = k.peer and j.folder = k.folder group by 1, 2""",
)
def backlog_by_peer(spark, d):
    return feed.backlog(view(spark, d, "journal"), *_cursors(spark, d), LANES, excluded=F.col("path").like("%/l5"))


@query(
    "sample_validity",
    f"{_J} select peer, folder, bool_and({_PEER} % 10 > 0 and cursor >= ({_PEER} * 37 + lane * 1100) % 30000) as valid from eff group by 1, 2",
)
def sample_validity(spark, d):
    """Backlog samples taken at other cursors; each tenth peer had fewer lanes then."""
    at = feed.effective_cursors(*_cursors(spark, d), LANES).groupBy("peer", "folder").agg(F.transform(F.array_sort(F.collect_list(F.struct("lane", F.col("cursor").alias("c")))), lambda x: x["c"]).alias("now"))
    peer = F.substring("peer", 2, 20).cast("long")
    lanes = F.when(peer % 10 == 0, F.slice(F.array(*map(F.lit, range(LANES))), 1, LANES - 1)).otherwise(F.array(*map(F.lit, range(LANES))))
    return at.select("peer", "folder", feed.still_valid(F.transform(lanes, lambda x: (peer * 37 + x * 1100) % 30000), F.col("now")).alias("valid"))


@query(
    "batch_legality",
    f"""{_J}, r as (select folder || ':' || floor((seq - 1) / 100)::bigint as batch, seq % 100 as position, case when seq % 977 = 0 then seq - 5 else seq end as seq, path, kind, size, floor((seq - 1) / 100)::bigint * 100 as prior, floor((seq - 1) / 100)::bigint * 100 + case when floor((seq - 1) / 100)::bigint % 7 = 3 then 50 else 100 end as upto, lane from jl),
    s as (select *, lag(seq) over (partition by batch order by seq0) as before from (select *, row_number() over (partition by batch order by prior + case when position = 0 then 100 else position end) as seq0 from r))
    select batch, count(*) as rows, concat_ws(',', case when bool_or(coalesce(before >= seq, false)) then 'sequence not increasing' end, case when bool_or(seq <= prior or seq > upto) then 'sequence outside the batch' end, case when bool_or(lane <> 0) then 'wrong lane' end) as reasons
    from s group by 1 having bool_or(seq <= prior or seq > upto) or bool_or(coalesce(before >= seq, false)) or bool_or(lane <> 0)""",
)
def batch_legality(spark, d):
    j = view(spark, d, "journal")
    batch = F.expr("(seq - 1) div 100")
    rows = j.select(F.concat("folder", F.lit(":"), batch.cast("string")).alias("batch"), F.col("seq").alias("position"), F.when(F.col("seq") % 977 == 0, F.col("seq") - 5).otherwise(F.col("seq")).alias("seq"), "path", "kind", "size", (batch * 100).alias("prior"), (batch * 100 + F.when(batch % 7 == 3, 50).otherwise(100)).alias("upto"), F.lit(0).alias("lane"))
    return feed.illegal_batches(rows, LANES).select("batch", "rows", F.array_join("reasons", ",").alias("reasons"))


_DEL = """select o_orderkey as id, o_orderkey % 31 <> 0 as approved, case when o_orderkey % 29 = 0 then 'receive-only' else 'two-way' end as mode, o_orderkey % 23 <> 0 as connected, case when o_orderkey % 19 <> 0 then 1000 + o_orderkey % 20 end as sampled_at,
  case when o_orderkey % 17 = 0 then 'local folder is receive-only' end as send_disabled, case when o_orderkey % 37 = 0 then 'x' end as error, cast(1020 as bigint) as now, case when o_orderkey % 41 <> 0 then case when o_orderkey % 3 = 0 then o_custkey * 10 else 0 end end as pending_entries,
  case when o_orderkey % 3 = 0 then o_custkey else 0 end as pending_files, case when o_orderkey % 3 = 0 then o_custkey * o_orderkey * 100 else 0 end as pending_bytes, o_orderkey % 43 <> 0 as complete, case when o_orderkey % 11 = 0 then 1 else 3 end as active_lanes,
  o_orderkey % 7 as a1, case when o_orderkey % 47 <> 0 then 5 end as a2, cast(3 as bigint) as local_head, case when o_orderkey % 5 = 0 then 1 else 0 end as conflicts, case when o_orderkey % 4 = 0 then 'polling' else 'watching' end as phase,
  case when o_orderkey % 13 = 0 then o_orderkey % 4 else 0 end as queued_paths, case when o_orderkey % 53 = 0 then 'y' end as folder_error, case when o_orderkey % 59 = 0 then 'z' end as watch_error, case when o_orderkey % 61 = 0 then 2 else 0 end as unwatched, o_orderkey % 67 = 0 as cooling from {orders}"""


@query(
    "delivery_label",
    "with d as (" + _DEL.replace("{orders}", "orders") + """), b as (select *, pending_bytes::double as n, case when complete then '' else '≥ ' end as p from d)
    select id, case when not approved then 'approval needed' when mode = 'receive-only' then 'sending disabled · receive-only' when not connected then 'offline · delivery unconfirmed' when sampled_at is null then 'awaiting delivery status'
      when send_disabled is not null then 'sending disabled · ' || send_disabled when error is not null then 'queue unavailable · d for details' when now - sampled_at > 15 then 'queue sample stale' when pending_entries is null then 'checking delivery'
      when pending_entries > 0 or not complete then p || format('{:,}', pending_files) || ' files · ' || p || case when n >= 1e12 then printf('%.2f TB', n / 1e12 + 1e-9) when n >= 1e9 then printf('%.2f GB', n / 1e9 + 1e-9) when n >= 1e6 then printf('%.2f MB', n / 1e6 + 1e-9) when n >= 1e3 then printf('%.2f kB', n / 1e3 + 1e-9) else printf('%.0f B', n) end || ' queued · ' || p || format('{:,}', greatest(pending_entries - pending_files, 0)) || ' metadata'
      when active_lanes < 2 then 'waiting for transfer lanes' when a1 < local_head or a2 is null or a2 < local_head then 'reconciling index' when conflicts > 0 then 'index delivered · conflicts remain' when phase <> 'watching' or queued_paths > 0 or folder_error is not null or watch_error is not null or unwatched > 0 or cooling then 'index delivered · scan pending' else 'indexed changes delivered' end as label from b""",
)
def delivery_label(spark, d):
    rows = spark.sql(_DEL, orders=table(spark, d, "orders"))
    c = {n: F.col(n) for n in rows.columns} | {"acknowledged": F.array(F.col("a1"), F.col("a2").cast("long"))}
    return rows.select("id", feed.delivery_label(c).alias("label"))


AT = 2_000_000
_DUE = f"""v as (select *, {AT} - saved_at >= 6 * 86400 and saved_at <= {AT} as old, sum(bytes) over (partition by folder) as total,
  coalesce(sum(bytes) over (partition by folder order by saved_at, id rows between unbounded preceding and 1 preceding), 0) as before from archives),
w as (select folder, id, bytes, case when old then 'version age' else 'version space limit' end as reason from v where old or total - before > 3000)"""


@query("version_retention", f"{sql_with('archives')}, {_DUE} select folder, id, bytes::bigint as bytes, reason from w")
def version_retention(spark, d):
    return retention.versions(view(spark, d, "archives"), AT, 6, 3000).select("folder", "id", F.col("bytes").cast("long").alias("bytes"), "reason")


_RETAINED = sql_with("archives", "replica_a", "replica_b") + f""", {_DUE}, {_OUT}"""


@query("retention_report", f"{_RETAINED} select count(*) as candidates, sum(bytes)::bigint as eligible_bytes, count(*) filter (where reason = 'version age') as removed, count(*) filter (where reason <> 'version age') as skipped, (select count(*) from o where outcome = 'conflict') as protected_conflicts from w")
def retention_report(spark, d):
    due = retention.versions(view(spark, d, "archives"), AT, 6, 3000)
    pending = conflicts.records(reconcile.outcomes(view(spark, d, "replica_a"), view(spark, d, "replica_b")))
    return retention.report(due.withColumn("bytes", F.col("bytes").cast("long")), due.filter("reason = 'version age'"), pending)


@query("signature_lru", f"{sql_with('archives')} select folder, id from (select *, sum(bytes) over w as s, row_number() over w as n from archives window w as (partition by folder order by saved_at desc, id desc rows between unbounded preceding and current row)) where s <= 4000 and n <= 8")
def signature_lru(spark, d):
    rows = view(spark, d, "archives").withColumn("used", F.col("saved_at"))
    return retention.lru(rows, 4000, 8, by="folder").select("folder", "id")


@query("feedback_trim", f"{sql_with('archives')} select folder, id from archives qualify row_number() over (partition by folder order by saved_at desc, id desc) <= 5")
def feedback_trim(spark, d):
    return retention.newest(view(spark, d, "archives").withColumn("used", F.col("saved_at")), 5, by="folder").select("folder", "id")


@query(
    "scan_cache",
    f"""{sql_with('archives')}, p as (select folder, id, split_part(id, '-', 1) as key, bytes, row_number() over (partition by folder order by id) as t from archives where bytes > 0 and bytes <= 900),
    q as (select *, coalesce(lead(t) over (partition by folder, key order by t), 1e9::bigint) as until from p),
    s as (select q.folder, q.t as low, n.t as now, sum(r.bytes) as held, count(*) as items from p n join q on q.folder = n.folder and q.t <= n.t and q.until > n.t join q r on r.folder = q.folder and r.t between q.t and n.t and r.until > n.t group by 1, 2, 3),
    gone as (select folder, max(low) as low from s where held > 3000 or items > 6 group by 1)
    select q.folder, q.id from q left join gone using (folder) where until = 1e9 and t > coalesce(low, 0)""",
)
def scan_cache(spark, d):
    puts = view(spark, d, "archives").withColumns({"position": F.col("id"), "key": F.substring_index("id", "-", 1)})
    return retention.scan_cache(puts, 3000, 6, 900, by="folder").select("folder", "id")


@query("partial_expiry", f"{sql_with('archives')} select folder, id, bytes::bigint as bytes from archives where length(id) % 2 = 0 and saved_at <= {AT} and {AT} - saved_at >= 8 * 86400")
def partial_expiry(spark, d):
    files = view(spark, d, "archives").withColumns({"modified": F.col("saved_at"), "name": F.when(F.length("id") % 2 == 0, F.concat(F.lit("resume-"), F.sha2("id", 256), F.lit(".part"))).otherwise(F.col("id"))})
    return retention.partials(files, AT, 8).select("folder", "id", F.col("bytes").cast("long").alias("bytes"))


@query(
    "resolved_conflict_expiry",
    f"""{sql_with('replica_a', 'replica_b')} select a.folder, a.path from replica_a a join replica_b b using (folder, path)
    where a.id % 3 <> 0 and {AT} - (1500000 + a.id * 997 % 500000) >= 86400 and a.ca <= b.ca + a.id % 2 and a.cb <= b.cb + a.id % 2""",
)
def resolved_conflict_expiry(spark, d):
    from ..operators.diff import KEY, packed

    a, b = view(spark, d, "replica_a"), view(spark, d, "replica_b")
    k = F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long")
    both = packed(a, "local").join(packed(b, "incoming"), KEY).withColumns({"id": F.sha2("path", 256), "k": k})
    archived = both.withColumns({"modified": 1500000 + F.col("k") * 997 % 500000, "bytes": F.lit(1)})
    up = lambda dev: F.coalesce(F.col("clock")[dev], F.lit(0)) + k % 2
    now = b.withColumn("clock", F.create_map(F.lit("A"), up("A"), F.lit("B"), up("B")))
    return retention.resolved(archived, archived.filter("k % 3 = 0"), now, AT, 1).select("folder", "path")


@query("artifact_limit", f"{sql_with('archives')} select folder, 'versions' as category, count(*) as artifacts from archives group by 1 having count(*) > 10")
def artifact_limit(spark, d):
    return retention.too_many(view(spark, d, "archives").withColumn("category", F.lit("versions")), 10)


@query("reclaimable_bytes", f"{sql_with('archives')} select folder, sum(case when length(id) % 3 = 0 then 0 else bytes end)::bigint as bytes from archives group by 1")
def reclaimable_bytes(spark, d):
    links = F.when(F.length("id") % 3 == 0, 2).otherwise(1)
    return view(spark, d, "archives").groupBy("folder").agg(F.sum(retention.reclaimable(F.col("bytes"), links)).alias("bytes"))


@query("unchanged_candidates", f"{sql_with('replica_a', 'snapshot')} select a.folder, a.path from replica_a a join snapshot s using (folder, path) where a.stamp = s.stamp")
def unchanged_candidates(spark, d):
    a, s = view(spark, d, "replica_a"), view(spark, d, "snapshot")
    got = retention.unchanged_since(a.withColumn("id", F.col("path")), s.withColumn("id", F.col("path")))
    return got.select("folder", "path")


BLOCK = 512
_BODY = "a as (select doc_id, text as body from documents), b as (select doc_id, case when doc_id % 6 = 0 then 'Q' || text when doc_id % 4 = 0 then left(text, 700) || 'zz' || substr(text, 703) else text end as body from documents)"
_BLK = f"""{_BODY}, ab as (select doc_id, k * {BLOCK} as o, (encode(body))[k * {BLOCK} + 1 : k * {BLOCK} + {BLOCK}] as x from a, unnest(range(0, ceil(strlen(body) / {BLOCK}.0)::bigint)) t(k) where body <> ''),
bb as (select doc_id, k * {BLOCK} as o, (encode(body))[k * {BLOCK} + 1 : k * {BLOCK} + {BLOCK}] as x from b, unnest(range(0, ceil(strlen(body) / {BLOCK}.0)::bigint)) t(k) where body <> ''),
f as (select doc_id, x, min(o) as basis_offset from ab group by 1, 2), plan as (select bb.doc_id, bb.o as "offset", octet_length(bb.x) as len, sha256(bb.x) as hash, f.basis_offset from bb left join f on f.doc_id = bb.doc_id and f.x = bb.x)"""


def _bodies(spark, d):
    docs = table(spark, d, "documents")
    b = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("Q"), F.col("text"))).when(F.col("doc_id") % 4 == 0, F.concat(F.expr("left(text, 700)"), F.lit("zz"), F.expr("substring(text, 703)"))).otherwise(F.col("text"))
    return docs.select("doc_id", F.col("text").alias("body")), docs.select("doc_id", b.alias("body"))


def _planned(spark, d):
    a, b = _bodies(spark, d)
    return chunks.plan(chunks.fixed_blocks(b, BLOCK, keep=("doc_id",)), chunks.fixed_blocks(a, BLOCK, keep=("doc_id",)), ["doc_id"])


@query("chunk_plan", f'with {_BLK} select doc_id, "offset", len, hash, basis_offset from plan')
def chunk_plan(spark, d):
    return _planned(spark, d)


@query("fixed_block_reuse", f"with {_BLK} select doc_id, sum(len)::bigint as size, coalesce(sum(len) filter (where basis_offset is not null), 0)::bigint as reused, count(*) as operations, coalesce(sum(len) filter (where basis_offset is null), 0)::bigint as literal from plan group by 1")
def fixed_block_reuse(spark, d):
    return chunks.reuse(_planned(spark, d), ["doc_id"]).drop("reused_percent")


@query("delta_worthwhile", f"with {_BLK}, r as (select doc_id, sum(len) as size, coalesce(sum(len) filter (where basis_offset is not null), 0) as reused, count(*) * 120 as meta from plan group by 1) select doc_id, reused * 100 >= meta + greatest(floor(size * 100 / 20), 262144) as worthwhile, strlen(body) * 100 >= 1048576 and size * 100 >= 1048576 as eligible from r join a using (doc_id)")
def delta_worthwhile(spark, d):
    r = chunks.reuse(_planned(spark, d), ["doc_id"]).join(_bodies(spark, d)[0], "doc_id")
    return r.select("doc_id", chunks.worthwhile(F.col("reused") * 100, F.col("operations") * 120, F.col("size") * 100).alias("worthwhile"), chunks.eligible(F.octet_length("body") * 100, F.col("size") * 100).alias("eligible"))


@query("chunk_parameters", "select doc_id, m as min_len, m * 16 as max_len, m * 4 - 1 as mask from (select doc_id, pow(2, ceil(log2(greatest(ceil(greatest(strlen(text), n_chars * 3) / 8192), 64))))::bigint as m from documents)")
def chunk_parameters(spark, d):
    return table(spark, d, "documents").select("doc_id", *chunks.parameter_columns(F.octet_length("text"), F.col("n_chars") * 3, 64))


@query("signature_checks", f"with {_BLK} select doc_id, strlen(body)::bigint as size from a where doc_id % 10 = 0 and strlen(body) > {BLOCK}")
def signature_checks(spark, d):
    a, _ = _bodies(spark, d)
    rows = chunks.fixed_blocks(a, BLOCK, keep=("doc_id",)).filter(f"not (doc_id % 10 = 0 and offset = {BLOCK})")
    return chunks.broken_signatures(rows, a.select("doc_id", F.octet_length("body").cast("long").alias("size")), ["doc_id"], BLOCK).select("doc_id", "size")


@query("plan_checks", f"with {_BLK}, s as (select doc_id, sum(len)::bigint as total from plan group by 1) select doc_id from s where doc_id % 14 = 0")
def plan_checks(spark, d):
    a, b = _bodies(spark, d)
    sizes = b.select("doc_id", (F.octet_length("body") + F.when(F.col("doc_id") % 14 == 0, 1).otherwise(0)).alias("remaining")).join(a.select("doc_id", F.octet_length("body").alias("basis_size")), "doc_id")
    return chunks.broken_plans(_planned(spark, d), sizes, ["doc_id"], BLOCK).select("doc_id")


@query("copy_verification", f"with {_BLK} select doc_id, count(*) as bad from plan where basis_offset is not null and doc_id % 7 = 0 group by 1")
def copy_verification(spark, d):
    a, _ = _bodies(spark, d)
    spoiled = a.withColumn("body", F.when(F.col("doc_id") % 7 == 0, F.translate("body", "".join(map(chr, range(32, 127))), "".join(map(chr, range(33, 128))))).otherwise(F.col("body")))
    return chunks.bad_copies(_planned(spark, d), spoiled, ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("bad"))


@query("reassembly", f"with {_BODY} select doc_id, sha256(body) as hash from b where body <> ''")
def reassembly(spark, d):
    a, b = _bodies(spark, d)
    return chunks.reassembled(_planned(spark, d), b, a, ["doc_id"]).select("doc_id", F.sha2("body", 256).alias("hash"))


@query("resume_prefix", "select doc_id, case when doc_id % 3 = 0 or strlen(text) < 100 then 0 else 100 end as \"offset\", sha256('[\"p1\",\"d' || doc_id || '\",\"' || sha256(text) || '\",\"' || strlen(text) || '\"]') as key from documents")
def resume_prefix(spark, d):
    docs = table(spark, d, "documents")
    offered = F.sha2(F.when(F.col("doc_id") % 3 == 0, F.lit("x").cast("binary")).otherwise(F.substring(F.col("text").cast("binary"), 1, 100)), 256)
    key = chunks.resume_key(F.lit("p1"), F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.sha2("text", 256), F.octet_length("text"))
    return docs.select("doc_id", chunks.resume_offset(F.col("text"), F.lit(100), offered).alias("offset"), key.alias("key"))


@query("cdc_signature")
def cdc_signature(spark, d):
    docs = table(spark, d, "documents")
    return chunks.signature(docs, "text", ("doc_id",), min_floor=64)


@query("cdc_invariants", "select doc_id, strlen(text)::bigint as size, true as contiguous, true as bounded from documents where text <> ''")
def cdc_invariants(spark, d):
    docs = table(spark, d, "documents")
    sig = chunks.signature(docs, "text", ("doc_id",), min_floor=64).join(docs.select("doc_id", *chunks.parameter_columns(F.octet_length("text"), F.lit(0), 64)), "doc_id")
    return sig.groupBy("doc_id").agg(F.sum("len").alias("size"), (F.max(F.col("offset") + F.col("len")) == F.sum("len")).alias("contiguous"), (F.max("len") <= F.max("max_len")).alias("bounded"))


@query("cdc_reuse")
def cdc_reuse(spark, d):
    a, b = _bodies(spark, d)
    return chunks.reuse(chunks.plan(chunks.signature(b, "body", ("doc_id",), 64), chunks.signature(a, "body", ("doc_id",), 64), ["doc_id"]), ["doc_id"])


@query(
    "adaptive_skips",
    """with recursive e as (select user_id, event_id, event_type <> 'error' as useful, row_number() over (partition by user_id order by event_id) as n from events),
    s as (select user_id, event_id, n, useful, 0 as left0, case when useful then 0 else 3 end as remaining from e where n = 1
      union all select e.user_id, e.event_id, e.n, e.useful, s.remaining, case when s.remaining > 0 then s.remaining - 1 when e.useful then 0 else 3 end from s join e on e.user_id = s.user_id and e.n = s.n + 1)
    select user_id, event_id, left0 > 0 as skipped from s""",
)
def adaptive_skips(spark, d):
    e = table(spark, d, "events").withColumn("useful", F.col("event_type") != "error")
    return chunks.skips(e, ["user_id"], "event_id")


@query("plan_metadata", f"""with {_BLK} select doc_id, (sum(strlen('{{"len":' || len || ',"hash":"' || hash || '"' || coalesce(',"basis_offset":' || basis_offset, '') || '}}')) + count(*) + 1)::bigint as metadata from plan group by 1""")
def plan_metadata(spark, d):
    return chunks.plan_metadata(_planned(spark, d), ["doc_id"])


@query("lane_validity", "select s_suppkey as id, s_suppkey % 10 between 1 and 8 and s_suppkey % 12 >= 1 and s_suppkey % 12 - 1 < s_suppkey % 10 as valid from supplier")
def lane_validity(spark, d):
    i = F.col("s_suppkey")
    return table(spark, d, "supplier").select(i.alias("id"), feed.valid_lane(i % 12 - 1, i % 10).alias("valid"))


_SIDES = "select s_suppkey as id, case s_suppkey % 3 when 0 then 'two-way' when 1 then 'send-only' else 'receive-only' end as local_mode, case cast(floor(s_suppkey / 3) as bigint) % 3 when 0 then 'two-way' when 1 then 'send-only' else 'receive-only' end as remote_mode from {supplier}"


def _sides(spark, d):
    return spark.sql(_SIDES, supplier=table(spark, d, "supplier"))


@query("send_disabled", f"select *, case when local_mode = 'receive-only' then 'local folder is receive-only' when remote_mode = 'send-only' then 'peer folder is send-only (last handshake)' end as reason from ({_SIDES.replace('{supplier}', 'supplier')})")
def send_disabled(spark, d):
    return _sides(spark, d).withColumn("reason", feed.send_disabled(F.col("local_mode"), F.col("remote_mode")))


@query("direction_matrix", f"select *, local_mode <> 'receive-only' and remote_mode <> 'send-only' as sends, local_mode <> 'send-only' and remote_mode <> 'receive-only' as receives, local_mode = remote_mode and local_mode <> 'two-way' as mismatch from ({_SIDES.replace('{supplier}', 'supplier')})")
def direction_matrix(spark, d):
    return reconcile.directions(_sides(spark, d))


@query(
    "retention_categories",
    "select s_suppkey as id, concat_ws(',', case when s_suppkey % 4 = 0 or s_suppkey % 6 = 0 then 'versions' end, case when s_suppkey % 5 = 0 then 'partials' end, case when s_suppkey % 7 = 0 then 'conflicts' end) as categories from supplier",
)
def retention_categories(spark, d):
    i = F.col("s_suppkey")
    when = lambda k: F.when(i % k == 0, 30)
    policy = {"versions_days": when(4), "versions_max_bytes": when(6), "partial_days": when(5), "resolved_conflicts_days": when(7)}
    return table(spark, d, "supplier").select(i.alias("id"), F.array_join(retention.enabled_columns(policy), ",").alias("categories"))


_SIGNED = f"""{sql_with('archives')}, s as (select sha256(concat_ws(chr(10), folder, id, 's', bytes::varchar, '64')) as key, id || ':' || folder as data, bytes, case when bytes % 3 = 0 then {AT} - 30 else saved_at end as used from archives)"""


def _signatures(spark, d):
    """A cache out of the archives: some records too large, some with a broken checksum."""
    a = view(spark, d, "archives")
    key = cache.cache_key(F.col("folder"), F.col("id"), F.lit("s"), F.col("bytes"), F.lit(64))
    rows = a.select(key.alias("key"), F.concat("id", F.lit(":"), "folder").alias("data"), F.col("bytes").alias("n"), F.when(F.col("bytes") % 3 == 0, AT - 30).otherwise(F.col("saved_at")).cast("long").alias("used"))
    return rows.withColumns({"checksum": F.when(F.col("n") % 5 == 0, "x").otherwise(F.sha2("data", 256)), "bytes": F.col("n").cast("long") * 2000})


@query("signature_cache_get", f"{_SIGNED} select key, data, used < {AT} - 60 as touched from s where bytes * 2000 <= 2097152 and bytes % 5 <> 0 and bytes % 2 = 0")
def signature_cache_get(spark, d):
    rows = _signatures(spark, d)
    return cache.get(rows, rows.filter("n % 2 = 0"), 4, AT)


@query("signature_cache_touch", f"{_SIGNED} select used, count(*) as records from (select case when bytes * 2000 <= 2097152 and bytes % 5 <> 0 and bytes % 2 = 0 and used < {AT} - 60 then {AT} else used end as used from s) group by 1")
def signature_cache_touch(spark, d):
    rows = _signatures(spark, d)
    return cache.touch(rows, cache.get(rows, rows.filter("n % 2 = 0"), 4, AT), AT).groupBy("used").agg(F.count("*").alias("records"))


_PUT = f"""{_SIGNED}, u as (select key, data, strlen(data)::bigint as bytes, used from s where bytes % 7 <> 0 union all select key, 'new' || data, strlen(data)::bigint + 3, {AT} from s where bytes % 7 = 0),
k as (select *, sum(bytes) over (order by used desc, key desc rows between unbounded preceding and current row) as total, row_number() over (order by used desc, key desc) as n from u)"""


@query("signature_cache_put", f"{_PUT} select key, data, bytes, used from k where n <= 60 and total <= 1048576")
def signature_cache_put(spark, d):
    rows = _signatures(spark, d)
    small = rows.withColumn("bytes", F.octet_length("data").cast("long"))
    return cache.put(small, rows.filter("n % 7 = 0").select("key", F.concat(F.lit("new"), "data").alias("data")), 1, AT, 60).select("key", "data", "bytes", "used")


@query("signature_cache_totals", f"{_PUT} select coalesce(sum(bytes), 0)::bigint as bytes, count(*) as rows from k where n <= 60 and total <= 1048576")
def signature_cache_totals(spark, d):
    return cache.totals(signature_cache_put(spark, d))
