"""Catalog tables derived from the plain test tables: the same SQL text serves Spark and the SQL oracle.

OCT[x] is the number of bytes of a text and SHA[x] its SHA-256 in hex; both are spelled differently by the two engines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import running

VIEWS = {
    "replica_a": """
      select folder, path, kind, case when kind = 'File' then OCT[body] else 0 end as size, case kind when 'File' then SHA[body] when 'Symlink' then SHA[goal] else '' end as hash,
             case when kind = 'Symlink' then goal end as target, mode, ca, cb, row_number() over (partition by folder order by id) as seq, case when kind = 'Deleted' then '' else concat('1:', cast(id as string), ':', cast(OCT[body] as string), ':7:0:7:0') end as stamp, id
      from (select doc_id as id, source as folder, concat(lang, '/d', cast(doc_id % 7 as string), '/', cast(doc_id as string), '.txt') as path, text as body, concat('../', lang) as goal,
                   case when doc_id % 19 = 0 then 'Deleted' when doc_id % 23 = 0 then 'Directory' when doc_id % 29 = 0 then 'Symlink' else 'File' end as kind,
                   case when doc_id % 11 = 0 then 493 else 420 end as mode, 1 + doc_id % 3 as ca, doc_id % 2 as cb
            from {documents} where doc_id % 10 <> 3) x""",
    "replica_b": """
      select folder, path, kind, case when kind = 'File' then OCT[body] else 0 end as size, case kind when 'File' then SHA[body] when 'Symlink' then SHA[goal] else '' end as hash,
             case when kind = 'Symlink' then goal end as target, mode, ca, cb, row_number() over (partition by folder order by id) as seq, case when kind = 'Deleted' then '' else concat('2:', cast(id as string), ':', cast(OCT[body] as string), ':7:0:7:0') end as stamp, id
      from (select doc_id as id, source as folder, concat(lang, '/d', cast(doc_id % 7 as string), '/', cast(doc_id as string), '.txt') as path, case when doc_id % 5 = 0 then concat(text, ' v2') else text end as body, concat('../', lang) as goal,
                   case when doc_id % 17 = 0 then 'Deleted' when doc_id % 23 = 0 then 'Directory' when doc_id % 29 = 0 then 'Symlink' else 'File' end as kind,
                   case when doc_id % 11 = 0 or doc_id % 31 = 0 then 493 else 420 end as mode, 1 + cast(floor(doc_id / 3) as bigint) % 3 as ca, cast(floor(doc_id / 2) as bigint) % 2 as cb
            from {documents} where doc_id % 10 <> 7) x""",
    "snapshot": """
      select folder, path, kind, case when kind = 'File' then OCT[body] else 0 end as size, case kind when 'File' then SHA[body] when 'Symlink' then SHA[goal] else '' end as hash,
             case when kind = 'Symlink' then goal end as target, mode, concat('1:', cast(id as string), ':', cast(OCT[body] as string), ':', case when id % 6 = 0 then '8' else '7' end, ':0:7:0') as stamp
      from (select doc_id as id, source as folder, concat(lang, '/d', cast(doc_id % 7 as string), '/', cast(doc_id as string), '.txt') as path, case when doc_id % 12 = 0 then concat(text, ' edited') else text end as body, concat('../', lang) as goal,
                   case when doc_id % 23 = 0 then 'Directory' when doc_id % 29 = 0 then 'Symlink' else 'File' end as kind, case when doc_id % 11 = 0 or doc_id % 37 = 0 then 493 else 420 end as mode
            from {documents} where doc_id % 13 <> 0) x""",
    "receiving": """
      select folder, path, kind, size, hash, target, mode, ca + 1 as ca, cb + 1 as cb from ({replica_b}) y where id % 4 = 0""",
    "journal": """
      select l_returnflag as folder, concat('o', cast(l_orderkey as string), '/l', cast(l_linenumber as string)) as path, case when l_linenumber = 7 then 'Deleted' else 'File' end as kind, cast(floor(l_extendedprice * 20) as bigint) as size,
             row_number() over (partition by l_returnflag order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as seq
      from {lineitem}""",
    "cursors": """
      select concat('p', cast(o_custkey as string)) as peer, case o_orderkey % 3 when 0 then 'A' when 1 then 'N' else 'R' end as folder, max(o_orderkey) as value
      from {orders} where o_orderkey % 4 <> 1 group by 1, 2""",
    "lane_cursors": """
      select concat('p', cast(o_custkey as string)) as peer, case o_orderkey % 3 when 0 then 'A' when 1 then 'N' else 'R' end as folder, case when o_orderkey % 5 = 0 then 2 else 3 end as lanes,
             cast(o_custkey % 2 + o_orderkey % 2 as int) as lane, max(o_orderkey + o_custkey) as value
      from {orders} where o_orderkey % 4 <> 2 and (o_orderkey % 5 > 0 or o_custkey % 2 + o_orderkey % 2 < 2) group by 1, 2, 3, 4""",
    "cursor_updates": """
      select concat('p', cast(o_custkey as string)) as peer, case o_orderkey % 3 when 0 then 'A' when 1 then 'N' else 'R' end as folder, cast(o_orderkey % 7 % 3 as int) as lane, o_orderkey * 2 as value
      from {orders} where o_orderkey % 6 < 3""",
    "fs_events": """
      select event_id, user_id, ts, concat('u', cast(user_id % 20 as string), '/d', cast(event_id % 7 as string), '/f', cast(event_id % 50 as string)) as path,
             case event_type when 'click' then 'Modify(Data)' when 'view' then 'Access' when 'purchase' then 'Create' when 'signup' then 'Modify(Name)' else 'Remove' end as kind
      from {events}""",
    "archives": """
      select concat('c', cast(conv_id % 50 as string)) as folder, concat('v', cast(conv_id as string), '-', cast(turn as string)) as id, 1000000 + (conv_id * 7919 + turn * 104729) % 900000 as saved_at, OCT[text] as bytes
      from {conversations}""",
}


#: The order of the journal's rows, as in its text.
_JOURNAL_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def text_of(name: str, spark: bool) -> str:
    """The SQL of a view for one engine; tables stay as {name} for Spark."""
    sql = VIEWS[name]
    for inner in re.findall(r"\{(\w+)\}", sql):
        if inner in VIEWS:
            sql = sql.replace("{%s}" % inner, text_of(inner, spark))
        elif not spark:
            sql = sql.replace("{%s}" % inner, inner)
    sql = re.sub(r"OCT\[(\w+)\]", r"octet_length(\1)" if spark else r"strlen(\1)", sql)
    return re.sub(r"SHA\[(\w+)\]", r"sha2(\1, 256)" if spark else r"sha256(\1)", sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; entries get their clock as a map without zeros.  The journal is numbered by ranges of its three
    folders, with the same numbers as its text gives."""
    if name == "journal":
        # Paths and kinds are made out of the numbered rows, so that they aren't sorted.
        lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", *_JOURNAL_ORDER)
        rows = running(lines, ["l_returnflag"], _JOURNAL_ORDER, name="seq", drop=["l_shipdate", "l_partkey", "l_suppkey", "l_quantity"])
        return spark.sql(re.sub(r"row_number\(\).*? as seq", "cast(seq as int) as seq", VIEWS[name], flags=re.S), lineitem=rows)
    sql = text_of(name, True)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    df = spark.sql(sql, **tables)
    if "ca" in df.columns:
        clock = F.map_filter(F.create_map(F.lit("A"), F.col("ca").cast("long"), F.lit("B"), F.col("cb").cast("long")), lambda k, v: v > 0)
        df = df.withColumn("clock", clock).drop("ca", "cb", "id")
    return df


def sql_with(*names: str) -> str:
    """The same views as the beginning of an oracle statement."""
    return "with " + ",\n".join(f"{n} as ({text_of(n, False)})" for n in names)
