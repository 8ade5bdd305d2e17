"""Quotation linking: replies find the messages that they quote.

A line's quote level is the number of '>' it begins with.  Neighbouring lines of one level that aren't blank make a passage;
the whole passage, and each of its lines of MIN_WORDS words or more, is normalised (lower case, single spaces) and hashed.
Quoted passages (level 1 and above) are joined by hash to the messages that say the same as their own words (level 0): to the
first in their own conversation, else the first anywhere.  A message answers what its lowest level quotes - whole passages
before lines, its own conversation before others, the latest of those - and only messages earlier than itself (by conversation
and turn).  Chains of answers give each message the conversation it belongs to and its depth; the text without quotes and
without the lines that introduce them is what is kept.

DataFrame functions only.  "First" is a grouped minimum, so a passage in very many messages makes no pairs.

Cases: null texts are empty; a message without quotes, or whose quotes nobody has said, begins a chain and stays in its own
conversation; blank passages link nothing; messages that share conversation and turn count as one for links and keep a row
each; rows whose conversation or turn is null aren't linked; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

MIN_WORDS = 5
_QUOTE = r"^[ \t]*((?:>[ \t]*)+)"
#: The line that introduces a quotation, in the languages of the corpus.
_INTRO = r"(?i)^\s*(on|le|am|el)\b.*\b(wrote|écrit|schrieb|escribió)\s*:\s*$"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own (the text without quotes) and passages (level, whole, text)."""
    line = F.transform(F.split(F.translate(F.coalesce("text", F.lit("")), "\x01\x02\r", ""), "\n"), lambda x: F.struct(F.regexp_extract(x, _QUOTE, 1).alias("marks"), F.regexp_replace(x, _QUOTE, "").alias("body")))
    lines = messages.select("conv_id", "turn", "role", line.alias("lines")).withColumn("lines", F.transform("lines", lambda x: F.struct((F.length(x["marks"]) - F.length(F.replace(x["marks"], F.lit(">"), F.lit("")))).alias("level"), x["body"].alias("body"))))
    nothing = F.array(F.struct(F.lit(-1).alias("level"), F.lit("").alias("body")))
    # Each line after the one before it: a new passage begins where the level changes or the line before is blank.
    marked = F.zip_with(
        "lines",
        F.slice(F.concat(nothing, F.col("lines")), 1, F.size("lines")),
        lambda x, y: F.concat(F.when((x["level"] != y["level"]) | (F.trim(y["body"]) == ""), F.concat(F.lit("\x01"), x["level"].cast("string"), F.lit("\x02"))).otherwise(F.lit("\n")), x["body"]),
    )
    pieces = F.transform(F.filter(F.split(F.array_join(marked, ""), "\x01"), lambda p: p != ""), lambda p: F.struct(F.substring_index(p, "\x02", 1).cast("int").alias("level"), F.substring_index(p, "\x02", -1).alias("text")))
    quoted = F.exists("lines", lambda x: x["level"] > 0)
    bodies = lambda keep: F.array_join(F.transform(F.filter("lines", keep), lambda x: x["body"]), "\n")
    own = F.regexp_replace(bodies(lambda x: (x["level"] == 0) & ~x["body"].rlike(_INTRO)), r"^\s+|\s+$", "")
    return lines.select("conv_id", "turn", "role", quoted.alias("quotes"), F.when(quoted, own).otherwise(bodies(lambda x: x["level"] == 0)).alias("own"), pieces.alias("passages"))


def _units(rows: DataFrame) -> DataFrame:
    """conv_id, turn, level, whole, h: whole passages, and lines that are long enough."""
    passage = rows.select("conv_id", "turn", F.explode("passages").alias("p"))
    parts = F.concat(F.array(F.struct(F.lit(1).alias("whole"), F.col("p.text").alias("text"))), F.transform(F.split("p.text", "\n"), lambda x: F.struct(F.lit(0).alias("whole"), x.alias("text"))))
    unit = passage.select("conv_id", "turn", F.col("p.level").alias("level"), F.explode(parts).alias("u")).select("conv_id", "turn", "level", F.col("u.whole").alias("whole"), _normal(F.col("u.text")).alias("t"))
    return unit.filter((F.col("t") != "") & ((F.col("whole") == 1) | (F.size(F.split("t", " ")) >= MIN_WORDS))).select("conv_id", "turn", "level", "whole", F.md5("t").alias("h"))


def linked(messages: DataFrame) -> DataFrame:
    """conv_id, turn, parent_conv, parent_turn of every message that answers another one."""
    rows = parsed(messages).filter("conv_id is not null and turn is not null")
    asked = written(_units(rows.filter("quotes")).filter("level > 0").groupBy("conv_id", "turn", "h").agg(F.min("level").alias("level"), F.max("whole").alias("whole")), "quotes-asked")
    if asked.isEmpty():
        return asked.select("conv_id", "turn", F.col("conv_id").alias("parent_conv"), F.col("turn").alias("parent_turn"))
    said = _units(rows).filter("level = 0").join(asked.select("h").distinct(), "h", "left_semi")
    here = written(said.groupBy("h", "conv_id").agg(F.min("turn").alias("t")), "quotes-said")
    first = here.groupBy("h").agg(F.min(F.struct("conv_id", "t")).alias("f")).select("h", F.col("f.conv_id").alias("fc"), F.col("f.t").alias("ft"))
    near = asked.join(here, ["h", "conv_id"], "left").join(first, "h", "left")
    own = F.col("t").isNotNull() & (F.col("t") < F.col("turn"))
    found = near.select("conv_id", "turn", "level", "whole", own.cast("int").alias("own"), F.when(own, F.col("conv_id")).otherwise(F.col("fc")).alias("pc"), F.when(own, F.col("t")).otherwise(F.col("ft")).alias("pt"))
    found = found.filter("pc is not null and (pc < conv_id or pc = conv_id and pt < turn)")
    best = found.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "whole", "own", "pc", "pt")).alias("b"))
    return written(best.select("conv_id", "turn", F.col("b.pc").alias("parent_conv"), F.col("b.pt").alias("parent_turn")), "quotes-links")


def threads(links: DataFrame) -> DataFrame:
    """links with thread_conv, thread_turn (the first message of the chain) and depth, by doubling the step of each round."""
    now = links.select("conv_id", "turn", "parent_conv", "parent_turn", F.col("parent_conv").alias("thread_conv"), F.col("parent_turn").alias("thread_turn"), F.lit(1).cast("long").alias("depth"))
    while True:
        up = now.select(F.col("conv_id").alias("thread_conv"), F.col("turn").alias("thread_turn"), F.col("thread_conv").alias("nc"), F.col("thread_turn").alias("nt"), F.col("depth").alias("nd"))
        step = now.join(up, ["thread_conv", "thread_turn"], "left")
        then = written(
            step.select("conv_id", "turn", "parent_conv", "parent_turn", F.coalesce("nc", "thread_conv").alias("thread_conv"), F.coalesce("nt", "thread_turn").alias("thread_turn"), (F.col("depth") + F.coalesce("nd", F.lit(0))).alias("depth"), F.col("nc").isNotNull().alias("moved")),
            "quotes-threads",
        )
        going = not then.filter("moved").isEmpty()
        discard(now)
        now = then
        if not going:
            return now.drop("moved")


def conversations(messages: DataFrame) -> DataFrame:
    """Every message with its text without quotes (`own`), the message it answers, and its place: thread_id (a conversation),
    depth, and then its own conversation and turn give the reply order."""
    links = linked(messages)
    chains = links.withColumns({"thread_conv": F.col("conv_id"), "depth": F.lit(0).cast("long")}) if links.isEmpty() else threads(links)
    chains = chains.select("conv_id", "turn", "parent_conv", "parent_turn", "thread_conv", "depth")
    rows = parsed(messages)
    return rows.join(chains, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "own", F.size(F.filter("passages", lambda p: p["level"] > 0)).alias("n_quotes"), "parent_conv", "parent_turn", F.coalesce("thread_conv", "conv_id").alias("thread_id"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth")
    )


def ordered(linked_messages: DataFrame) -> DataFrame:
    """The messages of conversations() as conversations: sorted by thread, and inside by reply order."""
    return linked_messages.orderBy("thread_id", "depth", "conv_id", "turn")


QUOTES_SQL = rf"""
with recursive l as (
  select conv_id, turn, i, length(marks) - length(replace(marks, '>', '')) as level, regexp_replace(x, '^[ \t]*((?:>[ \t]*)+)', '') as body
  from (select conv_id, turn, i, x, regexp_extract(x, '^[ \t]*((?:>[ \t]*)+)', 1) as marks
        from (select conv_id, turn, unnest(string_split(t, chr(10))) as x, unnest(range(1, 1 + len(string_split(t, chr(10))))) as i
              from (select conv_id, turn, replace(coalesce(text, ''), chr(13), '') as t from conversations)))),
s as (
  select *, case when i = 1 or level <> lag(level) over w or trim(lag(body) over w) = '' then 1 else 0 end as new from l window w as (partition by conv_id, turn order by i)),
g as (
  select *, sum(new) over (partition by conv_id, turn order by i) as k from s),
u as (
  select conv_id, turn, level, 1 as whole, string_agg(body, chr(10) order by i) as t from g group by conv_id, turn, level, k
  union all select conv_id, turn, level, 0, body from g),
n as (
  select conv_id, turn, level, whole, md5(t) as h from (select conv_id, turn, level, whole, trim(regexp_replace(lower(t), '\s+', ' ', 'g')) as t from u)
  where t <> '' and (whole = 1 or len(string_split(t, ' ')) >= {MIN_WORDS})),
a as (
  select conv_id, turn, h, min(level) as level, max(whole) as whole from n where level > 0 group by all),
e as (
  select h, conv_id, min(turn) as t from n where level = 0 group by all),
f as (
  select h, arg_min(conv_id, (conv_id, t)) as fc, arg_min(t, (conv_id, t)) as ft from e group by h),
c as (
  select a.conv_id, a.turn, level, whole, coalesce(e.t < a.turn, false) as own, case when e.t < a.turn then a.conv_id else fc end as pc, case when e.t < a.turn then e.t else ft end as pt
  from a left join e using (h, conv_id) left join f using (h)),
p as (
  select conv_id, turn, pc, pt from (
    select *, row_number() over (partition by conv_id, turn order by level, whole desc, own desc, pc desc, pt desc) as r from c
    where pc is not null and (pc < conv_id or pc = conv_id and pt < turn)) where r = 1),
up as (
  select conv_id, turn, pc, pt, pc as tc, pt as tt, 1 as depth from p
  union all select up.conv_id, up.turn, up.pc, up.pt, p.pc, p.pt, up.depth + 1 from up join p on p.conv_id = up.tc and p.turn = up.tt),
top as (
  select conv_id, turn, pc, pt, arg_max(tc, depth) as tc, max(depth) as depth from up group by all),
q as (
  select conv_id, turn, count(distinct case when level > 0 and body <> '' then k end) as n_quotes, max(level) > 0 as quotes,
         string_agg(body, chr(10) order by i) filter (where level = 0) as own0,
         string_agg(body, chr(10) order by i) filter (where level = 0 and not regexp_matches(body, '(?i)^\s*(on|le|am|el)\b.*\b(wrote|écrit|schrieb|escribió)\s*:\s*$')) as own1
  from g group by conv_id, turn)
select m.conv_id, m.turn, m.role, q.n_quotes::int as n_quotes, md5(coalesce(case when quotes then regexp_replace(own1, '^\s+|\s+$', '', 'g') else own0 end, '')) as own_md5,
       top.pc as parent_conv, top.pt as parent_turn, coalesce(top.tc, m.conv_id) as thread_id, coalesce(top.depth, 0)::bigint as depth
from conversations m join q using (conv_id, turn) left join top using (conv_id, turn)
"""


HOT = "As the very first message of this list says, be kind to each other."


def quoting(messages: DataFrame) -> DataFrame:
    """Messages that quote, made from ones that don't: a turn quotes the one before it, on two levels the one before that, and
    at turn 2 a sentence (HOT) that every conversation's first message says too.

    Rows that share conversation and turn, or have none, and null texts, are left as they are (without the sentence)."""
    once = messages.filter("conv_id is not null and turn is not null and text is not null").groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.min("text").alias("t")).filter("n = 1").select("conv_id", "turn", "t")
    earlier = lambda k: once.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("t").alias(f"t{k}"))
    alone = once.select("conv_id", "turn", F.lit(True).alias("alone"))
    rows = messages.select("conv_id", "turn", "role", "text").join(alone, ["conv_id", "turn"], "left").join(earlier(1), ["conv_id", "turn"], "left").join(earlier(2), ["conv_id", "turn"], "left")
    marked = lambda mark, text: F.concat(F.lit(mark), F.replace(text, F.lit("\n"), F.lit("\n" + mark)), F.lit("\n"))
    head = F.concat(
        F.when(F.col("t2").isNotNull(), marked("> > ", F.col("t2"))).otherwise(""),
        F.when(F.col("t1").isNotNull(), F.concat(marked("> ", F.col("t1")), F.lit("On that day somebody wrote:\n"))).otherwise(""),
        F.when(F.col("turn") == 2, marked("> ", F.lit(HOT))).otherwise(""),
        F.when(F.col("turn") == 0, F.lit(HOT + "\n\n")).otherwise(""),
    )
    return rows.select("conv_id", "turn", "role", F.when(F.col("alone"), F.concat(head, "text")).otherwise(F.col("text")).alias("text"))


#: QUOTES_SQL over the messages of quoting().
QUOTING_SQL = QUOTES_SQL.replace("from conversations", "from quoting").replace(
    "with recursive l as (",
    f"""with recursive once as (
  select conv_id, turn, min(text) as t from conversations where conv_id is not null and turn is not null and text is not null group by all having count(*) = 1),
quoting as (
  select m.conv_id, m.turn, m.role, case when z.t is null then m.text else
    case when b.t is not null then '> > ' || replace(b.t, chr(10), chr(10) || '> > ') || chr(10) else '' end
    || case when a.t is not null then '> ' || replace(a.t, chr(10), chr(10) || '> ') || chr(10) || 'On that day somebody wrote:' || chr(10) else '' end
    || case when m.turn = 2 then '> {HOT}' || chr(10) else '' end
    || case when m.turn = 0 then '{HOT}' || chr(10) || chr(10) else '' end || m.text end as text
  from conversations m left join once z on z.conv_id = m.conv_id and z.turn = m.turn
    left join once a on a.conv_id = m.conv_id and a.turn = m.turn - 1 left join once b on b.conv_id = m.conv_id and b.turn = m.turn - 2),
l as (""",
)


def quote_links(messages: DataFrame) -> DataFrame:
    """The rows of conversations() with the text's hash in place of the text."""
    return conversations(messages.select("conv_id", "turn", "role", "text")).select(
        "conv_id", "turn", "role", "n_quotes", F.md5("own").alias("own_md5"), "parent_conv", "parent_turn", "thread_id", "depth"
    )
