"""Mixing sources to target weights by Pareto order sampling.

A source gets target / size whole copies of all its documents (rounded down); what is left of its target is drawn by Pareto
order sampling.  Documents have relative chances (whole numbers from 0 to CHANCES); their inclusion probabilities p are
proportional to them, such that the words expected are the source's rest.  Those that would be over 1 are certain: they are
taken out and the others' p raised until none is over.  With u uniform, documents are ranked by the random odds u / (1 - u)
divided by the inclusion odds p / (1 - p), and the best are taken until the rest is filled.  The size that is fixed is the one
targets are given in (words), so the last document taken is the one whose middle still lies within the rest.

Per-source sums by chance, a histogram of the ranking (refined where its last bin holds more than EDGE_ROWS rows) and one bin's
rows find each source's last rank; then every row decides for itself.  No source is ever sorted or collected as a whole, and
texts are not shuffled.

Cases: an empty table gives no rows; null sizes and chances count 0; documents of size 0 get the whole copies and, if ranked
within the rest, one more; documents of chance 0 the whole copies only; a null source is a source like others, last in order;
rows that share a doc_id (and chance) rank alike and are taken together; other columns pass through, but columns named like the
ones added are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranges import running
from .common import WORD, discard, written

#: Bins of a histogram, rows of its last bin that are ordered as a whole, and the largest chance.
BINS, EDGE_ROWS, CHANCES = 4096, 100_000, 255
#: Sources up to this many are broadcast; more are joined.
BROADCAST_SOURCES = 10_000
ADDED = ("size", "source_size", "target", "taken", "copies")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(id_column: Column, seed: str = "mix") -> Column:
    """A number strictly between 0 and 1 out of the document's id: 52 bits of MD5."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_column.cast("string"), F.lit("null")))), 1, 13), 16, 10)
    return (h.cast("long").cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def cyclic_weights(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds `weight`: the given weights, repeating, over the sources by code point, null last."""
    numbered = running(sources, [], [F.col("source").isNull(), F.col("source")], name="__n")
    place = F.pmod(F.col("__n") - 1, F.lit(len(weights))).cast("int") + 1
    return numbered.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), place).cast("long")).drop("__n")


def allocate(sources: DataFrame, max_copies: int = 3) -> DataFrame:
    """source, source_size, weight -> and target: shares of the sum of all sizes by weight, at most max_copies times a
    source's size; what that cuts off is shared by weight among the rest until no target is above.

    Sources are sorted and summed by ranges, so that there may be as many as there are web domains."""
    capped = sources.withColumn("cap", F.col("source_size") * max_copies)
    # Caps are reached in order of cap / weight.
    order = [F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source")]
    passed = running(capped, [], order, {"__cap": "cap", "__weight": "weight"}, "__n")
    whole = passed.agg(F.sum("source_size").alias("__total"), F.sum("weight").alias("__weights"))  # one row
    level = passed.join(F.broadcast(whole)).withColumn("level", (F.col("__total") - F.col("__cap")) / (F.col("__weights") - F.col("__weight")))
    # The first source in this order that stays under its cap has the level of all that do (after it levels fall, in ties too); one row.
    under = F.struct(F.col("__n").alias("at"), F.col("level").alias("level"))
    first = level.agg(F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), under))["level"].alias("__level"))
    told = F.coalesce("__level", F.lit(float("inf"))) * F.col("weight")
    return passed.join(F.broadcast(first)).select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), told).alias("target"))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast what is known to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_SOURCES else df


def _rates(sums: DataFrame) -> DataFrame:
    """From source, rest, chance and the chance's size: source and rate, which times a chance is an inclusion probability.

    A source has CHANCES rows at most."""
    higher = Window.partitionBy("source").orderBy(F.col("chance").desc())
    certain = F.coalesce(F.sum("n").over(higher.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    others = F.sum(F.col("n") * F.col("chance")).over(higher.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rate = F.when(others > 0, (F.col("rest") - certain) / others)
    # The highest chance that isn't certain once all above it are.
    told = sums.withColumn("rate", rate).withColumn("free", F.col("rate").isNotNull() & (F.col("rate") * F.col("chance") < 1))
    return told.groupBy("source").agg(F.max(F.when(F.col("free"), F.struct("chance", "rate"))).alias("m"), F.min("chance").alias("least")).select("source", F.coalesce(F.col("m.rate"), 1 / F.col("least")).alias("rate"))


def mix(docs: DataFrame, size: Column, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3, chance: Column | None = None, seed: str = "mix", doc_id: str = "doc_id", source: str = "source", edge_rows: int = EDGE_ROWS) -> DataFrame:
    """The rows of docs with size, source_size, target (their source's), copies (int) and taken (size * copies).

    chance: relative inclusion chances of documents within a source, whole numbers from 0 to CHANCES (default: equal)."""
    clipped = F.lit(1) if chance is None else F.greatest(F.lit(0), F.least(F.lit(CHANCES), F.coalesce(chance, F.lit(0)))).cast("int")
    rows = docs.withColumns({"size": F.coalesce(size, F.lit(0)).cast("long")}).withColumn("__chance", clipped)
    lean = written(rows.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), "size", F.col("__chance").alias("chance")), "mix")
    by_chance = written(lean.groupBy("source", "chance").agg(F.sum("size").alias("n")), "mix-sums")
    sums = by_chance.groupBy("source").agg(F.sum("n").alias("source_size"))
    targets = allocate(cyclic_weights(sums, weights), max_copies)
    plan = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = written(plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).select("source", "source_size", "target", "whole", "rest"), "mix-plan")
    rests = plan.select(F.col("source").alias("__s"), "rest")
    rates = _rates(by_chance.filter("chance > 0").join(rests, F.col("source").eqNullSafe(F.col("__s"))).drop("__s"))
    rated = written(plan.join(rates.select(F.col("source").alias("__s"), "rate"), F.col("source").eqNullSafe(F.col("__s")), "left").select("source", "source_size", "target", "whole", "rest", F.coalesce("rate", F.lit(0.0)).alias("rate")), "mix-rates")

    def ranked(df: DataFrame, u: Column, p: Column) -> DataFrame:
        odds = (u / (1 - u)) / (p / (1 - p))
        return df.withColumn("__odds", F.when(p >= 1, 0.0).when(p <= 0, None).otherwise(odds))

    share = F.col("__odds") / (1 + F.col("__odds"))
    flat = _small(rated.select(F.col("source").alias("__s"), *[F.col(c).alias("__" + c) for c in ("rest", "rate")]))
    drawn = ranked(lean.join(flat, F.col("source").eqNullSafe(F.col("__s"))), uniform(F.col("doc_id"), seed), F.col("__rate") * F.col("chance")).filter("__odds is not null and __rest > 0")
    drawn = drawn.select("source", "doc_id", "size", "__odds", "__rest")
    made, within, level = [], drawn.withColumn("__before", F.lit(0).cast("long")), 0
    while True:
        # The first bin that reaches the rest holds the last rank; the bins before it are taken whole.
        level += 1
        by_bin = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = within.groupBy("source", F.floor(share * float(BINS**level)).alias("bin")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.first("__rest").alias("rest"), F.first("__before").alias("b"))
        bins = bins.withColumn("before", F.col("b") + F.coalesce(F.sum("n").over(by_bin), F.lit(0)))
        last = bins.filter(F.col("before") < F.col("rest")).groupBy("source").agg(F.max(F.struct("bin", "before", "rows")).alias("m"))
        last = written(last.select(F.col("source").alias("__s2"), F.col("m.bin").alias("__bin"), F.col("m.before").alias("__before"), F.col("m.rows").alias("__rows")), "mix-bins")
        made.append(last)
        edge = drawn.join(_small(last), F.col("source").eqNullSafe(F.col("__s2")) & (F.floor(share * float(BINS**level)) == F.col("__bin")))
        if level == 4 or last.filter(F.col("__rows") > edge_rows).isEmpty():
            break
        within = edge.select("source", "doc_id", "size", "__odds", "__rest", "__before")
    # Documents that rank alike are taken together.
    edge = edge.groupBy("source", "__odds", "doc_id", "__before", "__rest").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("source").orderBy("__odds", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("middle", F.col("__before") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2)
    cut = edge.filter(F.col("middle") <= F.col("__rest")).groupBy("source").agg(F.max(F.struct(F.col("__odds").alias("o"), F.col("doc_id").alias("d"))).alias("__cut"))
    # Where the bin of the last rank has no row within the rest, the cut is that bin's lower edge.
    cuts = last.join(cut.withColumnRenamed("source", "__s3"), F.col("__s2").eqNullSafe(F.col("__s3")), "left").select("__s2", "__bin", "__cut")
    full = rated.join(cuts, F.col("source").eqNullSafe(F.col("__s2")), "left").select(
        F.col("source").alias("__s"), F.col("source_size").alias("__size"), F.col("target").alias("__target"), *[F.col(c).alias("__" + c) for c in ("whole", "rest", "rate")], "__bin", "__cut"
    )
    cuts = written(full, "mix-cuts")
    discard(lean, by_chance, plan, rated, *made)
    out = ranked(rows.join(_small(cuts), F.col(source).eqNullSafe(F.col("__s"))), uniform(F.col(doc_id), seed), F.col("__rate") * F.col("__chance"))
    place = F.floor(share * float(BINS**level))
    taken = (place < F.col("__bin")) | ((place == F.col("__bin")) & ((F.col("__odds") < F.col("__cut.o")) | ((F.col("__odds") == F.col("__cut.o")) & (F.col(doc_id) <= F.col("__cut.d")))))
    extra = F.when((F.col("__rest") > 0) & F.col("__odds").isNotNull() & F.col("__bin").isNotNull() & F.coalesce(taken, F.lit(False)), 1).otherwise(0)
    out = out.withColumns({"copies": (F.col("__whole") + extra).cast("int"), "source_size": F.col("__size"), "target": F.col("__target")})
    out = out.withColumn("taken", F.col("size") * F.col("copies"))
    return out.drop("__s", "__size", "__target", "__whole", "__rest", "__rate", "__bin", "__cut", "__chance", "__odds")


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """A mix's rows, each as often as it is taken."""
    return mixed.filter("copies > 0").withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*columns)


def longer_first(size: Column) -> Column:
    """A chance that grows with a document's size: the number of its binary digits."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(1)


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (and copies, chance) of all documents."""
    sizes = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("n")), "sizes")
    chance = longer_first(F.col("n"))
    return mix(sizes, F.col("n"), chance=chance).select("doc_id", "size", "source_size", "target", "taken", "copies", chance.cast("int").alias("chance"))


MIX_SQL = """
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u
  from documents),
s as (
  select source, sum(size)::bigint as source_size from d group by source),
w as (
  select *, 1 + (row_number() over (order by source nulls last) - 1) % 3 as weight, 3 * source_size as cap, sum(source_size) over () as total from s),
l as (
  select *, (total - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
         / (sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following))::double as level from w),
f as (
  select min(level) filter (where cap >= level * weight and cap / weight = m) as level
  from l, (select min(cap / weight) as m from l where cap >= level * weight)),
t as (
  select source, source_size, least(cap::double, coalesce((select level from f), 'inf'::double) * weight) as target from l),
p as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as whole from t),
r as (
  select *, target - whole * source_size as rest from p),
g as (
  select d.source, case when size > 0 then length(bin(size)) else 1 end as chance, sum(size) as n, any_value(r.rest) as rest
  from d join r on d.source is not distinct from r.source group by 1, 2),
h as (
  select *, (rest - coalesce(sum(n) over (partition by source order by chance desc rows between unbounded preceding and 1 preceding), 0))
         / nullif(sum(n * chance) over (partition by source order by chance desc rows between current row and unbounded following), 0) as rate from g),
k as (
  select source, coalesce(arg_max(rate, chance) filter (where rate * chance < 1), 1.0 / min(chance)) as rate from h group by source),
q as (
  select d.doc_id, d.size, r.*, u, k.rate * case when d.size > 0 then length(bin(d.size)) else 1 end as p,
         case when d.size > 0 then length(bin(d.size)) else 1 end as chance
  from d join r on d.source is not distinct from r.source join k on d.source is not distinct from k.source),
o as (
  select *, case when p >= 1 then 0 when p > 0 then (u / (1 - u)) / (p / (1 - p)) end as odds from q where true),
c as (
  select *, coalesce(sum(size) over (partition by source order by odds, doc_id rows between unbounded preceding and 1 preceding), 0) + size / 2 as middle from o where odds is not null and rest > 0)
select o.doc_id, o.size, o.source_size, o.target,
       (o.size * (o.whole + case when c.middle <= o.rest then 1 else 0 end))::bigint as taken,
       (o.whole + case when c.middle <= o.rest then 1 else 0 end)::int as copies, o.chance::int as chance
from o left join c on o.doc_id = c.doc_id
"""
