"""A training corpus out of documents: drop bad ones, keep one of each group of near duplicates, take out personal data, mix
the sources to their weights, and encode what is left.

Cases, for every stage: nulls may stand in any column (a null text is empty; a null source is a source of its own; rows without
an id are rows like others); rows that share an id are judged each by its own text; repeated rows have repeated fates, but for
near_duplicates, which keeps one of them; an empty table gives an empty table; other columns than those of documents are dropped
before the first stage.  A table that a stage has read is deleted when the next one is written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import bpe, crf, mix, pii, rtree
from arbora.llm.common import bounded_batches, discard, table, written
from arbora.llm.queries import tokenizer_file, tokenizer_pattern
from arbora.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model, fitted on the labelled ones among them, doesn't reject.  Texts without lines are rejected
    (score 0); without labels nothing else is."""
    model = crf.train(docs, table(spark, sf_dir, "labels"))
    return crf.score(docs, model, "__score").filter(F.col("__score") >= crf.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that links connect (five words, similarity 0.8 or more) the row with the smallest id; a row without
    an id only where no row has one, and of rows that share id and text the least by the other columns.  Other rows that share
    an id, and texts without words, stay."""
    found = rtree.groups(docs, size=5, percent=80)
    first = found.filter("component is not null").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("r"))
    kept = first.select("r.id", "r.hash", F.lit(True).alias("__one")).unionByName(found.filter("component is null").select("id", "hash", F.lit(False).alias("__one")).distinct())
    rows = docs.withColumn("__hash", rtree.text_hash("text"))
    rows = rows.join(kept, (rows["__hash"] == kept["hash"]) & rows["doc_id"].eqNullSafe(kept["id"])).select(*docs.columns, "__hash", "__one")
    if found.filter("component is not null").groupBy("id", "hash").count().filter("count > 1").isEmpty():
        return rows.select(*docs.columns)
    one = rows.filter("__one").groupBy("doc_id", "__hash").agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
    return one.unionByName(rows.filter("not __one").select(*docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; a null text becomes empty."""
    return pii.redact_documents(docs).drop("spans").withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; longer ones are likelier to be drawn, as in op1.  Documents without words are
    taken as often as their whole source is."""
    sized = docs.withColumn("__words", mix.word_count(F.col("text")))
    return mix.repeated(mix.mix(sized, F.col("__words"), chance=mix.longer_first(F.col("__words"))), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids (little-endian unsigned 32-bit integers), n_tokens, and the hash of what the ids decode to."""
    ranks = bpe.read_ranks(tokenizer_file("byte_bpe_50k.tiktoken"))
    told = bpe.decode(bpe.encode(docs, ranks, tokenizer_pattern(), keep=("doc_id", "source")), ranks, hashed=True)
    return told.select("doc_id", "source", "ids", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.col("decoded").alias("decoded_sha256"))


def _shipped(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, after the package is where Python workers find it."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [(f.__name__, _shipped(f)) for f in (quality, near_duplicates, personal_data, mixture, tokens)]

#: The stages are models and iterations; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        read, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(read)
    return STAGES[-1][1](spark, docs, sf_dir)
