"""Nulls, empty and very long texts, ties, repeated rows, empty tables, and columns whose names clash."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from arbora.llm import avi, bpe, crf, knn, mix, pii, quotes, radix, rtree, shard

from . import brute

NAMES = ["n", "key", "d", "b", "w", "id", "spans", "size", "score", "ids", "media", "depth", "shard", "target", "component", "z", "__text", "copies", "n_bytes"]
TEXTS = [(0, "good words here and there for all of us to read\nwith a second line."), (1, None), (2, ""), (3, "   \n\t "), (4, "x y " * 30000), (5, "tie tie"), (6, "tie tie"), (7, "é" * 300), (7, "é" * 300), (None, "no id at all but text")]


def docs(spark, rows):
    df = spark.createDataFrame([(i, t, None if i == 5 else "en", None if i in (2, 6) else f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(7).alias(n) for n in NAMES])


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def operators(spark):
    ranks, _ = brute.tokenizer()
    trees = pii.train()
    few = labels(spark, [(0, 1, 0), (4, 0, 0), (5, None, 0), (6, 0, None), (None, 1, 0), (0, 1, 0)])
    return {
        "mix": mix.mix_documents, "radix": radix.repeat_digests, "bpe": lambda d: bpe.bpe_digests(d, ranks), "pii": lambda d: pii.find_spans(d, trees), "redact": lambda d: pii.redact_documents(d, trees),
        "crf": lambda d: crf.quality_scores(d, few), "no labels": lambda d: crf.quality_scores(d, few.limit(0)), "avi": avi.media_digests, "store": avi.store, "rtree": rtree.near_duplicates, "shard": shard.shard_documents,
        "mixed": lambda d: mix.mix(d, F.col("n_chars")), "sharded": lambda d: shard.shard(d, 1000),
    }


@pytest.mark.parametrize("name", ["mix", "radix", "bpe", "pii", "redact", "crf", "no labels", "avi", "store", "rtree", "shard", "mixed", "sharded"])
def test_documents(spark, name):
    op = operators(spark)[name]
    got = op(docs(spark, TEXTS)).collect()
    assert len(got) == len(TEXTS) and sorted(r["doc_id"] is None for r in got)[-1]
    assert op(docs(spark, [])).count() == 0
    twice = [r.asDict() for r in got if r["doc_id"] == 7]
    place = ("page", "depth", "shard", "shard_bytes") if name == "sharded" else ()  # equal rows that don't fit together
    assert len(twice) == 2 and {k: v for k, v in twice[0].items() if k not in place} == {k: v for k, v in twice[1].items() if k not in place}


def test_results(spark):
    ops = operators(spark)
    d = docs(spark, TEXTS)
    by = lambda name: {r["doc_id"]: r for r in ops[name](d).collect()}
    near = by("rtree")
    assert near[6]["component_id"] == 5 and near[1]["n_shingles"] == near[3]["n_shingles"] == 0 and near[3]["component_id"] == 3
    assert by("bpe")[1]["n_tokens"] == 0 and by("avi")[2]["payload_bytes"] == 576
    scores = by("crf")
    assert scores[1]["score"] == scores[3]["score"] == 0 and scores[0]["score"] > 0
    # "x y " repeats every four bytes: all but the first four windows of its 119901 are repeated.
    assert by("radix")[4]["n_removed"] == 120000 - 4
    assert by("mix")[1]["size"] == 0


def test_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int, q int, n int, g int"
    assert knn.knn_join(spark.createDataFrame([], schema)).count() == 0
    rows = [(i, [1.0, 2.0], None, 1, 1, 1) for i in (0, 0, 3, 4)] + [(None, [1.0, 2.0], 1, 1, 1, 1)]
    got = [(r["query_id"], r["vec_id"]) for r in knn.knn_join(spark.createDataFrame(rows, schema)).collect()]
    assert set(got) == {(0, 3), (0, 4)}


def test_messages(spark):
    schema = "conv_id long, turn long, role string, text string, level int, h string, own string"
    assert quotes.quote_links(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, 0, None, "> > deep only", 1, "h", "o"), (1, 0, None, "> > deep only", 1, "h", "o"), (None, 1, "u", "> x", 1, "h", "o"), (2, None, "u", "word " * 20000, 1, "h", "o"), (3, 1, "u", None, 1, "h", "o")]
    got = quotes.quote_links(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and all(r["parent_conv"] is None for r in got)
