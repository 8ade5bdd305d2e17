"""Each stage of the pipeline against a plain version on its own input."""

from __future__ import annotations

import collections
import hashlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as p
from arbora.llm import crf, mix, pii
from arbora.llm.common import written

from ..conftest import DATA
from . import brute


def test_stages(spark):
    before = spark.read.parquet(f"{DATA}/documents.parquet").select(*p.COLUMNS)
    stages = dict(p.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "personal_data", "mixture", "tokens"]
    rows = lambda df: {r["doc_id"]: r.asDict() for r in df.collect()}

    model = crf.train(before, spark.read.parquet(f"{DATA}/labels.parquet"))
    one = written(stages["quality"](spark, before, DATA), "t")
    want = set()
    for d, r in rows(before).items():
        body = r["text"].encode()
        if crf.scores(model, np.frombuffer(body, np.uint8), np.array([0, len(body)]))[0][0] >= crf.THRESHOLD:
            want.add(d)
    assert set(rows(one)) == want and one.columns == p.COLUMNS

    two = written(stages["near_duplicates"](spark, one, DATA), "t")
    comps = brute.components([(d, r["text"]) for d, r in rows(one).items()], 80, 5)
    assert rows(two) == {d: r for d, r in rows(one).items() if comps[d][1] == d}

    three = written(stages["personal_data"](spark, two, DATA), "t")
    trees = pii.train()
    olds = rows(two)
    for d, r in rows(three).items():
        assert r["text"] == pii.redact(olds[d]["text"], pii.find(olds[d]["text"], trees)) and r["n_chars"] == len(r["text"])
    assert set(rows(three)) == set(rows(two))
    assert not any(brute.personal(r["text"]) for r in rows(three).values())

    four = written(stages["mixture"](spark, three, DATA), "t")
    words = mix.word_count(F.col("text"))
    copies = {r["doc_id"]: r["copies"] for r in mix.mix(three, words, chance=mix.longer_first(words)).collect()}
    assert collections.Counter(r["doc_id"] for r in four.collect()) == collections.Counter({d: n for d, n in copies.items() if n})
    assert four.columns == p.COLUMNS

    ranks, enc = brute.tokenizer()
    texts = rows(four)
    five = stages["tokens"](spark, four, DATA).collect()
    assert len(five) == four.count()
    for r in five:
        ids = enc.encode_ordinary(texts[r["doc_id"]]["text"])
        assert bytes(r["ids"]) == np.array(ids, "<u4").tobytes() and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]]["text"].encode()).hexdigest()


EDGES = [
    (1, "plain words of some length stand here for all to read", "en", "a", 10), (1, "other words under the same id, not like the first ones", "en", "a", 10),
    (2, None, "en", "a", None), (3, "", None, None, 0), (None, "a row without any id but with words of its own", None, None, 5),
    (4, "mail me at a.b@example.org or call +1 (212) 555-0199 today", "en", "b", 9), (4, "mail me at a.b@example.org or call +1 (212) 555-0199 today", "en", "b", 9),
    (5, "word " * 50_000, "en", "b", 250_000), (6, "é 日本 " * 30, "ja", "b", 9),
]


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, shared ids and repeated rows: what each stage keeps; and empty tables."""
    docs = spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string, n_chars long")
    empty, stages = docs.limit(0), dict(p.STAGES)
    for name in stages:
        got = stages[name](spark, empty, DATA)
        assert got.count() == 0 and (name == "tokens" or got.columns == p.COLUMNS)
    some = stages["quality"](spark, docs, DATA).collect()
    assert not any(r["doc_id"] in (2, 3) for r in some)
    near = stages["near_duplicates"](spark, docs, DATA).collect()
    assert collections.Counter(r["doc_id"] for r in near) == {1: 2, 2: 1, 3: 1, None: 1, 4: 1, 5: 1, 6: 1}
    clean = stages["personal_data"](spark, docs, DATA).collect()
    assert len(clean) == len(EDGES) and {r["text"] for r in clean if r["doc_id"] == 4} == {"mail me at [EMAIL] or call [PHONE] today"} and all(r["text"] is not None for r in clean)
    mixed = stages["mixture"](spark, docs, DATA).collect()
    assert collections.Counter(r["doc_id"] for r in mixed)[4] % 2 == 0 and {r["doc_id"] for r in mixed} <= {r[0] for r in EDGES}
    ids = {(r["doc_id"], r["n_tokens"]) for r in stages["tokens"](spark, docs, DATA).collect()}
    assert {(2, 0), (3, 0)} <= ids and len(ids) == 8


def test_run(spark):
    assert p.run(spark, DATA).count() > 0
