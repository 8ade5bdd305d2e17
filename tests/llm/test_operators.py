"""Operators against SQL, brute force, exact round trips and held-out labels."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.llm import avi, bpe, crf, knn, mix, pii, queries, quotes, radix, rtree, shard

from ..conftest import DATA
from ..support import rows_of, same
from . import brute


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE[name], DATA)


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_bpe(spark):
    ranks, enc = brute.tokenizer()
    got = {r["doc_id"]: r for r in queries.QUERIES["op4_byte_bpe"](spark, DATA).collect()}
    for r in documents(spark).collect():
        ids = enc.encode_ordinary(r["text"])
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())


def test_merge_replay_on_odd_words():
    ranks, enc = brute.tokenizer()
    replay = bpe.MergeReplay(ranks)
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abá'0 \n日x") for _ in range(rnd.randint(1, 40))) for _ in range(800)] + ["a" * 999, " " * 500, "ab" * 300, ""]
    tokens, counts = replay.encode([w.encode() for w in words])
    at = 0
    for w, n in zip(words, counts):
        assert tokens[at : at + n].tolist() == enc._core_bpe.encode_single_piece(w.encode()) if w else n == 0
        at += n


def test_radix_with_shared_hashes(spark):
    """Buckets by eight bits: what shares one is told apart by its bytes."""
    rnd = random.Random(2)
    word = lambda n: "".join(chr(rnd.randint(97, 122)) for _ in range(n))
    base, line = word(1500), word(160)
    rows = [(i, word(200) + base[rnd.randint(0, 900) :][: rnd.randint(90, 300)] + word(80)) for i in range(40)] + [(100 + i, word(70) + line + word(70)) for i in range(90)] + [(300, base), (301, base)]
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), brute.repeats(rows)
    for bucket in (radix.BUCKET, 2):
        got = radix.remove_repeats(docs, bucket=bucket, bits=8).select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long"), F.size("removed").cast("long"), F.sha2("kept", 256))
        assert {r[0]: tuple(r[1:]) for r in got.collect()} == want


def test_radix(spark):
    rnd = random.Random(1)
    base = "".join(chr(rnd.randint(97, 122)) for _ in range(1500))
    rows = [(i, " ".join(rnd.choice(["foo", "bar", "née", "x"]) for _ in range(rnd.randint(0, 150)))) for i in range(25)]
    rows += [(100, base), (101, base), (102, base[500:599]), (103, base[500:600]), (104, base[:700] + "XX" + base[700:]), (105, "a" * 700), (106, "a" * 150), (107, None), (108, ""), (109, base[10:300] + base[50:500])]
    letters = lambda: "".join(chr(rnd.randint(97, 99)) for _ in range(60))
    rows += [(200 + i, letters() + base[700 : 820 + i % 7] + letters()) for i in range(60)]
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), brute.repeats(rows)
    assert {r[0]: tuple(r[1:]) for r in radix.repeat_digests(docs).collect()} == want
    # Buckets that are too large go on by further digits.
    for bucket in (8, 2):
        got = radix.remove_repeats(docs, bucket=bucket).selectExpr("doc_id", "n_bytes", "n_bytes - octet_length(kept)", "size(removed)", "sha2(kept, 256)").collect()
        assert {r[0]: tuple(r[1:]) for r in got} == want


def test_radix_of_shared_ids(spark):
    """Rows of one id with different texts are documents of their own; equal rows are one place."""
    rnd = random.Random(2)
    x, y = ("".join(chr(rnd.randint(97, 122)) for _ in range(300)) for _ in range(2))
    rows = [(1, x), (2, x), (2, y), (3, y), (3, y), (None, "q" * 99), (None, x), (None, x)]
    for bits in (64, 3):
        got = sorted((r["doc_id"] or -1, 300 - len(r["kept"])) for r in radix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), bits=bits).collect() if r["n_bytes"] == 300)
        assert got == [(-1, 0), (-1, 0), (1, 300), (2, 0), (2, 300), (3, 300), (3, 300)]


def test_radix_of_distant_ids(spark):
    rows = [(-5, "q" * 120), (2**61, "q" * 130), (None, "q" * 100)]
    got = {r["doc_id"]: r["n_removed"] for r in radix.repeat_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {None: 0, -5: 120, 2**61: 130}


def noisy(rnd, words, k):
    out = list(words)
    for _ in range(k):
        out[rnd.randrange(len(out))] = f"w{rnd.randrange(10**6)}"
    return out


def test_near_duplicates(spark):
    rnd, rows, n = random.Random(3), [], 0
    for _ in range(14):
        size = rnd.choice([3, 5, 8, 9, 10, 12, 20, 40, 100, 300])
        base = [f"v{rnd.randrange(300)}" for _ in range(size)]
        for j in range(rnd.randint(1, 20)):
            rows.append((n, " ".join(noisy(rnd, base, rnd.randint(0, max(1, size // (30 if j % 2 else 15)))))))
            n += 1
    base = [f"z{i}" for i in range(300)]
    rows += [(n + 100 + j, " ".join(noisy(rnd, base, rnd.randint(0, 11)))) for j in range(150)]
    rows += [(n + 1, None), (n + 2, ""), (n + 3, "A b"), (n + 4, "a B"), (n + 5, "a b c d"), (n + 6, "A B C D"), (n + 7, "   ")]
    got = {r[0]: (r[1], r[2]) for r in rtree.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute.components(rows)


def test_tree_bound():
    """A search loses no point whose overlap can be enough, and packed points bound overlaps from above."""
    rnd = np.random.Generator(np.random.PCG64(2))
    layout = rtree.Layout()
    points = rnd.poisson(3, (300, 128))
    points[50:80] = points[0] + rnd.integers(0, 2, (30, 128))
    sizes = points.sum(1)
    tree = rtree.RTree(points, sizes)
    for i in range(0, 300, 17):
        want = {j for j in range(300) if np.minimum(points[i], points[j]).sum() >= layout.needed(sizes[i] + sizes[j])}
        assert set(tree.search(points[i], int(sizes[i]), layout).tolist()) == want
    sets = [np.unique(rnd.integers(0, 2**64, n, np.uint64)) for n in (1, 30, 500, 900, 70_000, 70_100)]
    sets += [np.unique(np.append(s[: len(s) * 2 // 3], rnd.integers(0, 2**64, len(s) // 3 + 1, np.uint64))) for s in sets]
    packed = [rtree.pack_point(a) for a in sets]
    coarse = rtree.unpack_points(packed, 8)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            common, bound = len(np.intersect1d(a, b)), rtree.common_count(rtree.spelled(packed[i]), rtree.spelled(packed[j]))
            assert np.minimum(coarse[i], coarse[j]).sum() >= bound >= common


def test_personal_data(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_boosted_pii"](spark, DATA).collect()}
    for r in documents(spark).collect():
        spans = sorted(brute.personal(r["text"]))
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        g = got[r["doc_id"]]
        assert g["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [g[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[0] == i for s in spans) for i in range(4)]
        assert set(filter(None, listed.split(","))) <= set(g["spans"].split(","))


def test_base_spans_on_noise():
    rnd = random.Random(5)
    for _ in range(4000):
        text = "".join(rnd.choice("ab.@12 -+()%é9") for _ in range(rnd.randint(0, 90)))
        assert pii.base_spans(text) == brute.personal(text)


def test_planted_personal_data(spark):
    """Recall and precision on what the documents have planted in fixed forms."""
    planted = re.compile(r'token = "([0-9a-f]{40})"|(\+1 \([0-9]{3}\) 555-[0-9]{4})|(?<![0-9])([0-9]{16})(?![0-9])|([a-z0-9.]+@[a-z0-9.]+[a-z])|(?<![0-9.])([0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9.])')
    trees, want, hit, told, right = pii.train(), 0, 0, 0, 0
    for r in documents(spark).collect():
        places = [m.span(m.lastindex) for m in planted.finditer(r["text"])]
        spans = pii.find(r["text"], trees)
        within = lambda x, y: min(x[1], y[1]) - max(x[0], y[0]) >= 0.9 * max(x[1] - x[0], y[1] - y[0])
        want, told = want + len(places), told + len(spans)
        hit += sum(any(within(p, s[1:3]) for s in spans) for p in places)
        right += sum(any(within(p, s[1:3]) for p in places) for s in spans)
    assert want > 20 and hit >= 0.9 * want and right >= 0.9 * told


def test_many_spans_in_one_text():
    trees = pii.train()
    took = []
    for n in (2000, 8000):
        text, began = " ".join(f"tel 0{k % 90 + 10} {k % 900 + 100} {k % 9000 + 1000}" for k in range(n)) + " " + "1 2" * n + "x", time.perf_counter()
        assert len(pii.find(text, trees)) >= n * 0.9
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 1


def test_line_labels():
    """Good lines inside bad documents are learnt as good, though they carry the label of their document."""
    rnd = random.Random(8)
    good = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(6, 14))) + "."
    bad = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) + rnd.choice(["$$$", "%%%", "###"]) for _ in range(rnd.randint(6, 14)))
    texts, labels, kinds = [], [], []
    for k in range(300):
        lines = [good() for _ in range(8)] if k % 2 else [good() if i < 4 else bad() for i in range(10)]
        texts.append("\n".join(lines))
        labels.append(k % 2)
        kinds.append([1] * 8 if k % 2 else [1] * 4 + [0] * 6)
    model = crf.fit(texts[:200], labels[:200])
    raw = [t.encode() for t in texts[200:]]
    score, doc, marginal = crf.scores(model, np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))
    truth = np.array([x for k in kinds[200:] for x in k])
    assert ((marginal > 0.5) == truth).mean() > 0.95 and ((score > 0.5) == np.array(labels[200:])).mean() > 0.98


def test_trees_and_redaction():
    trees = pii.train()
    x, y = pii.made_up(1500, 77)
    told = trees.score(x) >= trees.threshold
    assert y[told].mean() > 0.98 and told[y == 1].mean() > 0.95
    text = 'mail bob@x.org or call +1 (974) 555-3436, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" now 12 times'
    spans = pii.find(text, trees)
    assert pii.redact(text, spans) == 'mail [EMAIL] or call [PHONE], token = "[SECRET]" now 12 times'
    assert pii.find("Plain words of 12 lines in 2024, none of them personal.", trees) == []
    assert pii.find("a" * 200_000 + "@" + "1" * 200_000, trees) is not None


def test_quality(spark):
    big = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_line_crf"](spark, big).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{big}/labels.parquet").collect()]
    out = [(got[d], q) for d, q in labels if got[d]["held_out"]]
    assert all(g["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, g in got.items())
    assert sum(g["predicted"] == q for g, q in out) / len(out) > 0.95
    assert all(0 <= g["score"] <= 1 for g in got.values())


def test_marginals_sum_over_all_labellings():
    rnd = np.random.Generator(np.random.PCG64(1))
    edge, turn = rnd.normal(size=5), rnd.normal(size=(2, 2))
    total, good = 0.0, np.zeros(5)
    for k in range(32):
        y = [k >> i & 1 for i in range(5)]
        w = np.exp(sum(edge[i] * y[i] for i in range(5)) + sum(turn[y[i], y[i + 1]] for i in range(4)))
        total += w
        good += w * np.array(y)
    assert np.allclose(crf._marginals(np.zeros(5, int), edge, turn)[0], good / total)


def test_video_round_trip(spark):
    for body in (b"", b"a" * 576, b"b" * 577, "né".encode() * 700, bytes(range(256)) * 9):
        frames = avi.read_avi(avi.write_avi(body))[0].tobytes()
        assert frames[: len(body)] == body and set(frames[len(body) :]) <= {255} and len(frames) % 576 == 0 and frames
    with pytest.raises(ValueError):
        avi.read_avi(b"RIFFxxxxAVI ")
    got = {r["doc_id"]: r for r in queries.QUERIES["op8_motion_jpeg"](spark, DATA).collect()}
    for r in documents(spark).collect():
        body = r["text"].encode()
        body += b"\xff" * (-len(body) % 576)
        assert (got[r["doc_id"]]["payload_sha256"], got[r["doc_id"]]["tail_crc32"]) == (hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:]))


def slow_pixels(coefficients, steps):
    """Eight by eight pixels of one block's coefficients by rows and columns, by the formula."""
    out = np.zeros((8, 8))
    for x in range(8):
        for y in range(8):
            total = 0.0
            for u in range(8):
                for v in range(8):
                    scale = (np.sqrt(0.5) if u == 0 else 1) * (np.sqrt(0.5) if v == 0 else 1)
                    total += scale * coefficients[u, v] * steps[u, v] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
            out[x, y] = total / 4
    return np.clip(np.rint(out) + 128, 0, 255)


def zigzag():
    out, up, u, v = [], True, 0, 0
    while len(out) < 64:
        out.append((u, v))
        if up and (v == 7 or u == 0):
            u, v, up = (u + 1, v, False) if v == 7 else (u, v + 1, False)
        elif not up and (u == 7 or v == 0):
            u, v, up = (u, v + 1, True) if u == 7 else (u + 1, v, True)
        else:
            u, v = (u - 1, v + 1) if up else (u + 1, v - 1)
    return out


def colour_jpeg(blocks, steps):
    """A 13 x 20 frame of three components, the first sampled twice both ways: units of six blocks, with predictions, runs and
    ends of blocks, by codes of eight bits.  blocks: units x 6 x 8 x 8."""
    order, bits, before = zigzag(), [], [0, 0, 0]

    def put(value, n):
        bits.extend(value >> k & 1 for k in range(n - 1, -1, -1))

    def number(value, size):
        put(value if value > 0 else value + (1 << size) - 1, size)

    for unit in blocks:
        for i, block in enumerate(unit):
            c = max(0, i - 3)
            flat = [int(block[p]) for p in order]
            apart, before[c] = flat[0] - before[c], flat[0]
            size = abs(apart).bit_length()
            put(size, 8)
            number(apart, size)
            run = 0
            last = max([k for k in range(1, 64) if flat[k]], default=0)
            for k in range(1, last + 1):
                if not flat[k]:
                    run += 1
                    continue
                while run > 15:
                    put(0xF0, 8)
                    run -= 16
                size = abs(flat[k]).bit_length()
                put(run << 4 | size, 8)
                number(flat[k], size)
                run = 0
            if last < 63:
                put(0, 8)
    bits += [1] * (-len(bits) % 8)
    data = np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")
    table = bytes(7) + bytes([255]) + bytes(8) + bytes(range(255))
    head = b"\xff\xd8\xff\xe0\x00\x04JF\xff\xdb\x00\x43\x00" + bytes(int(steps[p]) for p in order)
    head += b"\xff\xc0\x00\x11\x08\x00\x0d\x00\x14\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00"
    head += b"\xff\xc4" + (2 + 2 * (1 + len(table))).to_bytes(2, "big") + b"\x00" + table + b"\x10" + table
    return head + b"\xff\xda\x00\x0c\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00" + data + b"\xff\xd9"


def test_foreign_frames():
    """Files that the writer didn't make, against the transform by its formula."""
    rnd = np.random.Generator(np.random.PCG64(6))
    steps = rnd.integers(1, 30, (8, 8))
    frames, want = [], []
    for _ in range(3):
        blocks = rnd.integers(-40, 41, (2, 6, 8, 8)) * (rnd.random((2, 6, 8, 8)) < rnd.choice([0.02, 0.3, 1.0]))
        frames.append(colour_jpeg(blocks, steps))
        units = [np.block([[slow_pixels(u[0], steps), slow_pixels(u[1], steps)], [slow_pixels(u[2], steps), slow_pixels(u[3], steps)]]) for u in blocks]
        want.append(np.concatenate(units, axis=1)[:13, :20])
    movi, index = b"", b""
    for f in frames:
        index += b"00dc" + np.array([16, 4 + len(movi), len(f)], "<u4").tobytes()
        movi += avi._chunk(b"00dc", f)
    file = avi._chunk(b"RIFF", b"AVI " + avi._chunk(b"LIST", b"movi" + movi) + avi._chunk(b"idx1", index))
    _, pixels = avi.read_frames(file)
    assert pixels.shape == (3, 13, 20) and np.abs(pixels.astype(int) - np.array(want)).max() <= 1
    assert avi.description(file)[5].startswith("unreadable: a file of another kind")
    assert avi.description(file[:400])[0] is None and avi.description(None)[5] == "unreadable: null"


def test_own_frames_to_pixels():
    body = bytes(np.random.Generator(np.random.PCG64(3)).integers(0, 256, 576 * 2, np.uint8))
    stored, pixels = avi.read_avi(avi.write_avi(body))
    order = zigzag()
    for f in range(2):
        for k in range(9):
            block = np.zeros((8, 8))
            for i, p in enumerate(order):
                block[p] = 256 + body[f * 576 + k * 64 + i]
            part = pixels[f, k // 3 * 8 : k // 3 * 8 + 8, k % 3 * 8 : k % 3 * 8 + 8]
            assert np.abs(part.astype(int) - slow_pixels(block, np.ones((8, 8)))).max() <= 1


def test_shots():
    dark, light = np.full((20, 576), 10, np.uint8), np.full((15, 576), 200, np.uint8)
    first, _ = avi.shots(np.concatenate([dark, light, dark]))
    assert first.tolist() == [0, 20, 35]


def test_mix_with_unequal_chances(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 7 + 1).alias("n"), F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("c"))
    two = docs.unionByName(docs.limit(3000).select((F.col("doc_id") + 10**6).alias("doc_id"), F.lit("t").alias("source"), (F.col("n") * 3).alias("n"), "c"))
    got = mix.mix(two, F.col("n"), weights=(1, 1), chance=F.col("c")).cache()
    for r in got.groupBy("source").agg(F.sum("taken").alias("k"), F.first("target").alias("t"), F.max("copies").alias("m")).collect():
        assert abs(r["k"] - r["t"]) < 40 and r["m"] <= 3
    rest = {r["even"]: r["c"] for r in got.filter("source = 's'").groupBy((F.col("doc_id") % 2 == 0).alias("even")).agg(F.avg("copies").alias("c")).collect()}
    assert 1.5 < rest[True] / rest[False] < 3.2


def test_mix_refines_its_last_bin(spark):
    """However few rows may be ordered as a whole, the same documents are taken."""
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "s").alias("source"), (F.col("id") % 50).alias("n"))
    one, other = (mix.mix(docs, F.col("n"), weights=(3, 2), chance=mix.longer_first(F.col("n")), edge_rows=e).select("doc_id", "copies").collect() for e in (10**6, 0))
    assert sorted(map(tuple, one)) == sorted(map(tuple, other)) and len({r["copies"] for r in one}) > 1


def test_certain_documents(spark):
    """A document whose chance is over all bounds is taken, and the others' chances make up the rest."""
    docs = spark.createDataFrame([(i, "s" if i < 1000 else "t", 10, 255 if i < 3 else 1) for i in range(1400)], "doc_id long, source string, n long, c int")
    for seed in ("a", "b", "c"):
        got = {r["doc_id"]: r["copies"] for r in mix.mix(docs, F.col("n"), weights=(1, 6), max_copies=3, chance=F.col("c"), seed=seed).filter("source = 's'").collect()}
        assert all(got[i] == max(got.values()) for i in range(3)) and set(got.values()) == {0, 1}
        assert abs(sum(got.values()) * 10 - 2000) <= 10


def test_allocation(spark):
    rows = [("a", 10, 1), ("b", 1000, 2), ("c", 500, 3), (None, 100, 1)]
    got = {r["source"]: r["target"] for r in mix.allocate(spark.createDataFrame(rows, "source string, source_size long, weight long")).collect()}
    left, target, fixed = 1610.0, {}, set()
    while True:  # as the contract words it
        w = sum(x[2] for x in rows if x[0] not in fixed)
        room = left - sum(3 * x[1] for x in rows if x[0] in fixed)
        target = {x[0]: 3.0 * x[1] if x[0] in fixed else room * x[2] / w for x in rows}
        above = {x[0] for x in rows if x[0] not in fixed and target[x[0]] > 3 * x[1]}
        if not above:
            break
        fixed |= above
    assert got == pytest.approx(target)


def test_shards_fit(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id % 97 as int))").alias("text"))
    docs = docs.unionByName(spark.range(400).select(F.lit(7).cast("long").alias("doc_id"), F.repeat(F.lit("y"), F.lit(50)).alias("text"))).unionByName(spark.range(1).select(F.lit(9999).cast("long").alias("doc_id"), F.repeat(F.lit("z"), F.lit(9000)).alias("text")))
    got = shard.shard(docs, 4000).cache()
    assert got.count() == 3401
    whole = got.groupBy("depth", "shard", "page").agg(F.sum("n_bytes").alias("b"), F.max("oversized").alias("o"), F.count("*").alias("n"))
    assert whole.filter("b > 4000 and not (o and n = 1)").count() == 0
    assert got.filter("doc_id = 9999").first()["oversized"]
    assert got.filter("page = 1").select("doc_id").distinct().collect() == [(7,)]
    for r in whole.join(got.select("depth", "shard", "page", "shard_bytes").distinct(), ["depth", "shard", "page"]).collect():
        assert r["b"] == r["shard_bytes"]


def test_shards_of_any_partitioning(spark):
    """Rows that share an id, equal ones among them, are dealt alike however the input comes."""
    rows = [(7, f"{i % 40} " + "y" * (i % 90)) for i in range(900)] + [(7, "same")] * 300 + [(None, "z" * (i % 50)) for i in range(200)] + [(i, "a" * (i % 60)) for i in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tell = lambda d: sorted(shard.shard(d, 1000).select("doc_id", "text", "page", "depth", "shard", "shard_bytes", "oversized", "n_bytes").collect(), key=repr)
    first = tell(df.coalesce(1))
    assert first == tell(df.orderBy(F.desc("text")).repartition(5)) and len(first) == len(rows)
    whole = collections.Counter()
    for r in first:
        whole[r["page"], r["depth"], r["shard"], r["shard_bytes"]] += r["n_bytes"]
    assert all(n == k[3] <= 1000 for k, n in whole.items())


def test_directory_of_many_shards(spark, monkeypatch):
    """Buckets shorter and longer than the directory's bits, joined and broadcast, against the rule itself."""
    rows = [(i, "x" * (1 + i * i % 300)) for i in range(3000)] + [(10_000 + i, "y" * 900) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sized = [(r["h"], i, len(t)) for (i, t), r in zip(rows, spark.createDataFrame(rows, "i long, t string").select(shard.hash60(F.lit("shard"), F.col("i")).alias("h")).collect())]
    want: dict = {}
    left, depth = sized, 0
    while left:
        held: dict = {}
        for h, i, n in left:
            held.setdefault(h >> (shard.BITS - depth), []).append((h, i, n))
        left = []
        for q, mine in held.items():
            if len(mine) == 1 or sum(n for _, _, n in mine) <= 1000:
                want |= {i: (depth, q) for _, i, _ in mine}
            else:
                left += mine
        depth += 1
    for most in (shard.BROADCAST_ENTRIES, 3):
        monkeypatch.setattr(shard, "BROADCAST_ENTRIES", most)
        assert {r["doc_id"]: (r["depth"], r["shard"]) for r in shard.shard(docs, 1000).collect()} == want


def test_knn_ties_and_bad_vectors(spark):
    rows = [(i, [float(i % 3), 0.5]) for i in range(120)] + [(200, None), (250, [float("nan"), 1.0]), (300, [1.0]), (350, [float("inf"), 0.0]), (400, [0.1, None])]
    got = knn.knn_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = []
    # A shorter vector counts as filled up with zeros.
    good = {i: [int(256 * x // 1) for x in v] for i, v in rows[:120]} | {300: [256, 0]}
    for q in (0, 50, 100, 300):
        s = sorted((-(good[q][0] * v[0] + good[q][1] * v[1]), i) for i, v in good.items() if i != q)[:5]
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_quotes(spark):
    said = "Hello there my dear friends of the list.\nSecond line is here for all of you."
    rows = [
        (1, 0, "u", said), (1, 1, "a", "On Monday Bob wrote:\n> Hello there  my dear\n> friends of the list. Second line is here for all of you.\n\nI agree with everything you said here."),
        (1, 2, "u", "> I agree with everything you said here.\n>> hello there my dear friends of the list.\nThanks"), (2, 0, "u", "> second line is here for all of you.\nNew one"),
        (2, 1, "a", None), (3, 0, "u", "> nobody said this ever anywhere before\nok"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    place = {k: (r["parent_conv"], r["parent_turn"], r["thread_id"], r["depth"], r["own"]) for k, r in got.items()}
    assert place[1, 1] == (1, 0, 1, 1, "I agree with everything you said here.")
    assert place[1, 2] == (1, 1, 1, 2, "Thanks")
    assert place[2, 0] == (1, 0, 1, 1, "New one")
    assert place[3, 0] == (None, None, 3, 0, "ok") and place[2, 1] == (None, None, 2, 0, "")
    assert rows_of(["a"], [(1,)])[1] == [(1,)]


def test_targets_of_many_sources(spark):
    """5,000 sources in several ranges, a null one and empty ones among them: weights and targets as one pass over a list gives."""
    n = 5000
    sizes = {(f"s{i:05d}" if i else None): (0 if i % 97 == 1 else 1 + (i * 7919) % 1000) for i in range(n)}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(7)
    got = {r.source: (r.weight, r.target) for r in mix.allocate(mix.cyclic_weights(df)).collect()}
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(ordered)}
    level, left, weights = 0.0, sum(sizes.values()), sum(weight.values())
    for s in sorted(ordered, key=lambda s: sizes[s] * 3 / weight[s]):
        level = left / weights
        if sizes[s] * 3 >= level * weight[s]:
            break
        left, weights = left - sizes[s] * 3, weights - weight[s]
    want = {s: (weight[s], min(sizes[s] * 3.0, level * weight[s])) for s in ordered}
    assert len(got) == n and all(got[s][0] == want[s][0] and abs(got[s][1] - want[s][1]) < 1e-6 for s in ordered)
    assert abs(sum(t for _, t in got.values()) - sum(sizes.values())) < 1e-3
