"""Document quality by a linear-chain conditional random field over lines.

Every line that isn't blank gets features of its own and of its neighbours; a chain with the states bad and good scores them
together with the transitions between neighbours.  A document's score is the mean of its lines' forward-backward marginals
for good, weighted by length, put on the scale of probabilities by a logistic curve.

The model is fitted on a bounded sample of labelled documents (TRAIN_DOCS documents and TRAIN_BYTES bytes of text at most, taken
by hash of the id), by one task on an executor; the driver only gets the model.  A document's label says nothing about a single
line of it, so line labels are learnt: in a bad document those lines that a model of single lines takes for good are good (its
worst line stays bad), in ROUNDS turns of fitting and labelling.  The chain is then fitted on those line labels.  Scoring covers
every line of every text.

Cases: null, empty and blank texts score 0; labels that are null are left out, of several for one id the largest counts; with
no labels or labels of one kind every text with lines scores that kind's share (0.5 without labels); of several texts for one
id the least is learnt from; rows that repeat score alike; an empty table gives no rows; columns named like those added are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, released, slices, texts_of, written

#: Labelled documents that the model is fitted on, and their bytes, at most.
TRAIN_DOCS, TRAIN_BYTES = 3000, 16 << 20
#: Turns of labelling lines; passes over the lines in each, and for the chain.
ROUNDS, LINE_EPOCHS, EPOCHS = 3, 40, 80
THRESHOLD = 0.3
BLOCK_BYTES = 1 << 20

_KINDS = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": b"0123456789",
    "stop": b".,;:?'",
    "shout": b"!",
    "bar": b"|",
    "mark": b"#$%&*+/<=>@\\^_`{}~[]()\"-",
}
_OWN = 14


class Model(NamedTuple):
    weights: np.ndarray  # of the features, for good against bad
    turn: np.ndarray  # 2 x 2: from state to state
    scale: np.ndarray  # mean and deviation of each feature
    curve: tuple[float, float]  # of the logistic curve
    share: float | None  # the only score, where there is nothing to learn from


def line_features(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line that isn't blank: its text's number, its length, and its own and its neighbours' features."""
    n = len(offsets) - 1
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3 * _OWN + 2))
    if not len(flat):
        return empty
    begin = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(flat == 10) + 1]))
    begin = begin[begin < len(flat)]
    size = np.diff(np.append(begin, len(flat)))
    doc = np.searchsorted(offsets, begin, "right") - 1
    space = (flat == 32) | ((flat >= 9) & (flat <= 13))
    count = lambda mask: np.add.reduceat(mask.astype(np.int32), begin).astype(np.float64)
    word = ~space
    first = word.copy()
    first[1:] &= space[:-1]
    first[begin] = word[begin]
    starts = np.flatnonzero(first)
    blank = count(word) == 0
    line_of = np.searchsorted(begin, starts, "right") - 1
    stops = np.append(space[1:], True)
    stops[begin[1:] - 1] = True
    long_ = np.flatnonzero(word & stops) - starts + 1
    words = np.maximum(np.bincount(line_of, minlength=len(begin)).astype(np.float64), 1)
    short = np.bincount(line_of, weights=long_ <= 3, minlength=len(begin))
    huge = np.bincount(line_of, weights=long_ > 24, minlength=len(begin))
    # Words that are the one before again.
    letter = flat.astype(np.int64)
    place = np.arange(len(flat)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(flat)]])))
    spell = np.add.reduceat(letter * (letter + 7919) * (place + 31) * word, starts) if len(starts) else np.zeros(0, np.int64)
    twice = np.append(False, (spell[1:] == spell[:-1]) & (line_of[1:] == line_of[:-1])) if len(starts) else np.zeros(0, bool)
    stutter = np.bincount(line_of, weights=twice, minlength=len(begin))
    ink = np.maximum(size - count(space), 1)
    lut = {}
    for name, chars in _KINDS.items():
        table = np.zeros(256, bool)
        table[list(chars)] = True
        lut[name] = count(table[flat])
    letters = np.maximum(ink - sum(lut[k] for k in ("digit", "stop", "shout", "bar", "mark")), 1)
    # Lines that a text has more than once.
    code = np.add.reduceat(flat.astype(np.int64) * (np.arange(len(flat)) - np.repeat(begin, size) + 7919), begin)
    _, which, times = np.unique(np.stack([doc, code, size]), axis=1, return_inverse=True, return_counts=True)
    again = (times[which.ravel()] > 1).astype(np.float64)
    own = np.stack(
        [
            np.log1p(size), lut["upper"] / letters, np.minimum(lut["mark"] / ink * 5, 3), np.minimum(lut["shout"] / ink * 10, 3), np.minimum(lut["bar"] / words * 3, 3),
            lut["digit"] / ink, np.minimum(lut["stop"] / words, 2), np.log(ink / words), short / words, huge / words, again, np.log1p(words), (lut["upper"] > 0.6 * letters).astype(np.float64), np.minimum(stutter / words * 3, 2),
        ], axis=1,
    )
    keep = ~blank
    own, doc, size = own[keep], doc[keep], size[keep]
    if not len(own):
        return empty
    new = np.append(True, doc[1:] != doc[:-1])
    last = np.append(new[1:], True)
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[new], after[last] = own[new], own[last]
    return doc, size, np.concatenate([own, before, after, new[:, None], last[:, None]], axis=1)


def _marginals(doc: np.ndarray, edge: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lines in order of their documents, with scores `edge` for good against bad: P(good) of each, the sum of the
    pairwise marginals, and each line's part of the log partition function.

    All documents advance together, one line at a time."""
    n = len(doc)
    new = np.append(True, doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    length = np.diff(np.append(head, n))
    order = np.argsort(-length, kind="stable")
    head, length = head[order], length[order]
    live = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")
    emit = np.stack([np.zeros(n), edge], 1)
    emit -= emit.max(1, keepdims=True)
    e, m = np.exp(emit), np.exp(turn - turn.max())
    alpha, norm, beta = np.empty((n, 2)), np.empty(n), np.ones((n, 2))
    for t, k in enumerate(live):
        at = head[:k] + t
        a = e[at] if t == 0 else (alpha[at - 1] @ m) * e[at]
        norm[at] = a.sum(1)
        alpha[at] = a / norm[at, None]
    for t in range(len(live) - 2, -1, -1):
        at = head[: live[t + 1]] + t
        beta[at] = ((beta[at + 1] * e[at + 1]) @ m.T) / norm[at + 1, None]
    good = alpha * beta
    good /= good.sum(1, keepdims=True)
    inner = np.flatnonzero(~new)
    pair = (alpha[inner - 1, :, None] * m[None] * (e[inner] * beta[inner])[:, None, :] / norm[inner, None, None]).sum(0)
    return good[:, 1], pair, norm


class _Climb:
    """Gradient ascent with momentum and a step for each weight."""

    def __init__(self, n: int, rate: float = 0.1):
        self.m1, self.m2, self.rate, self.step = np.zeros(n), np.zeros(n), rate, 0

    def move(self, grad: np.ndarray) -> np.ndarray:
        self.step += 1
        self.m1, self.m2 = 0.9 * self.m1 + 0.1 * grad, 0.99 * self.m2 + 0.01 * grad * grad
        return self.rate * (self.m1 / (1 - 0.9**self.step)) / (np.sqrt(self.m2 / (1 - 0.99**self.step)) + 1e-8)


def _line_labels(x: np.ndarray, doc: np.ndarray, y: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Each line's label: that of its document, but in a bad document lines that look good by themselves are good, except the
    worst."""
    own = np.append(np.arange(_OWN), x.shape[1] - 1)
    x, target = x[:, own], y[doc].astype(np.float64)
    bad = y[doc] == 0
    head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    w = np.zeros(x.shape[1])
    for _ in range(ROUNDS):
        climb = _Climb(len(w))
        for _ in range(LINE_EPOCHS):
            p = 1 / (1 + np.exp(-(x @ w.astype(np.float32)).astype(np.float64)))
            w = w + climb.move((((target - p) * per).astype(np.float32) @ x).astype(np.float64) / len(x) - 1e-3 * np.append(w[:-1], 0))
        edge = x @ w.astype(np.float32)
        worst = np.repeat(np.minimum.reduceat(edge, head), np.diff(np.append(head, len(edge))))
        target = np.where(bad, (edge > 0) & (edge > worst), 1).astype(np.float64)
    return target


def fit_lines(doc: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> Model:
    """A model from the lines of documents with labels y; doc, size and x (float32) as line_features() tells them."""
    dims = 3 * _OWN + 2
    if len(np.unique(y)) < 2:
        return Model(np.zeros(dims), np.zeros((2, 2)), np.stack([np.zeros(dims), np.ones(dims)]), (1.0, 0.0), float(y.mean()) if len(y) else 0.5)
    scale = np.stack([x.mean(0, dtype=np.float64), np.maximum(x.std(0, dtype=np.float64), 1e-3)]) if len(x) else np.stack([np.zeros(dims), np.ones(dims)])
    x = _scaled(x, scale)
    new = np.append(True, doc[1:] != doc[:-1])[: len(doc)]
    inner = np.flatnonzero(~new)
    # A document counts the same however many lines it has, as nearly as a chain allows.
    per = 1 / np.bincount(doc, minlength=len(y))[doc] if len(doc) else np.zeros(0)
    per = per / per.mean() if len(per) else per
    w, turn = np.zeros(dims + 1), np.zeros((2, 2))
    if len(x):
        target = _line_labels(x, doc, y, per)
        state = target.astype(np.int64)
        seen = np.zeros((2, 2))
        np.add.at(seen, (state[inner - 1], state[inner]), 1)
        climb = _Climb(len(w) + 4)
        for _ in range(EPOCHS):
            good, pair, _ = _marginals(doc, (x @ w.astype(np.float32)).astype(np.float64), turn)
            grad = (((target - good) * per).astype(np.float32) @ x).astype(np.float64) / len(x) - 1e-3 * np.append(w[:-1], 0)
            move = climb.move(np.concatenate([grad, ((seen - pair) / len(x) - 1e-3 * turn).ravel()]))
            w, turn = w + move[: len(w)], turn + move[len(w) :].reshape(2, 2)
    good, _, _ = _marginals(doc, (x @ w.astype(np.float32)).astype(np.float64), turn)
    mean = _weighted(doc, size, good, len(y))
    have = np.bincount(doc, minlength=len(y)) > 0
    z, t = np.log((mean[have] + 1e-3) / (1 - mean[have] + 1e-3)), y[have]
    a, b = 1.0, 0.0
    for _ in range(200):  # Newton's steps for the curve
        p = 1 / (1 + np.exp(-(a * z + b)))
        g = np.array([((t - p) * z).sum() - a + 1, (t - p).sum()])
        r = p * (1 - p) + 1e-9
        h = np.array([[(r * z * z).sum() + 1, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        a, b = a + np.clip(da, -1, 1), b + np.clip(db, -1, 1)
    return Model(w, turn, scale, (float(max(a, 0.05)), float(b)), None)


def _scaled(x: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features by their mean and deviation, and a last one that is always 1."""
    out = np.ones((len(x), x.shape[1] + 1), np.float32)
    np.subtract(x, scale[0].astype(np.float32), out=out[:, :-1])
    out[:, :-1] /= scale[1].astype(np.float32)
    np.clip(out[:, :-1], -6, 6, out=out[:, :-1])
    return out


def _lines(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """line_features() of many texts, BLOCK_BYTES at a time."""
    offsets = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3 * _OWN + 2), np.float32))]
    for a, b in slices(offsets, BLOCK_BYTES):
        doc, size, x = line_features(np.frombuffer(b"".join(texts[a:b]), np.uint8), offsets[a : b + 1] - offsets[a])
        parts.append((doc + a, size, x.astype(np.float32)))
    return tuple(np.concatenate(p) for p in zip(*parts))


def fit(texts: list[str], quality: list[int]) -> Model:
    """A model from texts with their labels (0 or 1)."""
    return fit_lines(*_lines([(t or "").encode() for t in texts]), np.array(quality, np.int64))


def _weighted(doc: np.ndarray, size: np.ndarray, good: np.ndarray, n: int) -> np.ndarray:
    total = np.bincount(doc, weights=size, minlength=n)
    return np.bincount(doc, weights=size * good, minlength=n) / np.maximum(total, 1)


def scores(model: Model, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's score; each line's text and P(good)."""
    n = len(offsets) - 1
    doc, size, x = line_features(flat, offsets)
    have = np.bincount(doc, minlength=n) > 0
    if model.share is not None:
        return np.where(have, model.share, 0.0), doc, np.full(len(doc), model.share)
    good, _, _ = _marginals(doc, (_scaled(x, model.scale) @ model.weights.astype(np.float32)).astype(np.float64), model.turn)
    mean = _weighted(doc, size, good, n)
    z = model.curve[0] * np.log((mean + 1e-3) / (1 - mean + 1e-3)) + model.curve[1]
    return np.where(have, 1 / (1 + np.exp(-z)), 0.0), doc, good


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> Model:
    """A model from the labelled documents that aren't held out, `most` of them and `most_bytes` of text at most."""
    known = labels.filter("quality is not null and doc_id is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    some = known.withColumn("turn", F.md5(F.col("doc_id").cast("string"))).orderBy("turn", "doc_id").limit(most)
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id").groupBy("doc_id", "turn").agg(F.first("quality").alias("quality"), F.min("text").alias("text"))
    sample = written(sample, "crf-sample")
    # Numbers of `most` documents at most; a text that doesn't fit any more is left out.
    held, chosen = 0, []
    for r in sample.select("doc_id", F.octet_length("text").alias("n")).orderBy("turn", "doc_id").collect():
        if held + r["n"] <= most_bytes:
            held += r["n"]
            chosen.append(r["doc_id"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += zip(batch.column("doc_id").to_pylist(), batch.column("quality").to_pylist(), batch.column("text").to_pylist())
        rows.sort()
        model = fit([r[2] for r in rows], [min(1, max(0, r[1])) for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(tuple(model))], pa.binary())], names=["model"])

    fitted = sample.filter(F.col("doc_id").isin(chosen)).select("doc_id", "quality", "text").coalesce(1).mapInArrow(released(learn), "model binary").collect()
    discard(sample)
    return Model(*pickle.loads(bytes(fitted[0]["model"]))) if fitted else fit([], [])


def score(docs: DataFrame, model: Model, column: str = "score", text: str = "text") -> DataFrame:
    """docs with the score, the number of lines that aren't blank and of those that are likelier bad."""
    names = [c for c in docs.columns if c not in (column, "n_lines", "n_bad_lines", "__text")]
    body = text if text in names else "__text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = texts_of(batch, body)
            for a, b in slices(offsets, BLOCK_BYTES):
                mine, doc, good = scores(model, flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                lines, bad = np.bincount(doc, minlength=b - a), np.bincount(doc, weights=good < 0.5, minlength=b - a).astype(np.int64)
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(mine), pa.array(lines), pa.array(bad)], names=[*names, column, "n_lines", "n_bad_lines"])

    schema = docs.select(*names).schema.add(column, "double").add("n_lines", "long").add("n_bad_lines", "long")
    return docs.select(*names, *([] if body == text else [F.col(text).alias(body)])).mapInArrow(released(run), schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (and line counts) of every document."""
    lean = docs.select("doc_id", "text")
    told = score(lean, train(lean, labels))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_lines", "n_bad_lines")
