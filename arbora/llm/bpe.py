"""Byte-level BPE: corpus-level merge replay.

The distinct pre-tokens ("words") of a block of documents are laid out once as a flat run of byte tokens.  An inverted index
maps each mergeable pair (named by the rank of what it merges to) to the positions at which it starts.  Merges are replayed in
rank order; each one touches only its own positions and their two neighbours, whose new pairs enter the index.  Documents are
then put together from the words' tokens.

No shuffle: every task replays merges over the words of its own rows, since a word's tokens do not depend on other words.

Cases: null and empty texts give no ids; repeated rows give repeated results; other columns than the two named are ignored
by encode() and kept out of its result unless asked for in `keep`.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, slices, texts_of

NONE = np.int32(2**31 - 1)
#: Bytes of text whose words are replayed together, and words that a task remembers at most.
BLOCK_BYTES = 4 << 20
MEMORY_WORDS = 250_000

#: Texts of these characters alone split alike under the general pattern and under the plainer, faster one.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*\Z")
_GENERAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Encodes many words at once by replaying the merges of a vocabulary in rank order."""

    def __init__(self, ranks: dict[bytes, int]):
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, vals = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    vals.append(rank)
        self.bits = max(10, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.vals = np.full(1 << self.bits, NONE, np.int32)
        left, value = np.array(keys, np.int64), np.array(vals, np.int32)
        slot = self._slot(left)
        while left.size:  # linear probing, all keys of a round at once
            free = self.keys[slot] == -1
            first = np.zeros(left.size, bool)
            first[np.unique(slot, return_index=True)[1]] = True
            take = free & first
            self.keys[slot[take]], self.vals[slot[take]] = left[take], value[take]
            left, value, slot = left[~take], value[~take], (slot[~take] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.vals[slot], NONE)
        todo = np.flatnonzero((found != key) & (found != -1))
        while todo.size:
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.vals[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words one after the other, and the number of each word's tokens."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lens)
        n = int(ends[-1]) if len(words) else 0
        tok = self.single[np.frombuffer(b"".join(words), np.uint8)]
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nonempty = lens > 0
        nxt[ends[nonempty] - 1] = -1
        prv[(ends - lens)[nonempty]] = -1
        rank, alive, flag = np.full(n, NONE, np.int32), np.ones(n, bool), np.zeros(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Find the pairs that start at these positions and put them into the index."""
            at_next = nxt[at]
            inner = at_next >= 0
            rank[at[~inner]] = NONE
            at, at_next = at[inner], at_next[inner]
            new = self.rank_of(tok[at], tok[at_next])
            rank[at] = new
            keep = new != NONE
            at, new = at[keep], new[keep]
            if not at.size:
                return
            order = np.argsort(new, kind="stable")
            at, new = at[order], new[order]
            cut = np.flatnonzero(new[1:] != new[:-1]) + 1
            start = [0, *cut.tolist()]
            for r, a, b in zip(new[start].tolist(), start, [*start[1:], new.size]):
                if r in index:
                    index[r].append(at[a:b])
                else:
                    index[r] = [at[a:b]]
                    heapq.heappush(heap, r)

        enter(np.arange(n, dtype=np.int32))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank[at] == r]
            if not at.size:
                continue
            right = nxt[at]
            flag[at] = True
            if flag[right].any():  # the pair overlaps itself: leftmost first
                flag[at] = False
                gone, kept = set(), []
                for p in np.sort(at).tolist():
                    if p not in gone:
                        kept.append(p)
                        gone.add(int(nxt[p]))
                at = np.array(kept, np.int32)
                right = nxt[at]
                flag[at] = True
            after = nxt[right]
            tok[at], nxt[at] = r, after
            inner = after >= 0
            prv[after[inner]] = at[inner]
            rank[right], alive[right] = NONE, False
            before = prv[at]
            before = before[before >= 0]
            before = before[~flag[before]]
            flag[at] = False
            enter(np.concatenate([at, before]))
        counts = np.add.reduceat(alive, (ends - lens)[nonempty], dtype=np.int64) if nonempty.any() else np.zeros(0, np.int64)
        per_word = np.zeros(len(words), np.int64)
        per_word[nonempty] = counts
        return tok[alive], per_word


class _Words:
    """The words that a task has met, each with its tokens."""

    def __init__(self, replay: MergeReplay):
        self.replay = replay
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.flat, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self) -> None:
        """Replay the merges over all words met since the last call."""
        known = len(self.count)
        if len(self.ids) == known:
            return
        new = [w.encode() for w in list(self.ids)[known:]]
        tokens, counts = self.replay.encode(new)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.flat = np.concatenate([self.flat, tokens])


def _gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + count], one after the other."""
    before = np.cumsum(count) - count
    return flat[np.repeat(start - before, count) + np.arange(int(count.sum()))]


_ready: dict[tuple[int, str], tuple] = {}


def _tools(ranks: dict[bytes, int], pattern: str) -> tuple:
    """Built once in each Python worker for a vocabulary and pattern."""
    key = (len(ranks), str(hash(frozenset(ranks.items()))) + pattern)
    if key not in _ready:
        _ready.clear()
        _ready[key] = MergeReplay(ranks), regex.compile(pattern).findall
    return _ready[key]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str = _GENERAL, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, and `ids`: the text's token ids as little-endian unsigned 32-bit integers, one after the other."""
    fields = [docs.schema[c] for c in keep]
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # the size of a vocabulary, whatever the data's
    plain_ok = pattern == _GENERAL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, general = _tools(shared.value, pattern)
        words = _Words(replay)
        for batch in batches:
            flat, offsets = texts_of(batch, "__text")
            raw = flat.tobytes()
            for a, b in slices(offsets, BLOCK_BYTES):
                if len(words.ids) > MEMORY_WORDS:
                    words.clear()
                known, per_doc = words.ids, []
                for i in range(a, b):
                    s = raw[offsets[i] : offsets[i + 1]].decode()
                    found = _FAST.findall(s) if plain_ok and _PLAIN.match(s) else general(s)
                    per_doc.append(np.fromiter([known.setdefault(w, len(known)) for w in found], np.int64, len(found)))
                words.learn()
                out = []
                for mine in per_doc:
                    out.append(_gather(words.flat, words.start[mine], words.count[mine]).astype("<u4").tobytes())
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), pa.array(out, pa.binary())], names=[*keep, "ids"])

    schema = T.StructType([*fields, T.StructField("ids", T.BinaryType())])
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(released(run), schema)


def decode(encoded: DataFrame, ranks: dict[bytes, int], hashed: bool = False) -> DataFrame:
    """Every column of `encoded`, and `decoded`: the bytes that its `ids` stand for (null ids: empty), or their SHA-256."""
    size = max(ranks.values()) + 1
    names = encoded.columns
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = [b""] * size
        for k, v in shared.value.items():
            token[v] = k
        count = np.fromiter(map(len, token), np.int64, size)
        start, flat = np.cumsum(count) - count, np.frombuffer(b"".join(token), np.uint8)
        for batch in batches:
            ids, offsets = texts_of(batch, "ids")
            for a, b in slices(offsets, BLOCK_BYTES):
                rows, out = batch.slice(a, b - a), []
                for i in range(a, b):
                    mine = ids[offsets[i] : offsets[i + 1]].view("<u4") if offsets[i + 1] > offsets[i] else np.zeros(0, np.uint32)
                    body = _gather(flat, start[mine], count[mine]).tobytes()
                    out.append(hashlib.sha256(body).hexdigest() if hashed else body)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.string() if hashed else pa.binary())], names=[*names, "decoded"])

    return encoded.mapInArrow(released(run), T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType() if hashed else T.BinaryType())]))


def bpe_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str = _GENERAL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    coded = decode(encode(docs, ranks, pattern), ranks, hashed=True)
    return coded.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))
