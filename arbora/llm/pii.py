"""Personal data by candidate gradient boosting.

The base finds e-mail addresses, IP addresses, card numbers and phone numbers by fixed formats; those spans always stay.
High-recall generators then propose more spans, which may overlap each other: long tokens, runs of digits and separators, and
spelled-out addresses.  Boosted trees score each proposal by its format and its context; proposals over a calibrated threshold
are taken in order of score as far as they don't overlap what is already taken.

The trees are trained here on made-up candidates (no table is read), half of which calibrate the threshold: the smallest score
at which PRECISION of the proposals above it are right.

Cases: null and empty texts have no spans; places are code points, the end exclusive; rows that repeat give the same spans;
an empty table gives no rows; columns named like those added are replaced.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, slices, texts_of

#: In the order in which spans are listed: those of the base, then what the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "number", "contact")
PRECISION = 0.995
BLOCK_BYTES = 4 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}+")
#: Runs end where no digit follows; one that a letter follows is none, and is passed as a whole.
_RUN = re.compile(r"(?<![0-9A-Za-z])\(?[0-9](?:[ ()./-]{0,2}[0-9])*+")
_WHOLE = re.compile(r"(?<![0-9A-Za-z])[0-9]++")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|@) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{1,63}+){1,8}")
_HINTS = ("token", "key", "secret", "passw", "api", "auth", "tel", "phone", "call", "mobile", "card", "account", "iban", "mail", "contact", "version", "date", "isbn", "page", "total", "price", "build", "order", "id")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end), each kind leftmost and without overlaps of its own."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            last = max(last, at + 1)
            at = text.find("@", at + 1)
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and _luhn(d):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return out


def proposals(text: str) -> list[tuple[int, int, int]]:
    """Spans that may be personal data, by kind; they may overlap."""
    out = []
    if _DIGIT.search(text):
        out += [(4, m.start(), m.end()) for m in _TOKEN.finditer(text) if _DIGIT.search(m.group()) and _LETTER.search(m.group())]
        runs = {m.span() for m in _RUN.finditer(text) if sum(c in "0123456789" for c in m.group()) >= 7} | {m.span() for m in _WHOLE.finditer(text) if m.end() - m.start() >= 7}
        out += [(5, a, b) for a, b in sorted(runs) if not (text[b : b + 1].isascii() and text[b : b + 1].isalnum())]
    if "(at)" in text or "[at]" in text or "(dot)" in text or "[dot]" in text or "@" in text:
        out += [(6, m.start(), m.end()) for m in _SPELLED.finditer(text)]
    return out


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    s = text[start:end]
    n = len(s)
    digits = [c for c in s if c in "0123456789"]
    counts = Counter(s).values()
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    before = text[max(0, start - 32) : start].lower()
    after = text[end : end + 1]
    return [
        kind, end - start, len(digits) / n, sum(c in "0123456789abcdefABCDEF" for c in s) / n, sum(c.isupper() for c in s) / n, entropy, entropy / math.log2(n + 1), len(groups), max(groups, default=0), min(groups, default=0), len(digits),
        s.count(" "), s.count("-"), s.count("."), s.count("/"), s.count("(") + s.count("["), float("at" in s and ("(at)" in s or "[at]" in s)), float("@" in s), float(13 <= len(digits) <= 19 and _luhn("".join(digits))),
        sum(a in "0123456789" and b.isalpha() or a.isalpha() and b in "0123456789" for a, b in zip(s, s[1:])) / n, sum(c in "aeiouAEIOU" for c in s) / n, float(s.startswith("0")), float(text[start - 1 : start] in ("\"", "'", "=", ":")), float(after in ("\"", "'")), float(after == "" or after.isspace() or after in ".,;!?"),
        float(before[-3:].strip() in ("=", ":", '="', '= "'.strip())), *[float(h in before) for h in _HINTS],
    ]


class Trees(NamedTuple):
    """Boosted trees of depth 3: at each inner node a feature and a cut, at each leaf a step."""

    feature: np.ndarray  # trees x 7
    cut: np.ndarray  # trees x 7
    leaf: np.ndarray  # trees x 8
    threshold: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(3):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - 7]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.3) -> Trees:
    """Gradient boosting for the logistic loss, with Newton steps and cuts at quantiles."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 24))) for j in range(x.shape[1])]
    margin = np.full(len(x), 0.0)
    all_f, all_c, all_leaf = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        f, c, leaf = np.zeros(7, np.int64), np.full(7, np.inf), np.zeros(8)
        at = np.zeros(len(x), np.int64)
        for node in range(7):
            mine = np.flatnonzero(at == node)
            if len(mine) >= 8:
                gain, f[node], c[node] = max(((_gain(g[mine], h[mine], x[mine, j] > t), j, t) for j in range(x.shape[1]) for t in cuts[j][:-1]), key=lambda z: z[0])
                if gain <= 1e-6:
                    c[node] = np.inf
            at[mine] = 2 * node + 1 + (x[mine, f[node]] > c[node])
        for k in range(8):
            mine = at == 7 + k
            leaf[k] = rate * g[mine].sum() / (h[mine].sum() + 1.0)
        margin += leaf[at - 7]
        all_f.append(f)
        all_c.append(c)
        all_leaf.append(leaf)
    return Trees(np.array(all_f), np.array(all_c), np.array(all_leaf), 0.5)


def _gain(g: np.ndarray, h: np.ndarray, right: np.ndarray) -> float:
    gr, hr, gs, hs = g[right].sum(), h[right].sum(), g.sum(), h.sum()
    if not right.any() or right.all():
        return 0.0
    return gr * gr / (hr + 1) + (gs - gr) ** 2 / (hs - hr + 1) - gs * gs / (hs + 1)


def made_up(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates out of invented lines: their features, and whether they are personal data or secrets."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))
    dig = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mix = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    good = [
        lambda: r.choice(["token", "key", "secret", "api_key", "password", "auth"]) + r.choice([" = ", "=", ": ", " "]) + r.choice(["", '"', "'"]) + "§" + r.choice([hexa, mix])(r.choice([20, 24, 32, 40, 64])) + "§" + r.choice(["", '"', "'"]),
        lambda: "§" + hexa(r.choice([32, 40, 64])) + "§",
        lambda: "§" + r.choice(["AKIA", "sk-", "ghp_", "xox"]) + mix(r.randint(18, 40)) + "§",
        lambda: r.choice(["tel ", "phone: ", "call ", "mobile ", ""]) + "§" + r.choice([f"({dig(3)}) {dig(3)}-{dig(4)}", f"{dig(3)}-{dig(3)}-{dig(4)}", f"0{dig(2)} {dig(3)} {dig(4)}", f"0{dig(3)}/{dig(6)}"]) + "§",
        lambda: "§" + dig(r.choice([15, 16, 16, 16])) + "§",
        lambda: r.choice(["card ", "account ", ""]) + "§" + "-".join(dig(4) for _ in range(4)) + "§",
        lambda: r.choice(["mail ", "contact ", "", ""]) + "§" + f"{word()}{r.choice(['.', '', '_'])}{word()} (at) {word()} (dot) {r.choice(['com', 'org', 'net', 'de'])}".replace("(", r.choice("([")).replace("[at)", "[at]").replace("[dot)", "[dot]") + "§",
    ]
    bad = [
        lambda: "§" + f"{r.randint(1900, 2090)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}" + "§",
        lambda: "§" + f"{r.randint(1, 28):02}/{r.randint(1, 12):02}/{r.randint(1900, 2090)}" + "§",
        lambda: "isbn §" + f"978-{dig(1)}-{dig(3)}-{dig(5)}-{dig(1)}" + "§",
        lambda: r.choice(["page ", "total ", "order ", "id ", "price "]) + "§" + dig(r.randint(7, 9)) + "§",
        lambda: "version §" + ".".join(dig(r.randint(1, 3)) for _ in range(r.randint(3, 5))) + "§",
        lambda: "build §" + f"{r.randint(2000, 2090)}{dig(4)}.{dig(3)}" + "§",
        lambda: "§" + "-".join(word() for _ in range(4)) + "-" + dig(2) + "§",
        lambda: "§" + word() + "_" + word() + "_" + word() + dig(1) + "§",
        lambda: "§" + " ".join(dig(r.randint(1, 3)) for _ in range(r.randint(5, 9))) + "§",
        lambda: "§" + word() + word() + word() + dig(r.randint(1, 3)) + "§",
        lambda: "§" + r.choice("=-_+/") * r.randint(16, 60) + dig(1) + "§",
        lambda: "§" + f"{word()} @ {word()}. {word()}" + "§",
        lambda: "§" + f"{r.randint(2000, 2090)}-{r.randint(2000, 2090)}" + "§",
    ]
    x, y = [], []
    while len(y) < n:
        hit = r.random() < 0.5
        line = " ".join(word() for _ in range(r.randint(0, 5)))
        a, body, b = (line + " " + r.choice(good if hit else bad)()).split("§")
        text = a + body + b + r.choice(["", ".", ",", ""]) + " " + " ".join(word() for _ in range(r.randint(0, 4)))
        for kind, s, e in proposals(text):
            inside = min(e, len(a) + len(body)) - max(s, len(a))
            if inside > 0:
                x.append(features(text, kind, s, e))
                y.append(float(hit and inside >= 0.9 * max(e - s, len(body))))
    return np.array(x), np.array(y)


_trained: list[Trees] = []


def train(size: int = 4000) -> Trees:
    """The trees, with the threshold that a half they haven't seen gives; the same in every run."""
    if not _trained:
        trees = boost(*made_up(size, 11))
        x, y = made_up(size, 12)
        s = trees.score(x)
        order = np.argsort(-s, kind="stable")
        right = np.cumsum(y[order]) / np.arange(1, len(s) + 1)
        ok = np.flatnonzero(right >= PRECISION)
        _trained.append(trees._replace(threshold=float(max(0.5, s[order[ok[-1]]] if len(ok) else 1.0))))
    return _trained[0]


class _Taken:
    """Spans that don't overlap each other, in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):  # those of the base may overlap: as runs
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def add(self, a: int, b: int) -> bool:
        """Whether the span was free; it is taken then."""
        at = bisect_left(self.starts, b)
        if at and self.ends[at - 1] > a:
            return False
        self.starts.insert(at, a)
        self.ends.insert(at, b)
        return True


def find_all(texts: list[str], trees: Trees) -> list[list[tuple[int, int, int, float]]]:
    """All spans of each text (kind's number, start, end, score; the base's score 1), by kind, then start."""
    base, more = [base_spans(t) for t in texts], [proposals(t) for t in texts]
    rows = [features(t, *m) for t, found in zip(texts, more) for m in found]
    scores, at, out = trees.score(np.array(rows)) if rows else np.zeros(0), 0, []
    for text_base, found in zip(base, more):
        spans, taken = [(*s, 1.0) for s in text_base], _Taken([s[1:] for s in text_base])
        score, at = scores[at : at + len(found)], at + len(found)
        for k in np.argsort(-score, kind="stable").tolist():
            if score[k] < trees.threshold:
                break
            if taken.add(*found[k][1:]):
                spans.append((*found[k], float(score[k])))
        out.append(sorted(spans))
    return out


def find(text: str, trees: Trees) -> list[tuple[int, int, int, float]]:
    """find_all() of one text."""
    return find_all([text], trees)[0]


def _spans_of(docs: DataFrame, trees: Trees, text: str, redacted: bool) -> DataFrame:
    names = [c for c in docs.columns if c != "spans"]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = texts_of(batch, text)
            raw = flat.tobytes()
            for a, b in slices(offsets, BLOCK_BYTES):
                out, clean = [], []
                bodies = [raw[offsets[i] : offsets[i + 1]].decode() for i in range(a, b)]
                for body, spans in zip(bodies, find_all(bodies, trees)):
                    out.append([{"kind": KINDS[k], "start": s, "end": e, "score": p} for k, s, e, p in spans])
                    if redacted:
                        clean.append(redact(body, spans))
                rows = batch.slice(a, b - a)
                cols = [pa.array(clean, pa.string()) if redacted and c == text else rows.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(out, kind)], names=[*names, "spans"])

    return docs.select(*names).mapInArrow(released(run), T.StructType([*docs.select(*names).schema.fields, *T.StructType.fromDDL("spans array<struct<kind:string,start:int,end:int,score:double>>").fields]))


def redact(text: str, spans: list[tuple[int, int, int, float]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_spans(docs: DataFrame, trees: Trees | None = None, text: str = "text") -> DataFrame:
    """docs with `spans`: kind, start, end and score of all personal data in the text."""
    return _spans_of(docs, trees or train(), text, False)


def redact_documents(docs: DataFrame, trees: Trees | None = None, text: str = "text") -> DataFrame:
    """docs with redacted texts (null becomes empty) and their `spans`."""
    return _spans_of(docs, trees or train(), text, True)


def span_digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind of the base, base_sha256, spans, and the number of all spans and of the added ones by kind."""
    found = find_spans(docs.select("doc_id", "text")).drop("text")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count_of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count_of(k) for k in BASE_KINDS]
    more = [F.size("spans").cast("long").alias("n_spans"), *[count_of(k) for k in KINDS if k not in BASE_KINDS]]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), *more)
