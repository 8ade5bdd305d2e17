"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re

import numpy as np


def repeats(rows, length=100):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen, out = set(), {}
    for d, text in sorted(rows):
        body = (text or "").encode()
        gone = np.zeros(len(body), bool)
        for p in range(len(body) - length + 1):
            w = body[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(body, np.uint8)[~gone]) if body else b""
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d] = (len(body), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingles(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) >= size:
        return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return frozenset([tuple(words)]) if words else frozenset()


def components(rows, percent=85, size=4):
    """doc_id -> (number of shingles, smallest doc_id of its component)."""
    sets = {d: shingles(t, size) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where, common = collections.defaultdict(list), collections.Counter()
    for d in sorted(sets):
        for s in sets[d]:
            for e in where[s]:
                common[e, d] += 1
            where[s].append(d)
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    odd = [int(c) for c in digits[::-1]]
    return sum(odd[0::2] + [d * 2 - 9 * (d > 4) for d in odd[1::2]]) % 10 == 0


def personal(text):
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return out


def tokenizer():
    import public_tokenizers
    import tiktoken

    from arbora.llm import bpe

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
