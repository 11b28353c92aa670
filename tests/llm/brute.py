"""Plain versions of the contracts, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re

import xxhash

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall((text or "").encode())


def item_words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def decontaminate(docs, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = item_words(text)
        size = min(13, len(w))
        if w:
            for k in range(len(w) - size + 1):
                windows[tuple(w[k:k + size])] |= {str(item)} if item is not None else set()
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w, hit, found = item_words(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(w[k:k + size])]
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def groups(prints, bits=3):
    """Group number of each print."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def simhash(docs):
    prints = [fingerprint(t) for _, t in docs]
    of = groups(prints)
    least = {}
    for (doc, _), g in zip(docs, of):
        if doc is not None:
            least[g] = min(doc, least.get(g, doc))
    return [(doc, f"{p:016x}", least.get(g)) for (doc, _), p, g in zip(docs, prints, of)]


def kept_words(docs, window=20):
    """(doc, words, marks of removed words) of documents with distinct ids; a null id sorts last."""
    first = {}
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    for doc, text in order:
        w = words(text)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i:i + window]), (doc, i))
    out = []
    for doc, text in order:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] != (doc, i):
                gone[i:i + window] = [True] * window
        out.append((doc, w, gone))
    return out


def substring(docs):
    return [(doc, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))) for doc, w, gone in kept_words(docs)]


def greedy_pieces(mark, pieces, word):
    """Number of greedy longest-match pieces; 1 for a word that cannot be split."""
    text, at, n = mark + word, 0, 0
    longest = max(map(len, pieces), default=0)
    while at < len(text):
        for size in range(min(longest, len(text) - at), 0, -1):
            if text[at:at + size] in pieces:
                break
        else:
            return 1
        at += size
        n += 1
    return n
