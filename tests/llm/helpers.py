"""Brute-force versions that the operators are held against."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def documents(spark, sf=SF):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def without_spans(docs, k=13):
    """(id, words, removed, digest) per document; windows are judged on the input."""
    last = 1 << 62
    split = [(last if i is None else i, i, WORD.findall(x or "")) for i, x in docs]
    first = {}
    for o, _, w in split:
        for j in range(len(w) - k + 1):
            t = tuple(w[j : j + k])
            first[t] = min(first.get(t, last), o)
    out = []
    for o, i, w in split:
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < o:
                gone[j : j + k] = [True] * k
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode())))
    return sorted(out, key=str)


def without_bytes(docs, n):
    data = [(i, (x or "").encode()) for i, x in docs]
    seen = Counter(x[j : j + n] for _, x in data for j in range(len(x) - n + 1))
    out = []
    for i, x in data:
        gone, upto = bytearray(len(x)), 0
        for j in range(len(x) - n + 1):
            if seen[x[j : j + n]] > 1:
                for q in range(max(j, upto), j + n):
                    gone[q] = 1
                upto = j + n
        spans = sum(1 for q in range(len(x)) if gone[q] and (q == 0 or not gone[q - 1]))
        out.append((i, len(x), sum(gone), spans, sha(bytes(b for b, g in zip(x, gone, strict=True) if not g))))
    return sorted(out, key=str)


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def linked(docs, percent=80):
    """(id, shingles, smallest id reachable) per row."""
    sets = [shingles(x) for _, x in docs]
    holders = {}
    for a, s in enumerate(sets):
        for t in s:
            holders.setdefault(t, []).append(a)
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, s in enumerate(sets):
        for b, n in Counter(b for t in s for b in holders[t] if b < a).items():
            if 100 * n >= percent * (len(s) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for a, (i, _) in enumerate(docs):
        least[find(a)] = min(least.get(find(a), 1 << 62), i)
    return sorted((i, len(sets[a]), least[find(a)]) for a, (i, _) in enumerate(docs))
