"""Benchmark decontamination by latent semantic retrieval.

Texts are read as overlapping passages, benchmark items as pieces that fit into the overlap.  Both are TF-IDF vectors over
the words of the benchmark; other words have no part in a cosine.

1. Document frequencies of the benchmark's words over all documents.
2. A randomised SVD: every task multiplies its passages with a random matrix and adds up the product with the
   passages again; the sums give the leading right singular vectors (Nystrom form, one pass).  The benchmark's
   pieces enter with the weight of the corpus, so their directions are kept.
3. Passages near a piece in the latent space are candidates.  The longest common subsequence of words with the whole item,
   around the passage, and that with its answer (the last sentence) decide, so paraphrases are found too.
4. Beside the latent space, every place that shares a window of words with an item (the whole item if that is short) is a
   candidate for the same decision, so no item that stands word by word in a text depends on a cosine.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.llm.blocks import Texts
from wavetable.llm.common import query, table

HALF = 24  # a passage has two halves of so many words; the next one starts one half later
RANK = 64  # at least; grows with the square root of the number of pieces
OVERSAMPLE = 16
COSINE = 0.45  # for a piece of HALF words; shorter ones are diluted by the rest of a passage and need less
COMMON, RARE_COUNT = 0.05, 20  # words in more than this share of the documents (and so many more) have no weight, unless a piece has no other
WEIGHT = 0.4  # a passage must hold this share of a piece's TF-IDF weight to be compared word by word
VERBATIM = 0.8  # share of an item's words, in order, that proves it
PARAPHRASE, ANSWER, RARE = 0.6, 0.75, 0.5  # or a smaller share, with the answer and this share of the item's TF-IDF weight
SHORT = 8  # shorter items must appear word by word
WINDOW = 4  # consecutive words that lead to a longer item
ITEMS = 20_000  # items of one pass; a larger benchmark takes several
CHUNK = 1 << 20
ENTRIES = 1 << 14  # rows of a matrix that are gathered at once
HITS = "item long, cosine double, lcs_share double, answer_share double"

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[48:58] = _SEPARATOR[97:123] = _SEPARATOR[128:] = False


def hashed(texts: list[str]) -> tuple[Texts, np.ndarray]:
    """Words (runs of letters and digits of the lower-cased text) and their hashes."""
    b = Texts([t.lower().encode() for t in texts])
    b.words(_SEPARATOR)
    return b, b.word_hashes()


@dataclass
class Items:
    """The benchmark of one pass; ``answers`` are counted from the end of ``words``."""

    ids: list[int]
    words: list[list[int]]
    answers: list[int]
    vocabulary: np.ndarray
    piece_item: np.ndarray
    piece_words: list[np.ndarray]


def read_items(rows: list) -> Items:
    ids, words, answers, owner, pieces = [], [], [], [], []
    for number, text in sorted(rows, key=lambda r: (r[0], r[1])):
        _, h = hashed([text])
        if not len(h):
            continue
        sentences = [s for s in re.split(r"[.!?\n]+", text) if len(hashed([s])[1])]
        answer = len(hashed([sentences[-1]])[1]) if len(sentences) > 1 else -(-len(h) // 4)
        for part in np.array_split(h, -(-len(h) // HALF)):
            owner.append(len(ids))
            pieces.append(part)
        ids.append(number), words.append(h.tolist()), answers.append(answer)
    return Items(ids, words, answers, np.unique(np.concatenate([np.zeros(0, np.uint64), *pieces])), np.array(owner, np.int64), pieces)


def lookup(h: np.ndarray, vocabulary: np.ndarray, maybe: np.ndarray) -> np.ndarray:
    """Place of each word in the vocabulary, or -1; ``maybe`` is a bitmap that spares most searches."""
    out = np.full(len(h), -1, np.int32)
    on = np.flatnonzero(maybe[(h & np.uint64(len(maybe) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(vocabulary, h[on]), len(vocabulary) - 1)
    ok = vocabulary[at] == h[on]
    out[on[ok]] = at[ok]
    return out


def weighted(word: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Words without weight are as if they were not in the vocabulary."""
    return np.where((word >= 0) & (idf[word] > 0), word, -1)


def bitmap(vocabulary: np.ndarray) -> np.ndarray:
    m = np.zeros(1 << max(20, (16 * len(vocabulary)).bit_length()), bool)
    m[(vocabulary & np.uint64(len(m) - 1)).astype(np.int64)] = True
    return m


def runs(key: np.ndarray) -> Iterator[tuple[np.ndarray, int, int, np.ndarray]]:
    """Sorted keys in slices of whole runs, about ``ENTRIES`` at once: (key of each run, begin and end of the slice, starts inside it)."""
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    first = 0
    while first < len(start):
        a = start[first]
        last = max(first + 1, int(np.searchsorted(start, a + ENTRIES)))
        yield key[start[first:last]], a, start[last] if last < len(start) else len(key), start[first:last] - a
        first = last


class Passages:
    """Sparse TF-IDF rows of the passages of some texts: (passage, word, weight), and each passage's place and length."""

    def __init__(self, b: Texts, word: np.ndarray, idf: np.ndarray):
        halves = -(-b.wn // HALF)
        count = np.where(b.wn > 0, np.maximum(halves - 1, 1), 0)  # passages of each text
        base = np.cumsum(count) - count
        self.row = np.repeat(np.arange(len(count)), count)
        self.first = (np.arange(len(self.row)) - np.repeat(base, count)) * HALF
        n = len(self.row)
        k = (np.arange(len(word)) - b.w0[b.wd]) // HALF  # half of each word
        ahead, behind = k < count[b.wd], k > 0  # it opens passage k, closes passage k - 1
        p = base[b.wd] + k
        at = np.concatenate([p[ahead], (p - 1)[behind]])
        w = np.concatenate([word[ahead], word[behind]])
        known = w >= 0
        key, tf = np.unique(at[known] * len(idf) + w[known], return_counts=True)
        self.passage, self.word = key // max(len(idf), 1), key % max(len(idf), 1)
        self.weight = tf * idf[self.word]
        self.norm = np.sqrt(np.bincount(self.passage, weights=self.weight**2, minlength=n))

    def times(self, m: np.ndarray, on: np.ndarray) -> np.ndarray:
        """Rows of the passages ``on`` (in order), scaled to length 1, times a matrix over the vocabulary."""
        place = np.full(len(self.row), -1)
        place[on] = np.arange(len(on))
        e = np.flatnonzero(place[self.passage] >= 0)
        out = np.zeros((len(on), m.shape[1]), np.float32)
        if len(e):
            scaled = (self.weight[e] / self.norm[self.passage[e]]).astype(np.float32)
            for to, a, b, start in runs(place[self.passage[e]]):
                out[to] = np.add.reduceat(m[self.word[e[a:b]]] * scaled[a:b, None], start, axis=0)
        return out


def parts(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK or i + 1 == len(texts):
            yield start, texts[start : i + 1]
            start, size = i + 1, 0


def common(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence; ``masks``: the places of each word among ``size``, as bits."""
    full = (1 << size) - 1
    v = full
    for w in words:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def windows(h: np.ndarray, lengths: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each length the hashes of the runs of so many words, by their first word."""
    run = np.zeros(len(h), np.uint64)
    for n in range(1, max(lengths, default=0) + 1):
        if n > len(h):
            return
        run = run[: len(h) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + h[n - 1 :]
        if n in lengths:
            yield n, run


def places(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


@dataclass
class Model:
    items: Items
    idf: np.ndarray
    latent: np.ndarray  # vocabulary x rank
    pieces: np.ndarray  # pieces x rank, of length 1
    heavy: np.ndarray  # least TF-IDF length of a passage that can hold each piece

    def prepare(self) -> Model:
        self.maybe = bitmap(self.items.vocabulary)
        self.masks = [(places(w), places(w[-a:]), len(w), a) for w, a in zip(self.items.words, self.items.answers, strict=True)]
        # the words of each piece with their share of its weight, as one sorted list of (piece, word)
        size, keys, shares = len(self.items.vocabulary), [], []
        for q, words in enumerate(self.items.piece_words):
            w, tf = np.unique(np.searchsorted(self.items.vocabulary, words), return_counts=True)
            keys.append(q * size + w)
            shares.append(tf * self.idf[w] / (tf * self.idf[w]).sum())
        self.piece_key, self.piece_share = np.concatenate(keys), np.concatenate(shares)
        self.weights = [self.idf[np.searchsorted(self.items.vocabulary, np.array(w, np.uint64))].tolist() for w in self.items.words]
        size = np.array([len(w) for w in self.items.piece_words])
        self.least = (COSINE * np.sqrt(np.minimum(size, HALF) / HALF)).astype(np.float32)
        # windows by length, sorted by hash: (hashes, item, place in the item); those of common words alone are left out
        entries: dict[int, list] = {}
        for q, (words, weight) in enumerate(zip(self.items.words, self.weights, strict=True)):
            n = len(words) if len(words) < SHORT else WINDOW
            for _, run in windows(np.array(words, np.uint64), {n}):
                entries.setdefault(n, []).extend((int(x), q, i) for i, x in enumerate(run) if n < WINDOW or len(words) < SHORT or any(weight[i : i + n]))
        self.windows = {}
        for n, e in entries.items():
            e.sort()
            key = np.array([x[0] for x in e], np.uint64)
            self.windows[n] = (key, np.array([x[1] for x in e]), np.array([x[2] for x in e]), bitmap(key))
        return self

    def shared(self, b: Texts, h: np.ndarray) -> np.ndarray:
        """Distinct (text, item, first word of the item if it stood there as it is), the last coarse: one per item's length."""
        out = [np.zeros((0, 3), np.int64)]
        length = np.array([len(w) for w in self.items.words])
        for n, run in windows(h, set(self.windows)):
            key, item, place, maybe = self.windows[n]
            at = np.flatnonzero(maybe[(run & np.uint64(len(maybe) - 1)).astype(np.int64)])
            row = b.wd[at]
            at = at[at + n <= b.w0[row] + b.wn[row]]
            lo, hi = np.searchsorted(key, run[at]), np.searchsorted(key, run[at], "right")
            many = hi - lo
            e = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
            at, q = np.repeat(at, many), item[e]
            start = at - place[e]
            if n != WINDOW:
                out.append(np.stack([b.wd[at], q, start], 1))
                continue
            long = length[q] >= SHORT
            step = np.where(long, length[q], 1)
            out.append(np.stack([b.wd[at], q, start // step * step], 1))
        return np.unique(np.concatenate(out), axis=0)

    def judged(self, q: int, words: list[int]) -> tuple[float, float] | None:
        """Share of the item and of its answer if these words hold it."""
        masks, answer, n, a = self.masks[q]
        if n < SHORT:
            item = self.items.words[q]
            return (1.0, 1.0) if any(words[s : s + n] == item for s in range(len(words) - n + 1)) else None
        share = common(masks, n, words) / n
        if share < PARAPHRASE:
            return None
        told = common(answer, a, words) / a
        weight = self.weights[q]
        known = set(words)
        rare = sum(v for w, v in zip(self.items.words[q], weight, strict=True) if w in known) / max(sum(weight), 1e-9)
        return (share, told) if share >= VERBATIM or told >= ANSWER and rare >= RARE else None

    def held(self, p: Passages, x: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Share of each piece's weight in words that the passage has."""
        first = np.searchsorted(p.passage, x)
        n = np.searchsorted(p.passage, x, "right") - first
        pair = np.repeat(np.arange(len(x)), n)
        word = p.word[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(pair))]
        key = piece[pair] * len(self.items.vocabulary) + word
        at = np.minimum(np.searchsorted(self.piece_key, key), len(self.piece_key) - 1)
        return np.bincount(pair, weights=np.where(self.piece_key[at] == key, self.piece_share[at], 0.0), minlength=len(x))

    def hits(self, texts: list[str]) -> list[dict[int, tuple[float, float, float]]]:
        """For each text the items it holds, with cosine, share of the item and share of its answer."""
        out: list[dict] = [{} for _ in texts]
        for at, part in parts(texts):
            b, h = hashed(part)
            p = Passages(b, weighted(lookup(h, self.items.vocabulary, self.maybe), self.idf), self.idf)
            on = np.flatnonzero((p.norm > 0) & (p.norm >= self.heavy.min()))
            z = p.times(self.latent, on)
            near = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)) @ self.pieces.T
            i, j = np.nonzero((near >= self.least) & (p.norm[on][:, None] >= self.heavy))
            enough = self.held(p, on[i], j) >= WEIGHT
            i, j = i[enough], j[enough]
            for x, q, c in zip(on[i], self.items.piece_item[j], near[i, j], strict=True):
                found, row = out[at + p.row[x]], p.row[x]
                if q in found:
                    found[q] = (max(found[q][0], float(c)), *found[q][1:])
                    continue
                n = self.masks[q][2]
                first, end = b.w0[row], b.w0[row] + b.wn[row]
                if told := self.judged(q, h[max(first, first + p.first[x] - n) : min(end, first + p.first[x] + 2 * HALF + n)].tolist()):
                    found[q] = (float(c), *told)
            for row, q, start in self.shared(b, h):
                found = out[at + row]
                if q in found:
                    continue
                n = self.masks[q][2]
                first, end = b.w0[row], b.w0[row] + b.wn[row]
                # a coarse start is up to one length early
                if told := self.judged(q, h[max(first, start - n) : min(end, start + 3 * n)].tolist()):
                    mine = np.flatnonzero(p.row[on] == row)
                    mine = mine[(first + p.first[on[mine]] < start + 2 * n) & (first + p.first[on[mine]] + 2 * HALF > start)]
                    found[q] = (float(near[np.ix_(mine, np.flatnonzero(self.items.piece_item == q))].max(initial=0.0)), *told)
        return out


def fit(docs: DataFrame, items: Items, text: str, seed: int = 11) -> Model:
    """Document frequencies and the latent space; what reaches the driver is bounded by the vocabulary of ``items``."""
    vocabulary = items.vocabulary
    texts = docs.select(F.col(text).alias("t")).where("t is not null")

    def frequencies(batches):
        maybe, df, n = bitmap(vocabulary), np.zeros(len(vocabulary) + 1, np.int64), 0
        for batch in batches:
            for _, part in parts(batch["t"].to_pylist()):
                b, h = hashed(part)
                w = lookup(h, vocabulary, maybe)
                on = w >= 0
                df[:-1] += np.bincount(np.unique(b.wd[on] * len(vocabulary) + w[on]) % len(vocabulary), minlength=len(vocabulary))
                df[-1] += len(part)
        yield pa.record_batch([pa.array(np.arange(len(df), dtype=np.int32)), pa.array(df)], ["w", "n"])

    got = texts.mapInArrow(frequencies, "w int, n long").groupBy("w").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(vocabulary) + 1)
    df[got["w"].to_numpy()] = got["n"].to_numpy()
    total = df[-1]
    idf = np.log((1 + total) / (1 + df[:-1])) + 0.1
    usual = df[:-1] > COMMON * total + RARE_COUNT
    for words in items.piece_words:
        w = np.searchsorted(vocabulary, words)
        if usual[w].all():
            usual[w] = False
    idf[usual] = 0.0
    rank = max(RANK, int(2 * len(items.piece_words) ** 0.5))
    width = min(rank + OVERSAMPLE, len(vocabulary))
    omega = np.random.default_rng(seed).standard_normal((len(vocabulary), width)).astype(np.float32)

    def sketch(batches):
        maybe, total = bitmap(vocabulary), np.zeros((len(vocabulary), width + 1))
        for batch in batches:
            for _, part in parts(batch["t"].to_pylist()):
                b, h = hashed(part)
                p = Passages(b, weighted(lookup(h, vocabulary, maybe), idf), idf)
                if not len(p.word):
                    continue
                y = p.times(omega, np.arange(len(p.row)))
                scaled = p.weight / p.norm[p.passage]
                order = np.argsort(p.word, kind="stable")
                for w, a, z, start in runs(p.word[order]):
                    some = order[a:z]
                    total[w, :width] += np.add.reduceat(y[p.passage[some]] * scaled[some, None].astype(np.float32), start, axis=0)
                    total[w, width] += np.add.reduceat(scaled[some] ** 2, start)
        yield pa.record_batch([pa.array(np.arange(len(vocabulary), dtype=np.int32)), *[pa.array(c) for c in total.T]], ["w", *[f"y{i}" for i in range(width + 1)]])

    schema = "w int, " + ", ".join(f"y{i} double" for i in range(width + 1))
    got = texts.mapInArrow(sketch, schema).groupBy("w").agg(*[F.sum(f"y{i}").alias(f"y{i}") for i in range(width + 1)]).toArrow()
    y = np.zeros((len(vocabulary), width + 1))
    if got.num_rows:
        y[got["w"].to_numpy()] = np.stack([got[f"y{i}"].to_numpy() for i in range(width + 1)], 1)
    mass, y = y[:, -1].sum(), y[:, :-1]
    pieces = np.zeros((len(items.piece_words), len(vocabulary)), np.float32)
    for i, words in enumerate(items.piece_words):
        w, tf = np.unique(np.searchsorted(vocabulary, words), return_counts=True)
        pieces[i, w] = tf * idf[w]
    length = np.linalg.norm(pieces, axis=1)
    pieces /= length[:, None]
    y += max(mass, 1.0) / len(pieces) * (pieces.T @ (pieces @ omega))
    # Nystrom: M is about Y (W' Y)^-1 Y' with W the random matrix; its eigenvectors are the singular vectors wanted
    core = omega.T @ y
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > value[-1] * 1e-9
    u, _, _ = np.linalg.svd(y @ (vector[:, good] / np.sqrt(value[good])), full_matrices=False)
    latent = np.ascontiguousarray(u[:, :rank], dtype=np.float32)
    flat = pieces @ latent
    return Model(items, idf, latent, (flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-9)).astype(np.float32), WEIGHT * length)


def models(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str) -> list[Model]:
    """One model for every ``ITEMS`` items in expectation; items without words are left out."""
    rows = benchmark.select(F.col(item).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    n = -(-rows.count() // ITEMS)
    out = []
    for part in range(n):
        items = read_items([tuple(r) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == part).collect()])
        if items.ids:
            out.append(fit(docs, items, text))
    return out


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, cosine, lcs_share, answer_share): the benchmark items that a document holds, verbatim or rephrased.

    Null and empty texts hold none; null items or item texts are no items; equal items of different ids are all reported; an
    empty benchmark or table gives no row.  Repeated rows are reported as often as they occur.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, {HITS}"
    names = ["key", "item", "cosine", "lcs_share", "answer_share"]
    out = docs.sparkSession.createDataFrame([], schema)
    for model in models(docs, benchmark, text, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def report(batches, shared=shared):
            m = shared.value.prepare()
            for b in batches:
                rows, numbers, values = [], [], []
                for i, found in enumerate(m.hits([t or "" for t in b["t"].to_pylist()])):
                    for q, v in sorted(found.items()):
                        rows.append(i), numbers.append(m.items.ids[q]), values.append(v)
                cols = [pa.array([v[c] for v in values], pa.float64()) for c in range(3)]
                yield pa.record_batch([b["k"].take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int64()), *cols], names)

        out = out.union(docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(report, schema))
    return out.withColumnsRenamed({"key": key, "item": item})


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark item; null texts stay."""
    for model in models(docs, benchmark, text, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def keep(batches, shared=shared):
            m = shared.value.prepare()
            for b in batches:
                yield b.filter(pa.array([not x for x in m.hits([t or "" for t in b[text].to_pylist()])], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


@query("op3_latent_leaks")
def op3(spark, sf):
    found = find(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", F.round("cosine", 4).alias("cosine"), F.round("lcs_share", 4).alias("lcs_share"), F.round("answer_share", 4).alias("answer_share"))
