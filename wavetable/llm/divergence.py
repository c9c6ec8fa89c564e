"""Audit of how the sources of a language diverge in their words, with late strings.

1. Tasks count the terms of whole texts and pre-aggregate them; what is shuffled is (language, source, 64-bit digest, occurrences,
   documents), never a term.
2. A digest is kept if at least ``LEAST_DOCS`` documents of its language hold it.  A second pass looks only at occurrences that a
   bit filter of fixed size lets through and sends the smallest and largest string of each digest and task.
3. Where the two differ, terms collide: a third pass counts these digests by string, and each string is kept or not on its own.
4. Probabilities, differences and ranks are computed on digests.  A term's text joins only the rows that are returned.

A term's probability in a group is ``1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V))``, in exact integers.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetable.llm.blocks import Texts
from wavetable.llm.common import query, table
from wavetable.operators.scale import checked_broadcast
from wavetable.session import materialise

LEAST_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP = 50
PIECE_BYTES = 2 << 20  # text that is looked at at once
HELD = 1 << 19  # counts that a task gathers before it sends them
HELD_STRINGS = 1 << 19  # terms whose strings a task gathers before it sends them
SENT = 1 << 16  # rows of a batch that a task sends
FILTER_WORDS = 1 << 18  # 64-bit words of the bit filter: 2 MB, whatever the number of kept terms
PART_TERMS = 8_192  # kept terms whose differences one task sums, in expectation
TILE = 256  # sources whose rows of the pair table one task sums
COUNTS = "lang string, source string, digest long, n long, docs long"

_OTHER = np.ones(256, bool)
_OTHER[65:91] = _OTHER[97:123] = _OTHER[128:] = False


class Terms(Texts):
    """Terms (runs of A-Z, a-z and all characters above U+007F, A-Z lower-cased) of some texts with their digests."""

    def __init__(self, texts: list[bytes], bits: int):
        super().__init__(texts, lower=True)
        self.words(_OTHER)
        self.digest = self.word_hashes() >> np.uint64(64 - bits)

    def string(self, i: int) -> bytes:
        return self.raw[self.ws[i] : self.we[i]].tobytes()

    def differs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether terms ``i`` and ``j`` are different strings, eight bytes at a time."""
        raw = np.append(self.raw, np.zeros(8, np.uint8))
        lanes = np.lib.stride_tricks.as_strided(raw[:8].view("<u8"), (len(raw) - 7,), (1,))
        size = (self.we - self.ws)[i]
        out = size != (self.we - self.ws)[j]
        live, at = np.flatnonzero(~out), 0
        while len(live):
            left = np.minimum(size[live] - at, 8)
            mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - left) * 8).astype(np.uint64)
            out[live] = (lanes[self.ws[i[live]] + at] ^ lanes[self.ws[j[live]] + at]) & mask != 0
            at += 8
            live = live[~out[live] & (size[live] > at)]
        return out


def _pieces(batch: pa.RecordBatch):
    """(rows, texts) of a batch, about ``PIECE_BYTES`` of text at once; a longer text comes alone."""
    texts, size, first = [], 0, 0
    for i, x in enumerate(batch["text"]):
        t = x.as_py().encode()
        if texts and size + len(t) > PIECE_BYTES:
            yield slice(first, i), texts
            texts, size, first = [], 0, i
        texts.append(t)
        size += len(t)
    if texts:
        yield slice(first, len(batch)), texts


def _summed(group: np.ndarray, digest: np.ndarray, n: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row per (group, digest) with the sums of the other two."""
    order = np.lexsort((digest, group))
    group, digest = group[order], digest[order]
    at = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (digest[1:] != digest[:-1]))) if len(group) else np.zeros(0, np.int64)
    if not len(at):
        return group, digest, n, docs
    return group[at], digest[at], np.add.reduceat(n[order], at), np.add.reduceat(docs[order], at)


def term_counts(rows: DataFrame, bits: int) -> DataFrame:
    """(lang, source, digest, n, docs) of rows (lang, source, text) without nulls: occurrences and documents, pre-aggregated in the task."""

    def count(batches):
        names: dict[tuple, int] = {}
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def sent():
            group, digest, n, docs = _summed(*map(np.concatenate, zip(*held, strict=True)))
            named = [pa.array([g[i] for g in names], pa.string()) for i in range(2)]
            for at in range(0, len(group), SENT):
                some = slice(at, at + SENT)
                of = pa.array(group[some])
                yield pa.record_batch([*(x.take(of) for x in named), pa.array(digest[some].view(np.int64)), pa.array(n[some]), pa.array(docs[some])], ["lang", "source", "digest", "n", "docs"])

        for b in batches:
            keys = list(zip(b["lang"].to_pylist(), b["source"].to_pylist(), strict=True))
            for where, texts in _pieces(b):
                of = np.array([names.setdefault(k, len(names)) for k in keys[where]], np.int64)
                t = Terms(texts, bits)
                if not len(t.digest):
                    continue
                distinct, index = np.unique(t.digest, return_inverse=True)
                place, n = np.unique(index * np.int64(len(texts)) + t.wd, return_counts=True)
                group, digest = of[place % len(texts)], distinct[place // len(texts)]
                held.append(_summed(group, digest, n.astype(np.int64), np.ones(len(n), np.int64)))
                size += len(held[-1][0])
                if size > HELD:
                    held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from sent()
                        held, names, size = [], {}, 0
        if size:
            yield from sent()

    sent = rows.mapInArrow(count, COUNTS)
    return sent.groupBy("lang", "source", "digest").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def bit_filter(digests: DataFrame) -> np.ndarray:
    """A filter of fixed size: bit ``digest mod (64 * FILTER_WORDS)`` is set for every digest."""
    place = F.pmod("digest", F.lit(64 * FILTER_WORDS))
    words = digests.groupBy((place / 64).cast("long").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(FILTER_WORDS, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _passing(bits: np.ndarray, digest: np.ndarray) -> np.ndarray:
    place = np.mod(digest.view(np.int64), np.int64(64 * FILTER_WORDS)).astype(np.uint64)
    return np.flatnonzero((bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1))


def extremes(rows: DataFrame, kept: DataFrame, bits: int) -> DataFrame:
    """(lang, digest, low, high): smallest and largest string of every kept (lang, digest)."""
    wanted = bit_filter(kept.select("digest").distinct())

    def look(batches):
        held: dict[tuple[str, int], tuple[bytes, bytes]] = {}

        def sent():
            keys, ends = zip(*held.items(), strict=True)
            low, high = (pa.array([e[i].decode() for e in ends]) for i in range(2))
            return pa.record_batch([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int64()), low, high], ["lang", "digest", "low", "high"])

        for b in batches:
            langs = np.array(b["lang"].to_pylist(), object)
            for where, texts in _pieces(b):
                t = Terms(texts, bits)
                on = _passing(wanted, t.digest)
                of = langs[where]
                for lang in set(of):
                    mine = on[(of == lang)[t.wd[on]]]
                    digest, first, index = np.unique(t.digest[mine], return_index=True, return_inverse=True)
                    odd = mine[t.differs(mine, mine[first[index]])]
                    for d, i in [*zip(digest.view(np.int64).tolist(), mine[first].tolist(), strict=True), *zip(t.digest[odd].view(np.int64).tolist(), odd.tolist(), strict=True)]:
                        s = t.string(i)
                        low, high = held.get((lang, d), (s, s))
                        held[lang, d] = (min(low, s), max(high, s))
                if len(held) > HELD_STRINGS:
                    yield sent()
                    held = {}
        if held:
            yield sent()

    seen = rows.mapInArrow(look, "lang string, digest long, low string, high string")
    ends = seen.groupBy("lang", "digest").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return ends.join(kept.select("lang", "digest").distinct(), ["lang", "digest"], "left_semi")


def counts_by_string(rows: DataFrame, collided: DataFrame, bits: int) -> DataFrame:
    """(lang, source, digest, split, n, docs) of the digests in which terms collide, each string on its own."""
    wanted = bit_filter(collided.select("digest").distinct())

    def count(batches):
        for b in batches:
            langs, sources = b["lang"].to_pylist(), b["source"].to_pylist()
            for where, texts in _pieces(b):
                t = Terms(texts, bits)
                on = _passing(wanted, t.digest)
                of_doc = Counter(zip(t.wd[on].tolist(), t.digest[on].view(np.int64).tolist(), map(t.string, on.tolist()), strict=True))
                n, docs = Counter(), Counter()
                for (row, d, s), times in of_doc.items():
                    k = (langs[where.start + row], sources[where.start + row], d, s.decode())
                    n[k] += times
                    docs[k] += 1
                if n:
                    columns = [pa.array([k[i] for k in n], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.string()))]
                    yield pa.record_batch([*columns, pa.array(list(n.values()), pa.int64()), pa.array([docs[k] for k in n], pa.int64())], ["lang", "source", "digest", "split", "n", "docs"])

    sent = rows.mapInArrow(count, "lang string, source string, digest long, split string, n long, docs long")
    exact = sent.groupBy("lang", "source", "digest", "split").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return exact.join(collided.select("lang", "digest"), ["lang", "digest"], "left_semi")


def kept_terms(rows: DataFrame, least: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """((lang, source, digest, split, n, n_lang) of every kept term where it occurs, (lang, digest, term) of digests without collision).

    ``split`` is empty but for terms whose digest collides with another's; there it is the term.
    """

    def enough(counts: DataFrame) -> DataFrame:
        term = Window.partitionBy("lang", "digest", "split")
        both = counts.withColumn("n_lang", F.sum("n").over(term)).withColumn("docs_lang", F.sum("docs").over(term))
        return both.where(F.col("docs_lang") >= least).select("lang", "source", "digest", "split", "n", "n_lang")

    kept = materialise(enough(term_counts(rows, bits).withColumn("split", F.lit(""))), "kept")
    ends = materialise(extremes(rows, kept, bits), "ends")
    collided = ends.where("low <> high")
    if collided.limit(1).count():
        exact = enough(counts_by_string(rows, collided, bits))
        kept = materialise(kept.join(collided, ["lang", "digest"], "left_anti").select(*kept.columns).unionByName(exact), "kept")
    return kept, ends.where("low = high").select("lang", "digest", F.col("low").alias("term"))


def probability(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms))`` in exact arithmetic."""
    wide = "decimal(28,0)"
    top = (count.cast(wide) + SMOOTH) * F.lit(SCALE).cast("decimal(10,0)")
    below = total.cast(wide) + terms.cast(wide) * SMOOTH
    return (F.call_function("div", top, below) + 1).cast("long")


def pair_sums(near: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value): summed differences of two sources' probabilities over all kept terms, by source numbers.

    ``near``: (lang, digest, split, i, p), one row where a term occurs; ``groups``: (lang, i, p0, v, sources), where p0 is the
    probability of a term that does not occur.  Terms are dealt in parts and sources in tiles; a task holds a few million
    probabilities and gives one row per pair of its tile.
    """
    parts = F.greatest(F.ceil(F.col("v") / PART_TERMS), F.lit(1))
    tiles = F.sequence(F.lit(0), ((F.col("sources") - 1) / TILE).cast("int"))
    dealt = groups.select("lang", "i", "p0", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))).alias("part"), tiles.alias("tiles"))
    dealt = dealt.select("lang", "i", "p0", "part", F.explode("tiles").alias("tile"))
    langs = groups.groupBy("lang").agg(F.first(parts).alias("parts"), F.first(tiles).alias("tiles"))
    part = F.pmod(F.xxhash64("digest", "split"), F.col("parts")).cast("int")
    rows = near.join(checked_broadcast(langs), "lang").select("lang", "digest", "split", "i", "p", part.alias("part"), F.explode("tiles").alias("tile"))

    def sums(terms: pa.Table, all_sources: pa.Table) -> pa.Table:
        all_sources = all_sources.sort_by("i")
        p0 = all_sources["p0"].to_numpy()
        s, tile = len(p0), all_sources["tile"][0].as_py()
        mine = np.arange(tile * TILE, min((tile + 1) * TILE, s))
        total = np.zeros((len(mine), s), np.int64)
        terms = terms.sort_by([("digest", "ascending"), ("split", "ascending")])
        d, split = terms["digest"].to_numpy(), np.array(terms["split"].to_pylist(), object)
        term = np.cumsum(np.append(True, (d[1:] != d[:-1]) | (split[1:] != split[:-1]))) - 1 if len(d) else np.zeros(0, np.int64)
        i, p = terms["i"].to_numpy(), terms["p"].to_numpy()
        step = max(1, (1 << 21) // s)
        for a in range(0, int(term[-1]) + 1 if len(term) else 0, step):
            lo, hi = np.searchsorted(term, [a, a + step])
            dense = np.tile(p0[:, None], (1, min(step, int(term[-1]) + 1 - a)))
            dense[i[lo:hi], term[lo:hi] - a] = p[lo:hi]
            for row, m in enumerate(mine):
                total[row] += np.abs(dense - dense[m]).sum(1)
        other = mine[:, None] != np.arange(s)
        a, b = np.nonzero(other)
        lang = all_sources["lang"][0].as_py()
        return pa.table([pa.array([lang] * len(a), pa.string()), pa.array(mine[a].astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[other])], ["lang", "a", "b", "value"])

    key = ["lang", "part", "tile"]
    each = dealt.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(lambda g, t: sums(t, g), "lang string, a int, b int, value long")
    return each.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCS, top: int = TOP, bits: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank) per source of a language.

    ``pair`` rows: every other source of the language by the summed difference of all kept terms' probabilities.  ``term`` rows:
    up to ``top`` terms that are more probable in the source than in its language, by the difference.  Ties go
    to the item that comes first in UTF-8.  Null language, source or text is empty; a group without terms, or a language
    without kept terms, has its pairs with value 0 where nothing differs.  Repeated rows count as often as they are there; an
    empty table gives no row; other columns are not read.  ``bits`` of the digest are for tests of colliding terms.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))]
    rows = docs.select(*named)
    kept, words = kept_terms(rows, least, bits)
    size = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    terms = kept.select("lang", "digest", "split").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    number = Window.partitionBy("lang").orderBy("source")
    groups = rows.select("lang", "source").distinct().join(size, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0, ["n", "v"])
    groups = groups.withColumn("i", F.row_number().over(number) - 1).withColumn("sources", F.count(F.lit(1)).over(Window.partitionBy("lang")))
    groups = groups.withColumn("total", F.sum("n").over(Window.partitionBy("lang")))
    p0 = F.when(F.col("v") > 0, probability(F.lit(0), F.col("n"), F.col("v"))).otherwise(F.lit(0).cast("long"))
    groups = materialise(groups.withColumn("p0", p0), "groups")
    known = checked_broadcast(groups.select("lang", "source", "i", "v", "total", F.col("n").alias("size")))
    p, q = probability(F.col("n"), F.col("size"), F.col("v")), probability(F.col("n_lang"), F.col("total"), F.col("v"))
    near = materialise(kept.join(known, ["lang", "source"]).select("lang", "source", "i", "digest", "split", p.alias("p"), q.alias("q")), "near")
    name = groups.select("lang", "i", "source")
    pairs = pair_sums(near, groups).join(checked_broadcast(name.select("lang", F.col("i").alias("a"), "source")), ["lang", "a"])
    pairs = pairs.join(checked_broadcast(name.select("lang", F.col("i").alias("b"), F.col("source").alias("item"))), ["lang", "b"])
    own = Window.partitionBy("lang", "source")
    first = own.orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(first))
    over = near.where("p > q").select("lang", "source", "digest", "split", (F.col("p") - F.col("q")).alias("value"))
    best = over.withColumn("rank", F.rank().over(own.orderBy(F.desc("value")))).where(F.col("rank") <= top).drop("rank")
    written = best.join(words, ["lang", "digest"], "left").select("lang", "source", F.lit("term").alias("part"), F.coalesce("term", "split").alias("item"), "value")
    written = written.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    return pairs.unionByName(written)


@query(
    "op13_late_strings",
    rf"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= {LEAST_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
c AS (SELECT w.lang, source, w.term, count(*) AS c FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
n AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
p AS (SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c,
  1 + ({SCALE}::HUGEINT * (coalesce(c.c, 0) + {SMOOTH})) // (n.n + {SMOOTH} * v.v) AS p,
  1 + ({SCALE}::HUGEINT * (k.c + {SMOOTH})) // (v.n + {SMOOTH} * v.v) AS q
  FROM n JOIN v ON n.lang = v.lang JOIN k ON n.lang = k.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN
  (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {TOP}""",
)
def op13(spark, sf):
    return audit(table(spark, sf, "documents").select("lang", "source", "text"))
