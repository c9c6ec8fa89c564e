"""Removal of repeated token spans with a compacted de Bruijn graph.

Every window of ``k`` words is an edge between its first and last k - 1 words.  Edges seen once cannot
repeat, so only those that occur twice (*solid* edges) form the graph.  An edge is *plain* if all
occurrences have the same word before and behind (a border of the document is a word of its own); plain
neighbours are always walked together, so a run of them is a nonbranching path and is compacted into one.
Paths then meet in Spark joins: a path is named by a digest of its words, which verifies it against the source,
its coordinates say where each document walks it, and the smallest document owns it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.llm.blocks import ASKED, LAST, Block, answer, answers, ask, blocked, carried, elsewhere, mix
from wavetable.llm.common import query, table

WORDS = 13
SALTS, BLOCKS_PER_SALT = 8, 128  # least number of parts of a path's walks, and blocks of text for each
MIXED = np.uint64(0)  # the tag of an edge whose neighbours already differ inside one block
PATHS = "path binary, block int, row int, first int, n int, id long"
SPANS = "block int, row int, first int, n int"
RESULT = "id long, n_words long, n_removed long, kept_sha256 string"


def _edges(b: Block, k: int):
    """Hash and place of all edges, the distinct ones, and each edge's index among them."""
    b.words()
    wh = b.word_hashes()
    h, at = b.windows(wh, k)
    distinct, index = np.unique(h, return_inverse=True)
    return wh, h, at, distinct, index


def _sides(b: Block, wh: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """A tag of the words before and behind each edge."""
    border = np.uint64(0x243F6A8885A308D3)
    before = np.where(at > b.w0[b.wd[at]], wh[np.maximum(at - 1, 0)], border)
    last = b.w0[b.wd[at]] + b.wn[b.wd[at]] - 1
    behind = np.where(at + k - 1 < last, wh[np.minimum(at + k, len(wh) - 1)], border)
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + behind) | np.uint64(1)


def paths(base: DataFrame, blocks: int, k: int) -> DataFrame:
    """Occurrences of compacted paths: digest, block, row in the block, first word in the row, words, id."""

    def send_edges(t: pa.Table) -> pa.Table:
        b = Block(t)
        return ask(b.number, _edges(b, k)[3], blocks)

    def send_sides(t: pa.Table, told: pa.Table) -> pa.Table:
        if not len(t):
            return ask(-1, np.zeros(0, np.uint64), blocks, np.zeros(0, np.uint64))
        b = Block(t)
        wh, _, at, distinct, index = _edges(b, k)
        solid = answers(told, distinct, blocks) | (np.bincount(index, minlength=len(distinct)) > 1)
        tag = _sides(b, wh, at, k)
        low, high = np.full(len(distinct), np.uint64(2**64 - 1)), np.zeros(len(distinct), np.uint64)
        np.minimum.at(low, index, tag)
        np.maximum.at(high, index, tag)
        return ask(b.number, distinct[solid], blocks, np.where(low == high, low, MIXED)[solid], np.packbits(solid).tobytes())

    def one_tag(low: np.ndarray, _block: np.ndarray, tag: np.ndarray) -> np.ndarray:
        order = np.lexsort((tag, low))
        s, t = low[order], tag[order]
        begin = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        end = np.append(begin[1:], len(s)) - 1
        plain = (t[begin] == t[end]) & (t[begin] != MIXED)
        out = np.empty(len(low), bool)
        out[order] = np.repeat(plain, end - begin + 1)
        return out

    def walk(t: pa.Table, told: pa.Table) -> pa.Table:
        schema = pa.schema([("path", pa.binary()), ("block", pa.int32()), ("row", pa.int32()), ("first", pa.int32()), ("n", pa.int32()), ("id", pa.int64())])
        if not len(t):
            return schema.empty_table()
        b = Block(t)
        _, _, at, distinct, index = _edges(b, k)
        solid = np.unpackbits(np.frombuffer(carried(told), np.uint8), count=len(distinct)).astype(bool)
        plain = np.zeros(len(distinct), bool)
        plain[solid] = answers(told, distinct[solid], blocks)
        on = np.flatnonzero(solid[index])
        place, straight = at[on], plain[index[on]]
        cut = np.ones(len(on), bool)
        cut[1:] = (place[1:] != place[:-1] + 1) | (b.wd[place[1:]] != b.wd[place[:-1]]) | ~straight[1:] | ~straight[:-1]
        begin = np.flatnonzero(cut)
        first, words = place[begin], np.diff(np.append(begin, len(on))) + k - 1
        row = b.wd[first] if len(first) else first
        raw = b.raw.tobytes()
        digest = [hashlib.md5(b" ".join(raw[x:y].split()), usedforsecurity=False).digest() for x, y in zip(b.ws[first], b.we[first + words - 1], strict=True)]
        return pa.table(
            [
                pa.array(digest, pa.binary()), pa.array(np.full(len(first), b.number, np.int32)), pa.array(row.astype(np.int32)),
                pa.array((first - b.w0[row]).astype(np.int32)), pa.array(words.astype(np.int32)), pa.array(b.id[row]),
            ],
            schema=schema,
        )

    solid = answer(base.groupBy("block").applyInArrow(send_edges, ASKED), elsewhere)
    sides = base.groupBy("block").cogroup(solid.groupBy("block")).applyInArrow(send_sides, ASKED)
    plain = answer(sides, one_tag, "u8")
    return base.groupBy("block").cogroup(plain.groupBy("block")).applyInArrow(walk, PATHS)


def repeated_spans(walked: DataFrame, salts: int) -> DataFrame:
    """Walks of a path that a smaller document walks too.

    Walks are dealt by path and salt once; owners are pre-aggregated from that deal (with the place of the
    owner's walk, so both readers need the same columns and Spark reuses the shuffle) and meet the walks in as many
    parts as ``salts``, which grows with the text: a path that a third of all documents walk is no single task's work.  Only salts that
    hold walks of a path get its owner.
    """
    salted = walked.withColumn("salt", F.pmod(F.xxhash64("block", "row", "first"), F.lit(salts)).cast("int"))
    # the filter is the one the join below implies; stated here, both readers share it
    salted = salted.where("path is not null and salt is not null and id is not null").repartition("path", "salt")
    held = salted.groupBy("path", "salt").agg(F.min(F.struct("id", "block", "row", "first", "n")).alias("owner"), F.max("id").alias("last"))
    owners = held.groupBy("path").agg(F.min("owner").alias("owner"), F.max("last").alias("last"), F.collect_list("salt").alias("salts")).where("owner.id < last")
    owners = owners.select("path", F.col("owner.id").alias("owner"), F.explode("salts").alias("salt"))
    return salted.join(owners, ["path", "salt"]).where("id > owner").select("block", "row", "first", "n")


def remove_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, texts: bool = False) -> DataFrame:
    """One row per row of ``docs``: key, ``n_words``, ``n_removed``, ``kept_sha256`` and, if wanted, ``kept`` (words joined by a space).

    Words are runs of bytes other than space and U+0009 to U+000D.  A word goes if a window of ``k`` words
    that covers it also starts in a document with a smaller key.  Null and short texts have no window and stay;
    rows with equal keys are one document as far as owners go, each row being judged by itself; a null
    key comes after all others.
    """
    base, blocks = blocked(docs, key, text)
    spans = repeated_spans(paths(base, blocks, k), max(SALTS, blocks // BLOCKS_PER_SALT))

    def keep(t: pa.Table, told: pa.Table) -> pa.Table:
        names = ["id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * texts
        if not len(t):
            return pa.table([pa.array([], x) for x in (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())[: len(names)]], names)
        b = Block(t)
        b.words()
        depth = np.zeros(len(b.ws) + 1, np.int32)
        first = b.w0[told["row"].to_numpy()] + told["first"].to_numpy()
        np.add.at(depth, first, 1)
        np.add.at(depth, first + told["n"].to_numpy(), -1)
        kept = np.cumsum(depth)[:-1] == 0
        n = np.bincount(b.wd[kept], minlength=len(b.start))
        # bytes of the kept words, each with one byte behind it that becomes a space
        size = b.we[kept] - b.ws[kept] + 1
        ends = np.cumsum(size)
        mark = np.zeros(len(b.raw) + 2, np.int8)
        np.add.at(mark, b.ws[kept], 1)
        np.add.at(mark, b.we[kept] + 1, -1)
        chosen = np.append(b.raw, np.uint8(32))[np.cumsum(mark[: len(b.raw) + 1]).astype(bool)]
        chosen[ends - 1] = 32
        upto = np.append(0, ends)[np.append(0, np.cumsum(n))]
        data = chosen.tobytes()
        parts = [data[x : max(x, y - 1)] for x, y in zip(upto[:-1], upto[1:], strict=True)]
        out = [pa.array(b.id), pa.array(b.wn), pa.array(b.wn - n), pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())]
        return pa.table(out + [pa.array([p.decode() for p in parts], pa.string())] * texts, names)

    out = base.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(keep, RESULT + ", kept string" * texts)
    return out.select(F.when(F.col("id") != LAST, F.col("id")).alias(key), *[c for c in out.columns if c != "id"])


@query("op8_de_bruijn")
def op8(spark, sf):
    return remove_spans(table(spark, sf, "documents").select("doc_id", "text"))
