"""Texts in blocks of bounded size, and an exchange of fingerprints between blocks.

A block is a hash share of the rows with about ``BLOCK_BYTES`` of text.  A pass over the blocks can ask about its
fingerprints (64-bit hashes): each block sends its distinct ones to buckets by their upper bits, a
bucket compares what all blocks sent, and every block gets one answer per fingerprint, in the order it
sent them.  A fingerprint that fills the corpus is sent once per block.  The number of blocks and buckets grows with
the text, the size of each does not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.llm.common import text_bytes

BLOCK_BYTES = 8 << 20
LAST = (1 << 63) - 1  # stands for a null id, which comes after all others
ASKED = "bucket int, block int, carried boolean, data binary"
ANSWERED = "block int, bucket int, carried boolean, data binary"
LONG_WORD = 1024

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (in place)."""
    h ^= h >> np.uint64(30)
    h *= _C2
    h ^= h >> np.uint64(27)
    h *= _C3
    h ^= h >> np.uint64(31)
    return h


def blocked(docs: DataFrame, key: str, text: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """Rows as (block, id, mark, text) and the number of blocks.

    ``id`` is the key (null: ``LAST``), ``mark`` a hash of the text that orders rows with equal keys.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = docs.agg(F.sum(text_bytes(text))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    marked = rows.withColumn("mark", F.xxhash64("text"))
    return marked.select(F.pmod(F.xxhash64("id", "mark"), F.lit(blocks)).cast("int").alias("block"), "id", "mark", "text"), blocks


class Texts:
    """Texts as one buffer with a space behind each; words and their hashes for all of them at once."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8) if texts else np.zeros(0, np.uint8)
        if lower:
            self.raw = _LOWER[self.raw]
        self.start = np.cumsum(self.length + 1) - self.length - 1

    def words(self, separator: np.ndarray = _SPACE) -> None:
        """``ws``, ``we``: first byte and end of each word; ``wd``: its row; ``w0``, ``wn``: first word and words of each row."""
        space = separator[self.raw]
        edge = np.diff(space.view(np.int8), prepend=np.int8(1), append=np.int8(1))
        self.ws, self.we = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.w0 = np.searchsorted(self.ws, self.start)
        self.wn = np.diff(np.append(self.w0, len(self.ws)))
        self.wd = np.repeat(np.arange(len(self.start)), self.wn)

    def word_hashes(self) -> np.ndarray:
        """64-bit hash of each word, eight bytes at a time."""
        raw = np.append(self.raw, np.zeros(8, np.uint8))
        lanes = np.lib.stride_tricks.as_strided(raw[:8].view("<u8"), (len(raw) - 7,), (1,))
        size = self.we - self.ws
        h = size.astype(np.uint64) * _C1
        for at in range(0, min(int(size.max(initial=0)), LONG_WORD), 8):
            on = np.flatnonzero(size > at) if at else slice(None)
            left = np.minimum(size[on] - at, 8)
            lane = lanes[self.ws[on] + at]
            lane &= np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - left) * 8).astype(np.uint64)
            lane ^= h[on]
            h[on] = mix(lane)
        for i in np.flatnonzero(size > LONG_WORD):
            h[i] = int.from_bytes(hashlib.blake2b(self.raw[self.ws[i] : self.we[i]].tobytes(), digest_size=8).digest(), "little")
        return h

    def windows(self, wh: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and place of each window of ``k`` words inside one row."""
        n = max(0, len(wh) - k + 1)
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h *= _C1
            h += wh[j : j + n]
        inside = np.flatnonzero(self.wd[:n] == self.wd[k - 1 : k - 1 + n]) if n else np.zeros(0, np.int64)
        return mix(h[inside]), inside


class Block(Texts):
    """The rows of one block in a fixed order."""

    def __init__(self, t: pa.Table, lower: bool = False):
        t = t.sort_by([("id", "ascending"), ("mark", "ascending")]) if len(t) > 1 else t
        self.number = t["block"][0].as_py() if len(t) else -1
        self.id = t["id"].to_numpy()
        super().__init__([x.as_py().encode() for x in t["text"]], lower)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def ask(block: int, hashes: np.ndarray, buckets: int, extra: np.ndarray | None = None, carry: bytes | None = None) -> pa.Table:
    """Send sorted hashes (their lower 32 bits) and a fixed-width ``extra`` for each to their buckets.

    ``carry`` comes back to the block as it is, with the answers.
    """
    bucket = _bucket(hashes, buckets)
    begin = np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets))) if len(hashes) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(hashes))[: len(begin)]
    low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    data = [low[a:b].tobytes() + (b"" if extra is None else extra[a:b].tobytes()) for a, b in zip(begin, end, strict=True)]
    to = bucket[begin].astype(np.int32)
    more = [] if carry is None else [carry]
    return pa.table(
        {
            "bucket": pa.array(np.append(to, [block % buckets] * len(more)).astype(np.int32)),
            "block": pa.array(np.full(len(data) + len(more), block, np.int32)),
            "carried": pa.array([False] * len(data) + [True] * len(more), pa.bool_()),
            "data": pa.array(data + more, pa.binary()),
        }
    )


def answer(asked: DataFrame, reply: Callable, extra: str | None = None) -> DataFrame:
    """In each bucket ``reply(low, block, extra)`` answers every fingerprint sent there: booleans or small integers.

    ``extra``: NumPy type of what came with the fingerprints.
    """

    def bucket(t: pa.Table) -> pa.Table:
        back = t.filter(t["carried"]).select(["block", "bucket", "carried", "data"]).combine_chunks()
        t = t.filter(pa.compute.invert(t["carried"])).combine_chunks()
        if not len(t):
            return back
        kind = np.dtype(extra or "V0")
        data = [x.as_py() for x in t["data"]]
        sizes = np.array([len(x) // (4 + kind.itemsize) for x in data])
        low = np.concatenate([np.frombuffer(x, np.uint32, n) for x, n in zip(data, sizes, strict=True)])
        more = np.concatenate([np.frombuffer(x, kind, n, 4 * n) for x, n in zip(data, sizes, strict=True)]) if extra else None
        said = reply(low, np.repeat(t["block"].to_numpy(), sizes), more)
        parts = np.split(said, np.cumsum(sizes)[:-1])
        out = [(np.packbits(x) if said.dtype == bool else x).tobytes() for x in parts]
        return pa.concat_tables([back, pa.table([t["block"], t["bucket"], t["carried"], pa.array(out, pa.binary())], back.schema.names).cast(back.schema)])

    return asked.groupBy("bucket").applyInArrow(bucket, ANSWERED)


def answers(t: pa.Table, hashes: np.ndarray, buckets: int, kind: type = bool) -> np.ndarray:
    """The answers of all buckets, aligned with the sorted hashes that were sent."""
    t = t.filter(pa.compute.invert(t["carried"])).sort_by("bucket")
    if not len(t):
        out = np.zeros(0, kind)
    else:
        bucket = _bucket(hashes, buckets)
        sizes = np.diff(np.searchsorted(bucket, np.append(t["bucket"].to_numpy(), buckets).astype(np.uint64)))
        if kind is bool:
            out = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n) for x, n in zip(t["data"], sizes, strict=True)]).astype(bool)
        else:
            out = np.concatenate([np.frombuffer(x.as_py(), kind) for x in t["data"]])
    if len(out) != len(hashes):
        raise RuntimeError("answers do not match what the block asked")
    return out


def carried(t: pa.Table) -> bytes:
    return t.filter(t["carried"])["data"][0].as_py()


def elsewhere(low: np.ndarray, block: np.ndarray, _extra=None) -> np.ndarray:
    """Yes for a fingerprint that more than one block sent."""
    order = np.argsort(low, kind="stable")
    s = low[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(low), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out
