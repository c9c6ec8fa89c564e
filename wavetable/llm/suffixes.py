"""Removal of repeated byte strings with a Burrows-Wheeler transform and threshold-bounded interval expansion.

A text is parsed at anchors, places whose next bytes hash to 0.  Every string of ``length`` bytes
(a *window*) is attached to its first anchor, and windows whose start lies at most ``REACH`` bytes before a place at or
ahead of it share a *core*, the bytes that all of them contain.  Equal windows have equal anchors and cores:

1. cores seen once cannot hold a repeated window and go no further;
2. a stretch of windows (a core with what lies beside it) that occurs twice as a whole is repeated as a whole;
3. the rest, the ends of repeated regions, is decided byte by byte.  Stretches of one core are written with
   the core as one symbol, and a transform of the stretches is expanded backwards breadth first: the positions
   where two neighbouring suffixes part are derived in order of their common length, up to the length of a window.  An interval
   of that length with two occurrences is a repeated window.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.llm.blocks import ASKED, LAST, Block, answer, answers, ask, blocked, carried, elsewhere, mix
from wavetable.llm.common import query, table

LENGTH = 200
REACH = 32
ANCHOR = 8  # bytes of an anchor
RATE_BITS = 4  # one place in 2 ** RATE_BITS is an anchor
BLOCK_BYTES = 4 << 20
RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


class Stretches:
    """The stretches of a block: windows ``lo`` to ``hi`` around the core that starts at ``s``."""

    def __init__(self, b: Block, length: int):
        raw, core = b.raw, length - REACH
        n = len(raw)
        padded = np.append(raw, np.zeros(8, np.uint8))
        lanes = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (n,), (1,))
        anchor = ((lanes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - RATE_BITS)) == 0
        last = b.start + b.length - length  # last window of each row
        rows = np.flatnonzero(last >= b.start)
        first, last = b.start[rows], last[rows]
        # the first anchor at or behind each window's start; a window without one is its own place
        places = np.flatnonzero(anchor)
        lo, hi, s = [], [], []
        a, z = np.searchsorted(places, first), np.searchsorted(places, last, "right")
        # gaps between anchors: windows in (previous anchor, anchor]; the first gap starts at the row, the last ends at its last window
        count = z - a + 1
        row = np.repeat(np.arange(len(rows)), count)
        k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at = a[row] + k
        begin = np.where(k == 0, first[row], places[np.maximum(at - 1, 0)] + 1 if len(places) else 0)
        stop = np.where(at < len(places), places[np.minimum(at, len(places) - 1)] if len(places) else n, n + length)
        end = np.minimum(stop, last[row])
        # windows whose first anchor lies beyond their own bytes have none
        bare_end = np.minimum(end, stop - (length - ANCHOR) - 1)
        for x, y in zip(begin[bare_end >= begin], bare_end[bare_end >= begin], strict=True):
            own = np.arange(x, y + 1)
            lo.append(own), hi.append(own), s.append(own)
        begin = np.maximum(begin, bare_end + 1)
        ok = begin <= end
        begin, end, stop = begin[ok], end[ok], stop[ok]
        # classes of REACH windows, counted backwards from the anchor
        c0, c1 = (stop - end) // REACH, (stop - begin) // REACH
        each = np.repeat(np.arange(len(begin)), c1 - c0 + 1)
        cls = c0[each] + np.arange(len(each)) - np.repeat(np.cumsum(c1 - c0 + 1) - (c1 - c0 + 1), c1 - c0 + 1)
        place = stop[each] - cls * REACH
        s.append(place)
        lo.append(np.maximum(place - REACH + 1, begin[each]))
        hi.append(np.minimum(place, end[each]))
        self.lo, self.hi, self.s = (np.concatenate(x).astype(np.int64) for x in (lo, hi, s))
        order = np.argsort(self.lo, kind="stable")
        self.lo, self.hi, self.s = self.lo[order], self.hi[order], self.s[order]
        self.length, self.core = length, core
        power = np.full(n + 1, _BASE, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * power[:n], out=sums[1:])
        power[1:] = _INVERSE
        self.sums, self.shift = sums, np.multiply.accumulate(power, out=power)
        self.raw = raw

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of the bytes of each range, and of its size."""
        h = (self.sums[end] - self.sums[begin]) * self.shift[begin]
        return mix(h + (end - begin).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def cores(self) -> np.ndarray:
        return self.hashes(self.s, self.s + self.core)

    def wholes(self, on: np.ndarray) -> np.ndarray:
        return self.hashes(self.lo[on], self.hi[on] + self.length)


def expand(text: np.ndarray, sentinel: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a text and, for each position of it, the interval of suffixes with ``threshold`` common symbols.

    ``text``: symbols from 0; those below ``sentinel`` end a string and differ from each other.  The transform is expanded backwards
    breadth first.  At level l an interval holds the suffixes with l common symbols; a position
    begins a new interval at level l + 1 if its first symbol differs from its neighbour's, or if the suffixes behind
    the first symbols were in different intervals at level l.  Only positions that are not parted yet are
    looked at, so common prefixes come out by increasing length and expansion stops at the threshold.
    """
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        behind = np.append(rank[step:], np.zeros(min(step, n), np.int64) - 1)[:n]
        key = rank * (n + 1) + behind + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.cumsum(np.append(0, sorted_key[1:] != sorted_key[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        step *= 2
    # psi: the position of the suffix behind the first symbol (the inverse of the backward step)
    psi = np.append(rank[1:], 0)[order]
    head = text[order]
    parted = np.ones(n, bool)
    parted[1:] = (head[1:] != head[:-1]) | (head[1:] < sentinel)
    interval = np.cumsum(parted)
    for _ in range(1, threshold):
        open_ = np.flatnonzero(~parted)
        if not len(open_):
            break
        now = open_[interval[psi[open_]] != interval[psi[open_ - 1]]]
        parted[now] = True
        interval = np.cumsum(parted)
    return order, interval


def repeated_windows(core: np.ndarray, tail: np.ndarray, tails: np.ndarray, head: np.ndarray, heads: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each stretch a bit per window (bit d: the window that starts d bytes before the core) that occurs twice.

    ``tail``/``head``: the bytes before (right aligned) and behind the core, ``tails``/``heads`` their
    numbers; ``many``: whether the stretch itself occurs more than once.
    """
    m = len(core)
    width = tail.shape[1] + 1 + head.shape[1] + 1
    symbol = np.unique(core, return_inverse=True)[1]
    grid = np.full((m, width), -1, np.int64)
    shift = m  # ends of strings are 0 .. m - 1, bytes follow, then cores
    grid[:, : tail.shape[1]] = tail.astype(np.int64) + shift
    grid[:, tail.shape[1]] = symbol + shift + 256
    grid[:, tail.shape[1] + 1 : -1] = head.astype(np.int64) + shift
    grid[:, -1] = np.arange(m)
    used = np.ones((m, width), bool)
    used[:, : tail.shape[1]] = np.arange(tail.shape[1]) >= tail.shape[1] - tails[:, None]
    used[:, tail.shape[1] + 1 : -1] = np.arange(head.shape[1]) < heads[:, None]
    text, owner = grid[used], np.repeat(np.arange(m), used.sum(1))
    column = np.broadcast_to(np.arange(width), (m, width))[used]
    threshold = REACH + 1
    order, interval = expand(text, m, threshold)
    # suffixes that are windows: they start at the core or in its tail and have enough symbols before the end
    d = tail.shape[1] - column[order]
    who = owner[order]
    window = (d >= 0) & (REACH - d <= heads[who])
    weight = np.bincount(interval[window], weights=1 + many[who[window]], minlength=interval[-1] + 1)
    yes = window & (weight[interval] > 1)
    out = np.zeros(m, np.uint32)
    np.bitwise_or.at(out, who[yes], np.uint32(1) << d[yes].astype(np.uint32))
    return out


FINE = np.dtype([("core", "u8"), ("tails", "u1"), ("heads", "u1"), ("many", "u1"), ("tail", "u1", (REACH - 1,)), ("head", "u1", (REACH,))])


def _fine(low: np.ndarray, _block: np.ndarray, e: np.ndarray) -> np.ndarray:
    kinds = ["core", "tails", "heads", "tail", "head"]
    plain = np.empty(len(e), [(k, FINE[k]) for k in kinds])
    for k in kinds:
        plain[k] = e[k]
    _, at, back, n = np.unique(plain.view(f"V{plain.dtype.itemsize}"), return_index=True, return_inverse=True, return_counts=True)
    many = (n > 1) | (np.bincount(back, weights=e["many"]) > 0)
    one = e[at]
    return repeated_windows(one["core"], one["tail"], one["tails"], one["head"], one["heads"], many)[back]


def _stretch(low: np.ndarray, _block: np.ndarray, e: np.ndarray) -> np.ndarray:
    """1: the stretch occurs elsewhere as a whole; 2: a stretch with the same core may not.

    ``e``: hash of the stretch; its last bit says that its block has it twice.
    """
    order = np.lexsort((e, low))
    c, w, many = low[order], e[order] | np.uint64(1), (e[order] & np.uint64(1)).astype(bool)
    near = (c[1:] == c[:-1]) & (w[1:] == w[:-1])
    whole = np.append(False, near) | np.append(near, False)
    group = np.cumsum(np.append(True, c[1:] != c[:-1])) - 1
    lone = np.bincount(group, weights=~whole & ~many) > 0
    out = np.empty(len(e), np.uint8)
    out[order] = whole + 2 * lone[group]
    return out


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, texts: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: key, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, if wanted, ``kept`` (bytes).

    A byte goes if a string of ``length`` bytes that covers it starts at another place too, in any row; removed
    bytes may cut a character, so ``kept`` is binary.  A null text is empty; texts shorter than
    ``length`` stay.  Repeated rows are other places: both go.
    """
    if length < 2 * REACH + ANCHOR:
        raise ValueError("the length is too short for the parse")
    base, blocks = blocked(docs, key, text, block_bytes)

    def send_cores(t: pa.Table) -> pa.Table:
        b = Block(t)
        return ask(b.number, np.unique(Stretches(b, length).cores()), blocks)

    def candidates(x: Stretches, bits: bytes | None, told: pa.Table | None = None):
        """Stretches whose core is repeated, their distinct kinds (core, stretch), and which kinds the block has twice."""
        cores, index, n = np.unique(x.cores(), return_inverse=True, return_counts=True)
        twice = (answers(told, cores, blocks) | (n > 1)) if bits is None else np.unpackbits(np.frombuffer(bits, np.uint8), count=len(cores)).astype(bool)
        on = np.flatnonzero(twice[index])
        core, whole = cores[index[on]], x.wholes(on) | np.uint64(1)
        order = np.lexsort((whole, core))
        c, w = core[order], whole[order]
        begin = np.append(True, (c[1:] != c[:-1]) | (w[1:] != w[:-1])) if len(on) else np.zeros(0, bool)
        kind = np.empty(len(on), np.int64)
        kind[order] = np.cumsum(begin) - 1
        many = np.bincount(kind, minlength=int(begin.sum())) > 1
        return on, kind, c[begin], w[begin], many, np.packbits(twice).tobytes()

    def send_wholes(t: pa.Table, told: pa.Table) -> pa.Table:
        if not len(t):
            return ask(-1, np.zeros(0, np.uint64), blocks)
        b = Block(t)
        _, _, core, whole, many, bits = candidates(Stretches(b, length), None, told)
        return ask(b.number, core, blocks, np.where(many, whole, whole & ~np.uint64(1)), bits)

    def send_fine(t: pa.Table, told: pa.Table) -> pa.Table:
        if not len(t):
            return ask(-1, np.zeros(0, np.uint64), blocks)
        b = Block(t)
        x = Stretches(b, length)
        bits = carried(told)
        on, kind, core, _, many, _ = candidates(x, bits)
        code = answers(told, core, blocks, np.uint8)
        whole, look = many | (code & 1).astype(bool), (code & 2).astype(bool)
        sent = np.flatnonzero(look)
        example = np.zeros(len(core), np.int64)
        example[kind] = on
        i = example[sent]
        e = np.zeros(len(sent), FINE)
        e["core"], e["many"] = core[sent], many[sent]
        e["tails"], e["heads"] = x.s[i] - x.lo[i], x.hi[i] - x.s[i] + REACH
        raw = np.concatenate([np.zeros(REACH, np.uint8), x.raw, np.zeros(length + REACH, np.uint8)])
        j = np.arange(REACH)
        e["tail"] = np.where(j[1:] >= REACH - e["tails"][:, None], raw[x.s[i][:, None] + j[1:]], 0)
        e["head"] = np.where(j < e["heads"][:, None], raw[(x.s[i] + x.core + REACH)[:, None] + j], 0)
        state = pickle.dumps((bits, np.packbits(whole), np.packbits(look)))
        return ask(b.number, core[sent], blocks, e, state)

    def keep(t: pa.Table, told: pa.Table) -> pa.Table:
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * texts
        if not len(t):
            return pa.table([pa.array([], k) for k in kinds[: len(names)]], names)
        b = Block(t)
        x = Stretches(b, length)
        state, whole, look = pickle.loads(carried(told))
        on, back, core, *_ = candidates(x, state)
        whole, look = (np.unpackbits(v, count=len(core)).astype(bool) for v in (whole, look))
        bits = np.zeros(len(core), np.uint32)
        bits[look] = answers(told, core[look], blocks, np.uint32)
        depth = np.zeros(len(b.raw) + length + 2, np.int32)
        full = on[whole[back]]
        np.add.at(depth, x.lo[full], 1)
        np.add.at(depth, x.hi[full] + length, -1)
        part = ~whole[back]
        for d in range(REACH):
            i = on[part & ((bits[back] >> np.uint32(d)) & np.uint32(1)).astype(bool)]
            np.add.at(depth, x.s[i] - d, 1)
            np.add.at(depth, x.s[i] - d + length, -1)
        gone = np.cumsum(depth)[: len(b.raw)] > 0
        rise = np.append(0, np.cumsum(np.diff(gone.astype(np.int8), prepend=np.int8(0)) == 1))
        lost = np.append(0, np.cumsum(gone))
        end = b.start + b.length
        data = b.raw[~gone].tobytes()
        begin_at, end_at = b.start - lost[b.start], end - lost[end]
        parts = [data[p:q] for p, q in zip(begin_at, end_at, strict=True)]
        out = [b.id, b.length, lost[end] - lost[b.start], rise[end] - rise[b.start]]
        shas = pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())
        return pa.table([*map(pa.array, out), shas] + [pa.array(parts, pa.binary())] * texts, names)

    once = answer(base.groupBy("block").applyInArrow(send_cores, ASKED), elsewhere)
    wholes = answer(base.groupBy("block").cogroup(once.groupBy("block")).applyInArrow(send_wholes, ASKED), _stretch, "u8")
    fine = answer(base.groupBy("block").cogroup(wholes.groupBy("block")).applyInArrow(send_fine, ASKED), _fine, FINE)
    out = base.groupBy("block").cogroup(fine.groupBy("block")).applyInArrow(keep, RESULT + ", kept binary" * texts)
    return out.select(F.when(F.col("id") != LAST, F.col("id")).alias(key), *[c for c in out.columns if c != "id"])


@query("op9_bwt_expansion")
def op9(spark, sf):
    return remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
