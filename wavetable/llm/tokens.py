"""Token counts by field and section: encode a whole document once, then attribute its tokens by their spans.

The byte-level vocabulary splits a text's UTF-8 bytes without rest, so the running sum of the tokens' byte
lengths gives every token's span.  Sections are spans too; sorted spans are joined by binary search.  A token
that crosses a border goes by an explicit rule:

``start``  to the section of its first byte
``most``   to the section with most of its bytes, the earlier one on a tie
``share``  to every section it touches, in proportion to the bytes there
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.llm.common import query, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-split pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = 1 << 20
RULES = ("start", "most", "share")


@functools.lru_cache(4)
def encoding(path: str, pattern: str):
    """The tokenizer and the byte length of each id; read once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def spread(starts: np.ndarray, lengths: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens per section.

    ``borders``: where each section starts, ascending; the last one ends where the tokens end.
    """
    first = np.searchsorted(borders, starts, "right") - 1
    last = np.searchsorted(borders, starts + np.maximum(lengths, 1) - 1, "right") - 1
    n = len(borders)
    cross = first != last
    crossing = np.bincount(first[cross], minlength=n)
    if rule == "start":
        return np.bincount(first, minlength=n).astype(float), crossing
    counts = np.bincount(first[~cross], minlength=n).astype(float)
    edge = np.append(borders, np.iinfo(np.int64).max)
    for s, size, a, b in zip(starts[cross], lengths[cross], first[cross], last[cross], strict=True):
        part = np.minimum(edge[a + 1 : b + 2], s + size) - np.maximum(edge[a : b + 1], s)
        if rule == "share":
            counts[a : b + 1] += part / size
        else:
            counts[a + int(part.argmax())] += 1
    return counts, crossing


def attribute(docs: DataFrame, key: str = "doc_id", fields: tuple[str, ...] = ("text",), rule: str = "most", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """One row per document, field and section (line, with its line feed).

    The fields of a document are joined by line feeds and encoded as one text; the joining line feed is the end of
    the field before it.  Columns: key, ``field``, ``section`` (from 0 in each field), ``start`` and ``end``
    (characters of the field), ``n_tokens`` and ``n_crossing`` (tokens that start in the section and end
    behind it).  ``n_tokens`` is fractional under ``share`` only; over a document it sums to the length of
    its encoding under every rule.  A null field counts as empty; an empty field has one empty section.
    Repeated rows each give their own sections; an empty table gives none.  ``vocabulary`` is a path that
    every executor can open.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    fields = tuple(fields)
    picked = docs.select(F.col(key).alias("k"), *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"f{i}") for i, f in enumerate(fields)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sizes = encoding(vocabulary, pattern)

        def chunk(keys: pa.Array, rows: list[tuple[str, ...]]) -> pa.RecordBatch:
            texts = ["\n".join(r) for r in rows]
            tokens = [np.asarray(encode.encode_ordinary(t), np.int64) for t in texts]
            lengths = sizes[np.concatenate(tokens)] if tokens else np.zeros(0, np.int64)
            raw = np.frombuffer("".join(texts).encode(), np.uint8)
            # where each field starts, in bytes; an empty text has a section of no bytes, so places repeat
            parts = [len(f.encode()) + (i + 1 < len(r)) for r in rows for i, f in enumerate(r)]
            ends = np.cumsum(parts, dtype=np.int64)
            begins = ends - parts
            lines = np.flatnonzero(raw == 10) + 1
            inner = lines[~np.isin(lines, ends)]  # a line feed at the end of a field opens no section
            owner = np.searchsorted(ends, inner, "right")
            borders = np.concatenate([begins, inner])
            owners = np.concatenate([np.arange(len(parts)), owner])
            order = np.lexsort((borders, owners))
            borders, owners = borders[order], owners[order]
            filled = np.append(borders[1:], len(raw)) > borders
            counts, crossing = np.zeros(len(borders)), np.zeros(len(borders), np.int64)
            if filled.any():
                counts[filled], crossing[filled] = spread(np.cumsum(lengths) - lengths, lengths, borders[filled], rule)
            chars = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
            opens = np.r_[True, owners[1:] != owners[:-1]] if len(owners) else np.zeros(0, bool)
            at = np.flatnonzero(opens)[np.cumsum(opens) - 1]
            limit = np.append(borders[1:], len(raw))
            return pa.record_batch(
                [
                    keys.take(pa.array(owners // len(fields))),
                    pa.array([fields[i] for i in owners % len(fields)], pa.string()),
                    pa.array((np.arange(len(owners)) - at).astype(np.int32)),
                    pa.array(chars[borders] - chars[borders[at]]),
                    pa.array(chars[limit] - chars[borders[at]]),
                    pa.array(counts),
                    pa.array(crossing),
                ],
                ["key", "field", "section", "start", "end", "n_tokens", "n_crossing"],
            )

        for b in batches:
            columns = [b[f"f{i}"].to_pylist() for i in range(len(fields))]
            rows, start, size = list(zip(*columns, strict=True)), 0, 0
            for i, r in enumerate(rows):
                size += sum(map(len, r))
                if size >= CHUNK or i + 1 == len(rows):
                    yield chunk(b["k"].slice(start, i + 1 - start), rows[start : i + 1])
                    start, size = i + 1, 0

    kind = picked.schema["k"].dataType.simpleString()
    out = picked.mapInArrow(count, f"key {kind}, field string, section int, start long, end long, n_tokens double, n_crossing long")
    return out.withColumnRenamed("key", key)


@query("op5_offset_tokens")
def op5(spark, sf):
    counted = attribute(table(spark, sf, "documents"))
    return counted.select("doc_id", "field", "section", "start", "end", F.col("n_tokens").cast("long").alias("n_tokens"), "n_crossing")
