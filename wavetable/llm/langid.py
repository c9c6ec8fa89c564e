"""Language identification with a bit-sliced Bloom filter over character n-grams.

Each slot of the filter holds one bit per language, so a single look-up answers for all languages which
of them contain an n-gram: the AND of its slots.  The bits are counted per language and document,
corrected for the false positives that the fill of the language's slice makes likely, and the largest count
wins.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from wavetable.llm.common import query, table

GRAM = 4
SLOTS = 1 << 21
PROBES = 2
SAMPLE_PER_LANGUAGE = 10_000  # labelled rows per language that the filter is fitted on, in expectation
MIN_SHARE = 0.05  # an n-gram belongs to a language if its rate there is at least this share of its largest rate
CHUNK = 1 << 20  # characters worked on at once
UNDECIDED = "und"


@functools.cache
def letters() -> np.ndarray:
    """Of each code point its lower-case letter, or a space if it is no letter."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the n-gram at each place, whether it has a letter, and where each text starts.

    Texts are framed by n - 1 spaces, so no n-gram has letters of two texts and a single letter has one.
    """
    pad = " " * (GRAM - 1)
    framed = pad + pad.join([*texts, ""])
    cp = letters()[np.frombuffer(framed.encode("utf-32-le", "surrogatepass"), np.uint32)]
    n = len(cp) - GRAM + 1
    h, has = np.zeros(n, np.uint64), np.zeros(n, bool)
    letter = cp != 32
    for j in range(GRAM):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += cp[j : j + n]
        has |= letter[j : j + n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts)) + GRAM - 1
    return h, has, np.cumsum(lengths) - lengths


def probes(h: np.ndarray) -> Iterator[np.ndarray]:
    for j in range(PROBES):
        yield (h >> np.uint64(64 - 21 * (j + 1))) & np.uint64(SLOTS - 1)


def chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about ``CHUNK`` characters together, with the index of the first."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


@dataclass
class Filter:
    """``slots[slot, word]``: the bits of eight languages; ``false``: the chance that a slice says yes to any n-gram."""

    languages: list[str]
    slots: np.ndarray
    false: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """Corrected share of each text's n-grams per language, between 0 and 1."""
        out = np.zeros((len(texts), len(self.languages)))
        for at, part in chunks(texts):
            h, has, starts = grams(part)
            n = np.add.reduceat(has, starts, dtype=np.int64)
            where = list(probes(h))
            for word in range(self.slots.shape[1]):
                bits = functools.reduce(np.bitwise_and, [self.slots[w, word] for w in where])
                bits[~has] = 0
                for i in range(word * 8, min(word * 8 + 8, len(self.languages))):
                    hits = np.add.reduceat((bits >> np.uint8(i % 8)) & np.uint8(1), starts, dtype=np.int64)
                    out[at : at + len(part), i] = (hits - n * self.false[i]) / np.maximum(n, 1) / (1 - self.false[i])
        return np.clip(out, 0.0, 1.0)


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_PER_LANGUAGE) -> Filter:
    """Fit on at most about ``sample`` rows per language, chosen by a hash of the key.

    Rows with a null text or language teach nothing.  What reaches the driver is bounded by the number of
    slots and languages.
    """
    rows = labelled.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    count = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(count)
    words = max(1, -(-len(languages) // 8))
    if not languages:
        return Filter([], np.zeros((SLOTS, 1), np.uint8), np.zeros(0))
    u = F.pmod(F.xxhash64(F.coalesce("k", F.lit("~"))), F.lit(1 << 40)) / float(1 << 40)
    share = F.create_map(*[x for v in languages for x in (F.lit(v), F.lit(min(1.0, sample / count[v])))])
    picked = rows.where(u < share[F.col("l")]).select("t", "l")

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {v: i for i, v in enumerate(languages)}
        for b in batches:
            texts, langs = b["t"].to_pylist(), b["l"].to_pylist()
            for v in sorted(set(langs)):
                for _, part in chunks([t for t, x in zip(texts, langs, strict=True) if x == v]):
                    h, has, _ = grams(part)
                    g, n = np.unique(h[has], return_counts=True)
                    yield pa.record_batch([pa.array(g.view(np.int64)), pa.array(np.full(len(g), index[v], np.int32)), pa.array(n)], ["g", "l", "n"])

    counts = picked.mapInArrow(count_grams, "g long, l int, n long").groupBy("g", "l").agg(F.sum("n").alias("n"))
    per_gram = counts.groupBy("g").agg(*[F.sum(F.when(F.col("l") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(len(languages))])
    totals = counts.groupBy("l").agg(F.sum("n").alias("n")).collect()
    total = {r["l"]: float(r["n"]) for r in totals}
    rate = [F.col(f"n{i}") / total.get(i, 1.0) for i in range(len(languages))]
    top = F.greatest(*rate) if len(rate) > 1 else rate[0]
    masks = per_gram.select("g", *[sum((F.when((F.col(f"n{i}") > 0) & (rate[i] >= top * MIN_SHARE), 1 << (i % 8)).otherwise(0) for i in range(w * 8, min(w * 8 + 8, len(languages)))), F.lit(0)).alias(f"m{w}") for w in range(words)])
    places = F.array(*[F.shiftrightunsigned("g", 64 - 21 * (j + 1)).bitwiseAND(SLOTS - 1).cast("int") for j in range(PROBES)])
    sliced = masks.select(F.explode(places).alias("slot"), *[f"m{w}" for w in range(words)]).groupBy("slot").agg(*[F.bit_or(f"m{w}").cast("short").alias(f"m{w}") for w in range(words)])
    got = sliced.toArrow()
    slots = np.zeros((SLOTS, words), np.uint8)
    for w in range(words):
        slots[got["slot"].to_numpy(), w] = got[f"m{w}"].to_numpy()
    fill = np.array([((slots[:, i // 8] >> (i % 8)) & 1).mean() for i in range(len(languages))])
    return Filter(languages, slots, np.minimum(fill**PROBES, 0.999))


def identify(docs: DataFrame, model: Filter, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All rows of ``docs`` with the predicted language and its corrected share of n-grams.

    A null text and one without a letter are ``und`` with score 0, as is every text if the model has no
    language.  Equal shares go to the language first in order.  Whole texts are read, row by row: repeated
    rows get equal answers.  Columns named like the two new ones are replaced.
    """
    docs = docs.drop(lang, score)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SLOTS and the languages
    schema = StructType([*docs.schema.fields, StructField(lang, StringType()), StructField(score, DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = [t or "" for t in b[text].to_pylist()]
            s = m.scores(texts) if m.languages else np.zeros((len(texts), 1))
            best = s.argmax(1)
            known = np.array([bool(m.languages) and any(map(str.isalpha, t)) for t in texts], bool)
            names = [m.languages[i] if k else UNDECIDED for i, k in zip(best, known, strict=True)]
            value = np.where(known, s[np.arange(len(texts)), best], 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(value)], [*b.schema.names, lang, score])

    return docs.mapInArrow(predict, schema)


def held_out(key: str = "doc_id"):
    """Rows kept from learning: crc32 of the key as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2


@query("op1_bitmask_langid")
def op1(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
