import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import LOW

from wavetable.llm import divergence
from wavetable.llm.divergence import Terms, audit, op13, term_counts

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, lang string, source string, text string"


def brute(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, counts = Counter(), {}
    for lang, source, text in rows:
        found = TERM.findall(text.translate(LOW))
        docs.update((lang, t) for t in set(found))
        counts.setdefault((lang, source), Counter()).update(found)
    out = []
    for lang in {r[0] for r in rows}:
        kept = sorted(t for (of, t), n in docs.items() if of == lang and n >= least)
        groups = {s: {t: c[t] for t in kept} for (of, s), c in counts.items() if of == lang}

        def law(c):
            total = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: law(c) for s, c in groups.items()}
        q = law({t: sum(c[t] for c in groups.values()) for t in kept})
        for s in groups:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def corpus(seed, n=150):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ["ab", "Éa", "zz", "Q", "ß", "wordlongerthansixteenletters", "𝒳"] for b in "abcdefgh"] + ["1", "x1y", "-", "\x00a"]
    rows = []
    for i in range(n):
        text = " ".join(r.choices(words, k=r.choice([0, 1, 5, 30]))) if r.random() > 0.05 else None
        rows.append((i, r.choice(["en", "en", "de", None]), r.choice(["a", "a", "a", "b", "Ü", "", None]), text))
    rows.append((n, "xx", "lone", "!!"))
    rows += [(n + 1, "yy", s, None) for s in "uvw"]
    rows.append((n + 2, "en", "a", "Long " * 200_000))
    return rows + rows[:10]


@pytest.mark.parametrize(("seed", "bits", "least"), [(0, 64, 3), (1, 5, 3), (2, 12, 6)])
def test_rows_equal_brute_force(spark, seed, bits, least):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("doc_id", "digest").repartition(5)
    got = sorted(tuple(r) for r in audit(df, least=least, top=7, bits=bits).collect())
    assert got == brute([r[1:] for r in rows], least, 7)


def test_query_on_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "source", "text").collect()]
    assert sorted(tuple(r) for r in op13(spark, "/root/testdata/sf0.001").collect()) == brute(rows, 30, 50)


def test_many_sources_in_tiles(spark):
    r = random.Random(3)
    rows = [(i, "en", f"s{i % 300:03d}", " ".join(r.choices("abcdefghijklm", k=6))) for i in range(600)]
    assert sorted(tuple(r) for r in audit(spark.createDataFrame(rows, DOCS), least=5, top=3).collect()) == brute([r[1:] for r in rows], 5, 3)


def test_empty_table(spark):
    assert audit(spark.createDataFrame([], DOCS)).collect() == []


def test_differs_compares_strings_not_digests():
    t = Terms([b"abcdefghi abcdefghj abcdefghi abcdefgh a"], 64)
    assert t.differs(np.array([0, 0, 0, 0]), np.array([1, 2, 3, 4])).tolist() == [True, False, True, True]


class Tasks:
    """Stands for a table whose task function is called here."""

    def mapInArrow(self, task, _schema):
        self.task = task
        return self

    def groupBy(self, *_keys):
        return self

    def agg(self, *_columns):
        return self


def test_a_task_gathers_and_sends_counts_in_parts_of_one_batch(spark, monkeypatch):
    for name, value in (("PIECE_BYTES", 500), ("HELD", 400), ("SENT", 64)):
        monkeypatch.setattr(divergence, name, value)
    r = random.Random(5)
    rows = [(r.choice(["en", "de"]), f"s{r.randrange(9)}", " ".join("".join(r.choices("abcdefgh", k=3)) for _ in range(40))) for _ in range(300)]
    batches = [pa.record_batch([pa.array(c) for c in zip(*part, strict=True)], ["lang", "source", "text"]) for part in (rows[:200], rows[200:])]
    n, docs, sizes, taken = Counter(), Counter(), [], []

    def seen():
        for b in batches:
            taken.append(len(sizes))
            yield b

    frame = Tasks()
    term_counts(frame, 64)
    for b in frame.task(seen()):
        sizes.append(len(b))
        for lang, source, digest, times, of in zip(*(c.to_pylist() for c in b.columns), strict=True):
            n[lang, source, digest] += times
            docs[lang, source, digest] += of
    want_n, want_docs = Counter(), Counter()
    for lang, source, text in rows:
        found = Counter(Terms([text.encode()], 64).digest.view(np.int64).tolist())
        for digest, times in found.items():
            want_n[lang, source, digest] += times
            want_docs[lang, source, digest] += 1
    assert n == want_n and docs == want_docs
    assert max(sizes) <= 64 and taken[1] >= 200 * 40 // (3 * 64)  # most of the first batch is sent before the second is read


def test_rows_do_not_depend_on_what_a_task_holds(spark, monkeypatch):
    for name, value in (("HELD", 20), ("HELD_STRINGS", 5), ("SENT", 3)):
        monkeypatch.setattr(divergence, name, value)
    rows = corpus(4)
    assert sorted(tuple(r) for r in audit(spark.createDataFrame(rows, DOCS).repartition(3), least=3, top=7).collect()) == brute([r[1:] for r in rows], 3, 7)
