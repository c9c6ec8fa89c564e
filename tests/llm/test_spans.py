"""Token spans and byte strings against brute force."""

import random

import pytest
from helpers import documents, sha, without_bytes, without_spans

from wavetable.llm import blocks
from wavetable.llm.substrings import op8, remove_spans
from wavetable.llm.suffixes import expand, op9, remove_repeats

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def corpus(seed, words):
    r = random.Random(seed)
    lines = [[r.choice(words) for _ in range(r.randint(8, 40))] for _ in range(8)]
    docs = []
    for i in range(60):
        w = [x for _ in range(r.randint(0, 4)) for x in (r.choice(lines)[r.randint(0, 5) :] if r.random() < 0.7 else [f"u{r.random()}" for _ in range(r.randint(1, 20))])]
        docs.append((i, r.choice([" ", "  ", "\n"]).join(w)))
    return docs + [(60, None), (61, ""), (62, " \t\n "), (None, docs[3][1]), (3, docs[3][1]), (4, docs[5][1]), (63, "a b " * 300), (64, "x" * 5000)]


@pytest.mark.parametrize("seed", range(3))
def test_spans_equal_brute_force(spark, seed, monkeypatch):
    docs = corpus(seed, ["a", "b", "é"] if seed == 1 else [f"w{i}" for i in range(50)])
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2000)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr("wavetable.llm.substrings.blocked", lambda d, k, t: blocks.blocked(d, k, t, 2000))
    assert rows(remove_spans(df)) == without_spans(docs)


def test_span_query_on_a_table(spark):
    assert rows(op8(spark, SF)) == without_spans(documents(spark))


def test_kept_text_and_clashing_columns(spark):
    line = " ".join(f"w{i}" for i in range(13))
    df = spark.createDataFrame([(1, line, 0, "x"), (2, f"start {line}  end", 1, "y")], "doc_id long, text string, block int, id string")
    got = {r["doc_id"]: r for r in remove_spans(df, texts=True).collect()}
    assert got[1]["kept"] == line and got[2]["kept"] == "start end" and got[2]["n_removed"] == 13
    assert got[2]["kept_sha256"] == sha(b"start end")


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert rows(remove_spans(df)) == [] and rows(remove_repeats(df)) == []


@pytest.mark.parametrize("seed", range(4))
def test_bytes_equal_brute_force(spark, seed):
    r = random.Random(seed)
    pieces = ["".join(r.choice("ab" if seed % 2 else "abcdefgh ") for _ in range(r.randint(40, 190))) for _ in range(6)]
    docs = []
    for i in range(40):
        x = "".join(r.choice(pieces)[r.randint(0, 20) :] if r.random() < 0.7 else "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 60))) for _ in range(r.randint(0, 8)))
        docs.append((i, None if r.random() < 0.05 else "z" * r.randint(0, 700) * (r.random() < 0.1) + x))
    docs += [(0, docs[0][1]), (None, docs[1][1]), (99, "é" * 120)]
    length = [90, 80, 200, 120][seed]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(remove_repeats(df, length=length, block_bytes=2000 if seed < 3 else 1 << 20)) == without_bytes(docs, length)


def test_byte_query_on_a_table(spark):
    assert rows(op9(spark, SF)) == without_bytes(documents(spark), 200)


def test_expansion_derives_common_prefixes():
    import numpy as np

    text = np.array([5, 6, 5, 6, 7, 0, 6, 5, 6, 8, 1])
    for threshold in (1, 2, 3):
        order, interval = expand(text, 2, threshold)
        for a in range(len(text)):
            for b in range(a):
                x, y = text[order[a] :][:threshold].tolist(), text[order[b] :][:threshold].tolist()
                same = x == y and len(x) == threshold and min(x) > 1
                assert same == (interval[a] == interval[b])
