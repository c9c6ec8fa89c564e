import random
import zlib

import pytest
from helpers import sha

from wavetable.llm import trie
from wavetable.llm.trie import op11, prefix_trie

TURNS = "conv_id long, turn long, role string, text string"
SF = "/root/testdata/sf0.001"


def brute(rows, rebuild):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in convs}
        convs = {c: convs.get(c - (c - c // 100 * 100 if c >= 0 else -(-c % 100)), [])[: h[c]] + t[h[c] :] for c, t in convs.items()}
    members = {}
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    below = {n: [] for n in members}
    for n in members:
        for d in range(len(n) + 1):
            below[n[:d]].append(n)
    out = []
    for n, m in members.items():
        children = [x for x in below[n] if len(x) == len(n) + 1]
        leaves = [x for x in below[n] if not any(y != x for y in below[x])]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below[n] if x)
        ends = sorted(c for c in m if len(convs[c]) == len(n))
        parent = min(members[n[:-1]]) if n else None
        out.append((min(m), len(n), parent, len(m), len(children), len(leaves), saved, sha(",".join(map(str, ends)).encode())))
    return sorted(out)


def talk(seed, n=260):
    r = random.Random(seed)
    rows = []
    for c in [*range(n), -7, -120, 5000, 5001, 10_205]:
        shape = r.random()
        texts = ["same"] * 8 if shape < 0.3 else r.choices(["a", "é", "", None, "hello"], k=r.choice([1, 2, 4, 9]))
        turns = list(range(len(texts)))
        if r.random() < 0.1:
            turns[0] = None
        rows += [(c, t, r.choice(["user", None]) if shape > 0.9 else ["user", "assistant"][i % 2], x) for i, (t, x) in enumerate(zip(turns, texts, strict=True))]
    r.shuffle(rows)
    return rows


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("seed", "rebuild", "block"), [(0, True, 1024), (1, True, 2), (2, False, 3)])
def test_nodes_equal_brute_force(spark, monkeypatch, seed, rebuild, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "PART_ROWS", 20)
    monkeypatch.setattr(trie, "LIST", 3)
    rows = talk(seed)
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' AS key", "1 AS pos", "2 AS depth").repartition(6)
    assert got(prefix_trie(df, rebuild=rebuild)) == brute(rows, rebuild)


def test_query_on_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op11(spark, SF)) == brute(rows, True)


def test_one_hot_conversation_and_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 64)
    rows = [(1, i, "user", f"t{i}") for i in range(700)] + [(2, i, "user", f"t{i}") for i in range(300)] + [(3, 0, "user", "long " * 300_000)]
    assert got(prefix_trie(spark.createDataFrame(rows, TURNS))) == brute(rows, False)


def test_ties_nulls_and_empty_table(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a"), (None, 0, "user", "a"), (3, None, None, None)]
    assert got(prefix_trie(spark.createDataFrame(rows, TURNS))) == brute(rows, False)
    tied = [(1, 0, "user", "b"), (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "user", "b")]
    assert [r[3] for r in got(prefix_trie(spark.createDataFrame(tied, TURNS)))] == [2, 2, 2]
    assert got(prefix_trie(spark.createDataFrame([], TURNS))) == []
    assert got(prefix_trie(spark.createDataFrame([], TURNS), rebuild=True)) == []
