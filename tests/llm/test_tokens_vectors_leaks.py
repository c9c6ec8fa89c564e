import base64
import os

import numpy as np
import pytest
from helpers import SF
from pyspark.sql import functions as F

from wavetable.llm import decontaminate, tokens, vectors

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file")


@needs_vocabulary
@pytest.mark.parametrize("rule", tokens.RULES)
def test_tokens_by_section_equal_brute_force(spark, rule):
    import tiktoken

    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, "a line.\n\n\nend \n x", "b"), (2, None, ""), (3, "é\n", None), (3, "é\n", None), (None, "<|endoftext|>\n\n\n\nq", "\n"), (5, "wörd " * 3000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, field string")
    got = tokens.attribute(df, fields=("text", "field"), rule=rule).toPandas()
    at = 0
    for _, *fields in rows:
        fields = [f or "" for f in fields]
        raw = "\n".join(fields).encode()
        borders, place = [], 0
        for i, f in enumerate(fields):
            full = f + "\n" * (i == 0)
            lines = full.splitlines(keepends=True) if full else [""]
            if i == 0 and f.endswith("\n") and len(lines) > 1:
                lines[-2:] = [lines[-2], lines[-1]]
            for line in lines:
                borders.append((place, place + len(line.encode())))
                place += len(line.encode())
        assert place == len(raw)
        part = got.iloc[at : at + len(borders)]
        at += len(borders)
        want, p = np.zeros(len(borders)), 0
        for t in enc.encode_ordinary(raw.decode()):
            n = len(enc.decode_single_token_bytes(t))
            over = np.array([max(0, min(e, p + n) - max(s, p)) for s, e in borders])
            want[over.nonzero()[0][0] if rule == "start" else over.argmax()] += 1 if rule != "share" else 0
            if rule == "share":
                want += over / n
            p += n
        assert np.allclose(part.n_tokens, want)
    assert at == len(got)


@needs_vocabulary
def test_token_query_sums_to_whole_encodings(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    sums = {r["doc_id"]: r["n"] for r in tokens.op5(spark, SF).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    for i, x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        assert sums[i] == len(t.encode(x or "", add_special_tokens=False).ids)


@needs_vocabulary
def test_tokens_of_an_empty_table(spark):
    assert tokens.attribute(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def nearest(x, ids, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    return [(int(ids[j]), d[j]) for j in np.lexsort((ids, d)) if j != q][:k]


def test_search_equals_brute_force_where_it_must(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((260, 8))
    x[100:140] = x[0]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    bad = [(300, None), (400, [0.0] * 8), (500, [1.0] * 7 + [None]), (600, [float("nan")] * 8), (700, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (0, rows[0][1]), (800, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("id", F.lit(1))
    got = vectors.search(df).toPandas()
    assert set(got.query_id) == {0, 100, 200}
    for q in (0, 100, 200):
        mine = got[got.query_id == q].sort_values("rank")
        want = nearest(x, np.arange(260), q, 10)
        assert list(mine["rank"]) == list(range(1, 11)) and list(mine.vec_id) == [w[0] for w in want]
        assert np.allclose(mine.score, [w[1] for w in want], rtol=0, atol=1e-12)


def test_recall_on_a_table(spark):
    sf = "/root/testdata/sf0.1"
    t = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    x, ids = np.stack(t.embedding).astype(float), t.vec_id.to_numpy()
    got = vectors.op10(spark, sf).toPandas().groupby("query_id").vec_id.apply(set)
    want = {int(ids[q]): {w[0] for w in nearest(x, ids, q, 10)} for q in np.flatnonzero(ids % 100 == 0)}
    assert set(got.index) == set(want) and np.mean([len(got[q] & w) / 10 for q, w in want.items()]) >= 0.9


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (5, [1.0, 3.0]), (7, [4.0, 2.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in vectors.search(df).orderBy("rank").collect()] == [(5, 1.0), (7, 3.0)]
    assert vectors.search(df.limit(0)).count() == 0 and vectors.search(df.where("vec_id = 0")).count() == 0


def test_leaks_verbatim_and_rephrased(spark):
    r = np.random.default_rng(3)
    word = lambda: "".join(r.choice(list("abcdefghijklmnop"), 6))
    items = [(i, " ".join(word() for _ in range(30)) + ". " + " ".join(word() for _ in range(4)) + ".") for i in range(20)] + [(50, "two words"), (51, None), (52, " ")]
    noise = lambda n: " ".join(word() for _ in range(n))
    rephrased = items[2][1].split()
    for j in range(0, 28, 5):
        rephrased[j] = word()
    lost = items[3][1].split()
    for j in range(0, 34, 2):
        lost[j] = word()
    docs = [(1, noise(50) + " " + items[1][1].upper() + " " + noise(50)), (2, noise(90) + " " + " ".join(rephrased)), (3, " ".join(lost)), (4, noise(300)), (5, None), (6, ""), (7, "Two  words!"), (7, "two other words"), (None, items[4][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.find(df, bench).collect()), key=str)
    assert found == [(1, 1), (2, 2), (7, 50), (None, 4)]
    assert sorted(str(r["doc_id"]) for r in decontaminate.clean(df, bench).collect()) == ["3", "4", "5", "6", "7"]
    assert decontaminate.find(df.limit(0), bench).count() == 0 and decontaminate.find(df, bench.limit(0)).count() == 0
    assert decontaminate.clean(df, bench.limit(0)).count() == len(docs)


def test_every_verbatim_item_of_a_table_is_found(spark):
    sf = "/root/testdata/sf0.01"
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {(d, i) for d, x in docs for i, t in items if t in (x or "")}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op3(spark, sf).collect()}
    assert want <= got and len(got) <= 1.1 * len(want) + 2


def test_common_subsequence():
    a, b = [1, 2, 3, 4, 2], [2, 4, 3, 9, 4, 1, 2]
    assert decontaminate.common(decontaminate.places(a), len(a), b) == 4


def test_verbatim_items_of_any_length_are_found_between_other_items(spark):
    r = np.random.default_rng(5)
    words = np.array(["".join(r.choice(list("abcdefghijklmnop"), 6)) for _ in range(3000)])
    items = [(i, " ".join(r.choice(words, int(r.choice([1, 2, 3, 5, 7, 8, 9, 12, 30]))))) for i in range(600)]
    docs = []
    for d in range(200):
        i, a, b = (int(x) for x in r.choice(600, 3, replace=False))
        docs.append((d, " ".join([*r.choice(words, 40), items[a][1], items[i][1], items[b][1], *r.choice(words, 40)]), [i, a, b]))
    df = spark.createDataFrame([x[:2] for x in docs], "doc_id long, text string")
    found = {(x["doc_id"], x["item_id"]) for x in decontaminate.find(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(d, i) for d, _, held in docs for i in held} <= found
    # short items only where they stand word by word
    text = dict(x[:2] for x in docs)
    assert all(f" {items[i][1]} " in f" {text[d]} " for d, i in found if len(items[i][1].split()) < decontaminate.SHORT)


def test_descent_converges_from_small_cells(spark):
    n = 3000
    x = np.random.default_rng(2).standard_normal((n, 16))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    got = {r["id"]: set(r["nbr"][:10]) for r in vectors.neighbour_graph(df, n, cell=60).collect()}
    want = {q: {w[0] for w in nearest(x, np.arange(n), q, 10)} for q in range(0, n, 10)}
    assert np.mean([len(got[q] & w) / 10 for q, w in want.items()]) > 0.95


def test_walk_expands_all_inside_the_beam(spark):
    n = 300
    x = np.random.default_rng(4).standard_normal((n, 2))
    nodes = spark.createDataFrame([(0, i, [float(v) for v in x[i]], [(i - 1) % n, (i + 1) % n, (i + 37) % n]) for i in range(n)], vectors.NODES)
    starts = spark.createDataFrame([(0, [float(v) for v in x[0]], [0])], "q long, qv array<double>, adj array<long>")
    assert sorted(vectors.walk(nodes, 1, starts, n).first()["best"]) == list(range(n))


def test_paraphrases_without_a_common_window_equal_all_pairs(spark):
    r = np.random.default_rng(11)
    word = lambda: "".join(r.choice(list("abcdefghijklmnop"), 6))
    items = [(i, [word() for _ in range(36)]) for i in range(15)]
    docs = []
    for d in range(45):
        words = [word() for _ in range(int(r.integers(20, 60)))]
        if d % 3 == 0:
            for j, w in enumerate(items[d // 3][1]):
                words += [w] if j % 3 else [word(), w]  # runs of three words of the item at most
        docs.append((d, words + [word() for _ in range(int(r.integers(0, 40)))]))
    grams = {tuple(w[j : j + decontaminate.WINDOW]) for _, w in items for j in range(len(w) - decontaminate.WINDOW + 1)}
    assert not any(tuple(w[j : j + decontaminate.WINDOW]) in grams for _, w in docs for j in range(len(w)))

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
        return row[-1]

    want = {(d, i) for d, w in docs for i, t in items if longest(t, w) >= decontaminate.VERBATIM * len(t)}
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    found = decontaminate.find(df, spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string"))
    assert {(x["doc_id"], x["item_id"]) for x in found.collect()} == want and len(want) == 15


def test_products_of_a_long_text_are_gathered_in_parts():
    import tracemalloc

    r = np.random.default_rng(2)
    vocabulary = np.unique(decontaminate.hashed([" ".join(f"w{i}" for i in range(500))])[1])
    b, h = decontaminate.hashed([" ".join(f"w{i}" for i in r.integers(0, 600, 60_000)), "", "w1 w2 w2", "none"])
    word = decontaminate.lookup(h, vocabulary, decontaminate.bitmap(vocabulary))
    p = decontaminate.Passages(b, word, r.random(len(vocabulary)) + 0.5)
    m = r.standard_normal((len(vocabulary), 80)).astype(np.float32)
    on = np.flatnonzero(p.norm > 0)[::3]
    tracemalloc.start()
    got = p.times(m, on)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.zeros((len(p.row), 80))
    np.add.at(want, p.passage, m[p.word] * (p.weight / p.norm[p.passage])[:, None])
    assert np.allclose(got, want[on], atol=1e-4)
    assert len(p.word) / 3 > decontaminate.ENTRIES and peak < 14 << 20  # all rows at once are 22 MB


@pytest.mark.parametrize("keys", [[1], [0, 0, 0], [0, 1, 1, 1, 1, 5, 5, 7], list(range(9))])
def test_runs_cover_every_entry_once(monkeypatch, keys):
    monkeypatch.setattr(decontaminate, "ENTRIES", 3)
    key, seen = np.array(keys), []
    for k, a, z, start in decontaminate.runs(key):
        assert a == len(seen) and key[a + start].tolist() == k.tolist()
        assert start[-1] < 3  # a run is not cut, so the last one may go beyond
        seen += np.repeat(k, np.diff(np.append(start, z - a))).tolist()
    assert seen == keys
