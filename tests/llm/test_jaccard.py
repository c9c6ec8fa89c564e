import random

import pytest
from helpers import documents, linked

from wavetable.llm.components import components
from wavetable.llm.jaccard import keep_one, link, op4

SF = "/root/testdata/sf0.001"


def edited(seed):
    r = random.Random(seed)
    base = [[f"w{r.randint(0, 400)}" for _ in range(r.choice([8, 30, 60, 120]))] for _ in range(10)]
    docs = []
    for i in range(160):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            p = r.randrange(len(w))
            w[p : p + (r.random() < 0.6)] = [f"x{r.randint(0, 30)}"] if r.random() < 0.7 else []
            w = w or ["w"]
        docs.append((max(0, i - (r.random() < 0.05)), " ".join(w) if r.random() > 0.06 else r.choice([None, "", " \t ", "A b", "a B"])))
    return docs


@pytest.mark.parametrize("seed", range(2))
def test_links_equal_brute_force(spark, seed):
    docs = edited(seed)
    assert sorted(map(tuple, link(spark.createDataFrame(docs, "doc_id long, text string")).collect())) == linked(docs)


def test_query_on_a_table(spark):
    assert sorted(map(tuple, op4(spark, SF).collect())) == linked(documents(spark))


def test_one_row_of_each_group_stays_with_its_columns(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(3, text, "n"), (1, text, "b"), (1, text, "a"), (2, text + " more", "m"), (9, None, "e"), (8, "", "f"), (8, "", "f"), (5, "other words", "o"), (None, "Other  words", "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class string")
    got = sorted((tuple(r) for r in keep_one(df).collect()), key=str)
    assert got == sorted([(1, text, "a"), (9, None, "e"), (8, "", "f"), (8, "", "f"), (5, "other words", "o")], key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert link(df).collect() == [] and keep_one(df).collect() == []


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_one_family_of_near_copies_beside_a_near_miss(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    docs = [(0, " ".join(base))]
    for i in range(1, 3000):  # one changed word leaves 111 of 121 shingles
        w = list(base)
        w[r.randrange(120)] = f"x{i}"
        docs.append((i, " ".join(w)))
    miss = list(base)
    for p in (10, 40, 70, 100):  # four spread changes leave 96 shingles of 136 in the union with the base
        miss[p] = f"y{p}"
    docs += [(5000 + i, " ".join([*miss[: 119 - i % 3], f"z{i}"])) for i in range(40)]
    got = {x["doc_id"]: x["component_id"] for x in link(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == dict.fromkeys(range(3000), 0) | dict.fromkeys(range(5000, 5040), 5000)
