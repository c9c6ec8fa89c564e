import collections
import math
import zlib

import numpy as np
import pytest
from helpers import SF
from pyspark.sql import functions as F

from wavetable.llm import langid, mixing, sharding


def test_held_out_accuracy(spark):
    got = langid.op1(spark, "/root/testdata/sf0.01").collect()
    lang = {r[0]: r[1] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.98 and all(0 <= r["score"] <= 1 for r in got)


def test_filter_counts_equal_plain_sets(spark):
    docs = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("Der DOG", None), ("123 !", "en"), (None, "de"), ("x", None), ("", None), ("a" * 200_000, None)] * 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.fit(df)
    got = langid.identify(df.selectExpr("*", "'x' as score"), model).collect()
    known = collections.defaultdict(set)
    pad = lambda t: "   " + "".join(c.lower() if c.isalpha() else " " for c in t) + "   "

    def grams(t):
        p = pad(t)
        return [g for i in range(len(p) - 3) if (g := p[i : i + 4]).strip()]

    for _, t, lang in docs:
        if t and lang:
            known[lang].update(grams(t))
    for r, (_, t, _) in zip(got, docs, strict=True):
        if not t or not any(map(str.isalpha, t)):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        share = {k: np.mean([g in v for g in grams(t)]) for k, v in known.items()}
        assert share[r["lang_pred"]] > max(share.values()) - 1e-3 and abs(r["score"] - max(share.values())) < 1e-3


def test_language_of_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert langid.identify(df, model).collect() == []
    assert langid.identify(spark.createDataFrame([(1, "word")], "doc_id long, text string"), model).first()["lang_pred"] == "und"


@pytest.mark.parametrize("n", [0, 1, 3, 40, 400])
def test_differencing_balances(n):
    sizes = np.random.default_rng(n).integers(1, 1000, n)
    shard = sharding.differencing(sizes, 4)
    load = np.bincount(shard, weights=sizes, minlength=4)
    greedy = np.zeros(4)
    for x in sorted(sizes, reverse=True):
        greedy[greedy.argmin()] += x
    assert len(shard) == n and np.ptp(load) <= np.ptp(greedy)


def test_differencing_by_hand():
    load = np.bincount(sharding.differencing(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])
    assert sorted(load) == [14, 16]


def test_shards_of_a_table(spark):
    got = sharding.op2(spark, SF).toPandas()
    text = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas().set_index("doc_id")["text"]
    assert sorted(got.doc_id) == sorted(text.index)
    for r in got.itertuples():
        data = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
    assert got.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s)))).all()
    assert got.assign(t=got.doc_id.map(text)).groupby("t").shard.nunique().max() == 1
    load = got.groupby("shard")["size"].sum().reindex(range(24), fill_value=0)
    assert load.max() - load.min() <= got.groupby("text_crc32")["size"].sum().max()


def test_shards_keep_groups_nulls_and_columns(spark):
    rows = [(i, "same text", "k") for i in range(50)] + [(i, None, "k") for i in range(30)] + [(i, "t" * i, None) for i in range(40)] + [(1, "same text", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").withColumn("_key", F.lit(1))
    got = sharding.slots(sharding.assign(df, 3), "shard", "doc_id").toPandas()
    assert len(got) == len(rows) and got[got.text == "same text"].shard.nunique() == 1 and "_key" in got
    assert sharding.assign(df.limit(0), 3).count() == 0


def test_poisson_counts_follow_the_distribution(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), (F.col("id") % 2).cast("string").alias("source"))
    got = mixing.replicate(df, spark.createDataFrame([("0", 3.0), ("1", 1.0)], "source string, weight double"))
    n = got.groupBy("source", "doc_id").count().groupBy("source", "count").agg(F.count("*").alias("k")).collect()
    for source, rate in (("0", 1.5), ("1", 0.5)):
        seen = {r["count"]: r["k"] for r in n if r["source"] == source}
        for k in range(1, 4):
            want = 10_000 * math.exp(-rate) * rate**k / math.factorial(k)
            assert abs(seen.get(k, 0) - want) < 5 * math.sqrt(want)
    keys = [r["shuffle_key"] for r in got.collect()]
    assert keys == sorted(keys)


def test_mixing_of_nulls_ties_and_missing_weights(spark):
    df = spark.createDataFrame([(1, "aa", "a", 1), (1, "aa", "a", 1), (2, None, None, 2), (None, "bb", "b", 3)], "doc_id long, text string, source string, copy int")
    w = spark.createDataFrame([("a", 1.0), (None, 1.0), ("zz", 5.0), ("b", None)], "source string, weight double")
    got = mixing.replicate(df, w, scale=50.0).collect()
    count = collections.Counter(r["doc_id"] for r in got)
    assert count[1] % 2 == 0 and count[1] > 20 and count[2] > 20 and None not in count
    assert mixing.replicate(df.limit(0), w).count() == 0
    again = mixing.replicate(df.repartition(7), w, scale=50.0).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_query_equals_sql(spark):
    import duckdb

    from wavetable.llm.common import SQL

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    assert sorted(map(tuple, mixing.op7(spark, SF).collect())) == sorted(con.execute(SQL["op7_poisson_mix"]).fetchall())


def test_counts_of_large_rates_are_poisson(spark):
    rows = [(i, "a", "x") for i in range(200)] + [(1000, "b", "y" * 2_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    got = {r["doc_id"]: r["count"] for r in mixing.replicate(df, weights).where("source = 'a'").groupBy("doc_id").count().collect()}
    n = np.array([got[i] for i in range(200)])
    rate = 2_000_200 / 400
    assert abs(n.mean() - rate) < 5 * (rate / 200) ** 0.5 and 0.6 < n.var(ddof=1) / rate < 1.5
    drawn = np.sort(np.random.default_rng(0).poisson(rate, 100_000))
    assert np.abs(np.searchsorted(drawn, np.sort(n)) / len(drawn) - (np.arange(200) + 0.5) / 200).max() < 0.13


def test_more_sources_than_a_broadcast_holds(spark, monkeypatch):
    rows = [(i, f"s{i % 7}" if i % 9 else None, "x" * (1 + i % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    w = mixing.tempered(df)
    want = sorted((r["doc_id"], r["copy"], r["shuffle_key"]) for r in mixing.replicate(df, w, scale=2.0).collect())
    monkeypatch.setattr(mixing, "SOURCES", 3)
    assert sorted((r["doc_id"], r["copy"], r["shuffle_key"]) for r in mixing.replicate(df, w, scale=2.0).collect()) == want
