"""Mixing sources to target weights by Poisson replication, and a global shuffle.

The mean repetition rate of a source is ``weight * total / size`` (bytes of text by default).  Each row draws
its count by inverting the Poisson distribution at a number in [0, 1) that is a hash of seed and key, so
a task that runs again draws the same.  A rate above ``PART``, whose terms would underflow, is a sum of
independent draws of equal parts.  Rows are exploded by their count and sorted by another hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetable.llm.common import fresh, learn, query, table, text_bytes
from wavetable.session import materialise

SOURCES = 10_000  # sources whose rates are broadcast: 400 KB
PARTS = 256  # parts of the rows that ask for the rate of a source if there are more
PART = 700  # exp(-rate) has all its digits up to 708


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits (52 bits) of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_count(rate: Column, u: Column) -> Column:
    """Inverse of the Poisson distribution: the number of k with P(X <= k) <= u.

    Terms follow from each other up to a k that leaves less than 1e-12 (rate + 12 sqrt(rate) + 30).  Most rows are done with the first term.
    """
    first = F.exp(-rate)
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(first.alias("p"), first.alias("c"), F.lit(0).alias("n"))

    def step(s, k):
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), (s["n"] + F.when(s["c"] <= u, 1).otherwise(0)).alias("n"))

    return F.when(F.coalesce(rate, F.lit(0.0)) <= 0, 0).when(u < first, 0).otherwise(F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["n"]))


def poisson_sum(rate: Column, parts: Column, u: Column, *parts_of: Column) -> Column:
    """Poisson count of ``parts`` draws with mean ``rate`` each: the inverse at ``u``, or the sum over the parts' own hashes."""
    each = F.transform(F.sequence(F.lit(1), parts), lambda j: uniform(*parts_of, j))
    return F.when(parts > 1, F.aggregate(each, F.lit(0), lambda n, v: n + poisson_count(rate, v))).otherwise(poisson_count(rate, u))


def rates(docs: DataFrame, weights: DataFrame, source: str, size: Column) -> DataFrame:
    """One row per source of ``docs``: its mean repetition rate for weights that need not sum to 1.

    ``weights``: (source, weight), unique.  A source without a weight, or with one of 0 or null, has rate 0; a weight whose
    source has no bytes is left out of the sum.  Null is a source like any other.
    """
    sizes = docs.groupBy(F.col(source).alias("_source")).agg(F.sum(size).cast("double").alias("_size"))
    w = weights.select(F.col(weights.columns[0]).alias("_w"), F.col(weights.columns[1]).cast("double").alias("_weight"))
    joined = sizes.join(w, F.col("_source").eqNullSafe(F.col("_w")), "left").select("_source", "_size", F.when(F.col("_size") > 0, F.greatest("_weight", F.lit(0.0))).alias("_weight"))
    total = joined.agg(F.sum("_size").alias("_t"), F.sum("_weight").alias("_tw"))
    return joined.crossJoin(F.broadcast(total)).select(
        "_source", F.coalesce(F.col("_weight") / F.col("_tw") * F.col("_t") / F.col("_size"), F.lit(0.0)).alias("_rate")
    )


def with_source(docs: DataFrame, per: DataFrame, key: str, source: str, origin: str) -> DataFrame:
    """``docs`` with the facts of their source (``_source`` and others, one row each), which is null-safe."""
    if len(per.limit(SOURCES + 1).collect()) <= SOURCES:
        facts = F.broadcast(per.withColumnRenamed("_source", origin))
        return docs.join(facts, docs[source].eqNullSafe(F.col(origin))).drop(origin)
    named = lambda c: F.xxhash64(c.isNull(), c)
    # hashes stand for sources; a row whose hash two sources share is told apart by the source itself
    facts = per.groupBy(named(F.col("_source")).alias(origin)).agg(F.collect_list(F.struct(*per.columns)).alias("_all"))
    met = learn(docs.withColumn(origin, named(F.col(source))), facts, [origin], key, PARTS)
    own = F.filter("_all", lambda f: f["_source"].eqNullSafe(F.col(source)))[0]
    return met.select(*docs.columns, *[own[c].alias(c) for c in per.columns if c != "_source"])


def replicate(docs: DataFrame, weights: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 0, scale: float = 1.0, copy: str = "copy", order: str = "shuffle_key") -> DataFrame:
    """``docs`` with each row repeated by its Poisson count, in global random order.

    New columns: the number of the copy (from 0) and the key of the order, a hash of seed, key and copy.
    ``scale`` multiplies all rates.  Rows with equal keys draw equal counts and are all kept; a null
    text has size 1, so that a source of nulls has a rate.  What rows learn about their source is a rate and a number: broadcast
    up to 10,000 sources, beyond that met part by part of the rows, so a hot source is never gathered.  No row is dropped other than by a count of 0.
    """
    docs = docs.drop(copy, order)
    mean, origin, parts = fresh(docs, "_mean", "_origin", "_parts")
    rate = F.col("_rate") * F.lit(float(scale))
    many = F.greatest(F.ceil(rate / PART), F.lit(1)).cast("int")
    per = rates(docs, weights, source, F.greatest(text_bytes(text), F.lit(1)))
    per = materialise(per.select("_source", (rate / many).alias(mean), many.alias(parts)), "rates")
    drawn = with_source(docs, per, key, source, origin)
    n = F.col(mean)
    drawn = drawn.withColumn(mean, poisson_sum(n, F.coalesce(F.col(parts), F.lit(1)), uniform(F.lit(seed), F.lit("count"), F.col(key)), F.lit(seed), F.lit("part"), F.col(key))).where(n > 0)
    drawn = drawn.withColumn(copy, F.explode(F.sequence(F.lit(0), n - 1))).drop(mean, parts)
    mixed = drawn.withColumn(order, F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), F.coalesce(F.col(key).cast("string"), F.lit("~")), F.col(copy).cast("string"))))
    return mixed.orderBy(order, copy)


def tempered(docs: DataFrame, source: str = "source", text: str = "text", power: float = 0.5) -> DataFrame:
    """Target weights that flatten the sources: size to the ``power``."""
    return docs.groupBy(source).agg(F.pow(F.sum(F.greatest(text_bytes(text), F.lit(1))).cast("double"), F.lit(power)).alias("weight"))


@query(
    "op7_poisson_mix",
    """WITH d AS (SELECT doc_id, source, greatest(coalesce(strlen(text), 0), 1) AS b FROM documents),
s AS (SELECT source, CAST(sum(b) AS DOUBLE) AS size, sqrt(CAST(sum(b) AS DOUBLE)) AS w FROM d GROUP BY source),
r AS (SELECT source, w / (SELECT sum(w) FROM s) * (SELECT sum(size) FROM s) / size AS rate FROM s),
u AS (SELECT doc_id, d.source, rate,
  CAST(CAST('0x' || substr(md5('0|count|' || coalesce(CAST(doc_id AS VARCHAR), '~')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS u
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
c AS (SELECT doc_id, source, u, list_reduce(list_prepend({p: exp(-rate), c: exp(-rate), n: 0.0}, [{p: rate, c: CAST(k AS DOUBLE), n: 0.0} FOR k IN range(1, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)]),
  lambda s, x: {p: s.p * x.p / x.c, c: s.c + s.p * x.p / x.c, n: s.n + CASE WHEN s.c <= u THEN 1.0 ELSE 0.0 END}).n AS n FROM u)
SELECT doc_id, source, CAST(k AS INTEGER) AS copy,
  md5('0|order|' || coalesce(CAST(doc_id AS VARCHAR), '~') || '|' || CAST(k AS VARCHAR)) AS shuffle_key
FROM (SELECT doc_id, source, unnest(range(CAST(n AS BIGINT))) AS k FROM c)""",
)
def op7(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return replicate(docs, tempered(docs)).select("doc_id", "source", "copy", "shuffle_key")
