"""The corpus pipeline: five stages, each working on all that the stage before kept.

Language identification, one document of each near-copy group, benchmark decontamination, mixing of sources to target weights, and
sharding.  Every stage but the last returns the columns of ``documents``; the last adds ``shard``, ``slot`` and
``size``.  ``run`` writes each stage to the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavetable.llm import decontaminate, jaccard, langid, mixing, sharding
from wavetable.llm.common import fresh, table
from wavetable.session import materialise

LEAST_SCORE = 0.5  # share of a text's n-grams that its language must know
SHARDS = 24


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the filters know; null texts, texts without letters and foreign ones go.

    The filters learn from the labelled documents themselves.
    """
    lang, score = fresh(docs, "_lang", "_score")
    judged = langid.identify(docs, langid.fit(docs.where(~langid.held_out())), lang=lang, score=score)
    return judged.where((F.col(lang) != langid.UNDECIDED) & (F.col(score) >= LEAST_SCORE)).drop(lang, score)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles and a similarity of 0.8 or more, the one with the smallest id."""
    return jaccard.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, verbatim or rephrased."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources flattened to the square root of their size by Poisson replication, in global random order."""
    copy, order = fresh(docs, "_copy", "_order")
    return mixing.replicate(docs, mixing.tempered(docs), copy=copy, order=order).drop(copy, order)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in shards of nearly equal bytes, equal texts together, with a gapless position in the shard.

    Positions follow a hash of the row and of the number of its copy, so copies that the mixture made are spread over the shard.
    """
    copy, order = fresh(docs, "_copy", "_order")
    placed = sharding.assign(docs, SHARDS)
    same = Window.partitionBy(F.xxhash64(*docs.columns)).orderBy("doc_id", *[c for c in docs.columns if c not in ("doc_id", "text")], "text")
    numbered = placed.withColumn(copy, F.row_number().over(same)).withColumn(order, F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.xxhash64(*docs.columns).cast("string"), F.col(copy).cast("string"))))
    return sharding.slots(numbered, "shard", order).drop(copy, order)


STAGES = [
    ("language", known_language),
    ("near_copies", one_of_each_group),
    ("benchmark", no_benchmark),
    ("mixture", mixed),
    ("shards", sharded),
]
#: SQL cannot express the n-gram filters or the differencing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
