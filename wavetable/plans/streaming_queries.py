"""Incremental ingest (T1, T2): the derived text files arrive in two drops."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wavetable.plans.ingest_queries import lines, written
from wavetable.plans.registry import query
from wavetable.plans.tables import sql
from wavetable.session import shared_folder
from wavetable.sources import instrument as ins
from wavetable.streaming.ingest import ingest_new_files


def _two_drops(spark, sf, transform, name):
    base = f"{shared_folder(spark)}/{name}_{uuid.uuid4().hex[:8]}"
    d = lines(spark, sf).withColumn("sample", F.regexp_extract("file_path", r"R(\d+)_", 1).cast("long"))
    d = d.repartition("sample").sortWithinPartitions("sample", "ord").select("sample", F.col("line").alias("value")).cache()
    for drop in (0, 1):
        d.where(F.col("sample") % 2 == drop).write.mode("append").partitionBy("sample").text(f"{base}/in")
        ingest_new_files(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", transform)
    d.unpersist()
    return spark.read.parquet(f"{base}/out")


@query("t1_incremental_ingest", sql("S", "SELECT sample_id AS sample, 8 + count(*) + CASE WHEN sample_id % 9 = 3 THEN 0 ELSE 1 END AS n_lines, CAST(sample_id % 2 AS BIGINT) AS batch FROM S GROUP BY sample_id"))
def t1(spark, sf):
    out = _two_drops(spark, sf, lambda b: b.select("file_path", "line"), "t1")
    sample = F.regexp_extract("file_path", r"sample=(\d+)", 1).cast("long").alias("sample")
    return out.groupBy(sample).agg(F.count(F.lit(1)).alias("n_lines"), F.max("batch_id").cast("long").alias("batch"))


@query("t2_bounded_ingest", sql("S", "SELECT sample_id AS sample, least(5, count(*) FILTER (vec_id % 23 <> 0 AND vec_id % 17 <> 0 AND vec_id % 19 <> 0)) AS n_rows FROM S WHERE sample_id % 25 <> 24 GROUP BY sample_id HAVING count(*) FILTER (vec_id % 23 <> 0 AND vec_id % 17 <> 0 AND vec_id % 19 <> 0) > 0"))
def t2(spark, sf):
    def capped(batch):
        axes = ins.parse_axis(ins.body_start(batch), 64)
        return ins.cap_rows(ins.parse_pixels(batch, axes), 5).select("file_path", "x_um", "y_um", "y")

    out = _two_drops(spark, sf, capped, "t2")
    sample = F.regexp_extract("file_path", r"sample=(\d+)", 1).cast("long").alias("sample")
    return out.groupBy(sample).agg(F.count(F.lit(1)).alias("n_rows"))
