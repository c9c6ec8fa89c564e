"""Balanced shards of indivisible groups by Karmarkar-Karp differencing.

Groups are equal texts.  The groups are first reduced to a bounded list of items: every group of at least
``total / (shards * ITEMS_PER_SHARD)`` bytes is an item of its own (there are at most
``shards * ITEMS_PER_SHARD`` of them), the lighter groups are dealt by hash into as many composite items.
Differencing over these items needs memory that depends on the two parameters only.  Rows find their
shard by a broadcast of that bounded list, so texts are never shuffled by group and a group with a third
of all rows costs no task more than others.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.llm.common import fresh, query, table, text_bytes
from wavetable.session import materialise

ITEMS_PER_SHARD = 256


def differencing(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item: repeatedly combine the two partial partitions with the largest spread.

    A partial partition is a vector of ``shards`` sums in ascending order, shifted to start at 0.  Two are
    combined by adding the ascending one to the descending other.  Each combination keeps only the order
    that sorted its sums; walking these orders from the root down gives the shard of every item.
    """
    n = len(sizes)
    if n == 0:
        return np.zeros(0, np.int64)
    sums: list[np.ndarray | None] = []
    heap = []
    for i, s in enumerate(np.asarray(sizes, np.int64)):
        v = np.zeros(shards, np.int64)
        v[-1] = s
        sums.append(v)
        heap.append((-int(s), i))
    heapq.heapify(heap)
    joined: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        v = sums[a] + sums[b][::-1]
        sums[a] = sums[b] = None
        order = np.argsort(v, kind="stable")
        v = v[order] - v[order[0]]
        joined.append((a, b, order))
        heapq.heappush(heap, (-int(v[-1]), len(sums)))
        sums.append(v)
    # place[node][j]: the shard that holds the j-th smallest sum of the node
    place: list[np.ndarray | None] = [None] * len(sums)
    place[heap[0][1]] = np.arange(shards)
    for node in range(len(sums) - 1, n - 1, -1):
        a, b, order = joined[node - n]
        slots = np.empty(shards, np.int64)
        slots[order] = place[node]
        place[a], place[b], place[node] = slots, slots[::-1], None
    return np.array([place[i][-1] for i in range(n)])


def assign(docs: DataFrame, shards: int, text: str = "text", per_shard: int = ITEMS_PER_SHARD, shard: str = "shard", size: str = "size") -> DataFrame:
    """All rows of ``docs`` with a shard and the size that was balanced (UTF-8 bytes + 8).

    Rows with equal texts share a shard, whatever the size of their group: a group above the fair share
    makes its shard larger.  Null texts are no group; they are dealt like light groups of 8 bytes each by
    the hash of the row.  Empty tables give empty results; repeated rows are all placed; columns named
    like the two new ones are replaced.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    docs = docs.drop(shard, size)
    key, bucket, item, where = fresh(docs, "_key", "_bucket", "_item", "_where")
    items = shards * per_shard
    keyed = docs.withColumn(size, text_bytes(text) + 8).withColumn(
        key, F.coalesce(F.md5(F.col(text).cast("binary")), F.concat(F.lit("null"), F.xxhash64(*docs.columns).cast("string")))
    )
    keyed = keyed.withColumn(bucket, F.pmod(F.xxhash64(key), F.lit(items)).cast("int"))
    groups = materialise(keyed.groupBy(key, bucket).agg(F.sum(size).alias(size)), "groups")
    total = groups.agg(F.sum(size)).first()[0] or 0
    heavy = F.col(size) * items >= total
    # both lists have at most ``items`` rows: heavy groups by their size, composites by their number
    single = groups.where(heavy).select(key, F.lit(None).cast("int").alias(bucket), size)
    mixed = groups.where(~heavy).groupBy(bucket).agg(F.sum(size).alias(size)).select(F.lit(None).cast("string").alias(key), bucket, size)
    listed = single.unionByName(mixed).toArrow().sort_by([(size, "descending"), (key, "ascending"), (bucket, "ascending")])
    placed = pa.table({key: listed[key], bucket: listed[bucket], where: pa.array(differencing(listed[size].to_numpy(), shards).astype(np.int32))})
    small = docs.sparkSession.createDataFrame(placed, f"{key} string, {bucket} int, {where} int")
    one = F.broadcast(small.where(F.col(key).isNotNull()).select(F.col(key), F.col(where).alias(item)))
    many = F.broadcast(small.where(F.col(key).isNull()).select(F.col(bucket), F.col(where)))
    return keyed.join(one, key, "left").join(many, bucket, "left").withColumn(shard, F.coalesce(item, where)).drop(key, bucket, item, where)


def slots(df: DataFrame, shard: str, order: str, slot: str = "slot", parts: int = 256) -> DataFrame:
    """A gapless position from 0 inside each shard.

    Positions are counted in ``parts`` hash parts of a shard and shifted by the sizes of the parts
    before, so a shard is never sorted in one task.
    """
    part, before, rows = fresh(df, "_part", "_before", "_rows")
    from pyspark.sql import Window

    d = df.drop(slot).withColumn(part, F.pmod(F.xxhash64(order), F.lit(parts)).cast("int"))
    sizes = d.groupBy(shard, part).agg(F.count(F.lit(1)).alias(rows))
    ahead = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn(before, F.coalesce(F.sum(rows).over(ahead), F.lit(0))).drop(rows)
    inside = Window.partitionBy(shard, part).orderBy(order)
    return d.join(F.broadcast(offsets), [shard, part]).withColumn(slot, (F.row_number().over(inside) - 1 + F.col(before)).cast("long")).drop(part, before)


@query("op2_karmarkar_karp")
def op2(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    placed = assign(docs, 24).select(
        "doc_id",
        "size",
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
    )
    return slots(placed, "shard", "doc_id").withColumn("grown_shard", F.lit(None).cast("int")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
