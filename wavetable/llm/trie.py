"""Prefix trie of conversations by collapsing whole sequences.

1. Turns become fixed-width digests and lengths at once; role and text are never shuffled.  A range partition by
   (conversation, turn) numbers them, so a conversation of any length is spread over tasks.
2. A prefix is identified by its length and the exclusive-or of two 64-bit hashes of (position, digest).  The value of a whole sequence is
   thus an aggregate: identical conversations collapse into one sequence with a weight and the list of the conversations that end there.
3. Only one representative of each sequence is unfolded into its prefixes (running values in blocks of ``BLOCK`` turns); weighted prefixes are
   aggregated to nodes.  Every node is checked to have one parent and one last turn, so a collision of hashes ends in an error.
4. Sequences that are proper prefixes of others are dropped by an anti-join: the rest are leaves.
5. A node belongs to its smallest conversation.  A sequence carries the sum over the nodes it owns; summed over all sequences that
   pass a node, less what the owner has above it, that is the sum over the subtree.

Keys shared by very many rows (the root, a common first turn) are met by aggregates with map-side combination, or by parts that ask for each distinct
key once.
"""

from __future__ import annotations

import hashlib
import operator
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetable.llm.common import query, table
from wavetable.session import materialise

BLOCK = 1_024  # turns of one conversation that a window holds
LIST = 12  # bits: a piece of an end list spans 4,096 conversation ids
PART_ROWS = 65_536  # rows of a part, which asks for each of its parents once
NODE = ["depth", "hi", "lo"]
EMPTY = hashlib.sha256(b"").hexdigest()


def digests(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """(key, turn, digest, chars) of all turns with a key; null role or text is empty."""
    r, t = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    digest = F.unhex(F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t).cast("binary")))
    rows = turns.select(F.col(key).cast("long").alias("key"), F.col(turn).alias("turn"), digest.alias("digest"), F.char_length(t).cast("long").alias("chars"))
    return rows.where(F.col("key").isNotNull())


def numbered(rows: DataFrame) -> DataFrame:
    """(key, pos, digest, chars): positions from 0 in the order of turn (null first), equal turns by digest.

    Rows are range-partitioned, numbered inside (key, partition), and shifted by the sizes of the partitions before.
    """
    order = [F.asc_nulls_first("turn"), F.asc("digest")]
    placed = materialise(rows.repartitionByRange(F.asc("key"), *order).withColumn("part", F.spark_partition_id()), "placed")
    sizes = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("size"))
    ahead = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("key", "part", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("key", "part").orderBy(*order)
    at = F.row_number().over(inside) - 1 + F.col("before")
    return placed.join(sizes, ["key", "part"]).select("key", at.cast("long").alias("pos"), "digest", "chars")


def block(pos: Column) -> Column:
    return F.floor(pos / BLOCK).cast("int")


def blocks_to(n: Column) -> Column:
    """All blocks of a conversation with ``n`` turns, at least the first."""
    return F.sequence(F.lit(0), block(F.greatest(n - 1, F.lit(0))))


def rebuilt(turns: DataFrame, family: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """((key, pos, digest, chars) of rebuilt conversations, (key, n): their lengths).

    Conversation c gets the first h turns of c - c % family (all if it has fewer, none if there is no such conversation), then its own
    behind its first h; h is the crc32 of its decimal number modulo ``heads``.
    """
    base = F.col("key") - F.col("key") % family
    convs = turns.groupBy("key").agg(F.count(F.lit(1)).alias("had"))
    first = turns.where((F.col("pos") < heads - 1) & (F.col("key") % family == 0)).groupBy(F.col("key").alias("base"))
    first = first.agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("head"))  # at most heads - 1 turns
    convs = convs.withColumn("h", (F.crc32(F.col("key").cast("string").cast("binary")) % heads).cast("int")).withColumn("base", base)
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,digest:binary,chars:bigint>>")), F.lit(1), F.col("h"))
    convs = convs.join(first, "base", "left").select("key", "had", "h", head.alias("head")).withColumn("taken", F.size("head"))
    convs = materialise(convs.withColumn("n", F.col("taken") + F.greatest(F.col("had") - F.col("h"), F.lit(0))), "convs")
    given = convs.select("key", F.explode("head").alias("t")).select("key", "t.pos", "t.digest", "t.chars")
    spread = convs.select("key", "h", "taken", F.explode(blocks_to(F.col("had"))).alias("block"))
    own = turns.withColumn("block", block(F.col("pos"))).join(spread, ["key", "block"]).where(F.col("pos") >= F.col("h"))
    own = own.select("key", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "chars")
    return given.unionByName(own), convs.select("key", "n")


def running(rows: DataFrame, key: str, at: str, columns: list[str], agg: Callable, combine: Callable) -> DataFrame:
    """``rows`` with ``run_<column>``, the aggregate up to and with the row along ``at`` per key, and ``top``, the key's smallest ``at``.

    Windows hold ``BLOCK`` positions of a key; totals of blocks are carried from one to the next.
    """
    d = rows.withColumn("block", block(F.col(at)))
    totals = d.groupBy(key, "block").agg(*[agg(c).alias(f"all_{c}") for c in columns], F.min(at).alias("top"))
    ahead = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(agg(f"all_{c}").over(ahead), F.lit(0)).alias(f"ahead_{c}") for c in columns]
    carry = totals.select(key, "block", *carried, F.min("top").over(Window.partitionBy(key)).alias("top"))
    inside = Window.partitionBy(key, "block").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = d.join(carry, [key, "block"])
    return joined.withColumns({f"run_{c}": combine(agg(c).over(inside), F.col(f"ahead_{c}")) for c in columns}).drop(*[f"ahead_{c}" for c in columns])


def end_lists(ends: DataFrame) -> DataFrame:
    """(depth, hi, lo, ends_sha256): digest of the decimal ids of each sequence's conversations, ascending and joined by commas.

    Pieces of at most 4,096 ids are joined before the shuffle to their sequence; one pass over the sorted pieces
    feeds the digest, which can only be computed in order, without holding the list.
    """
    pieces = ends.groupBy(*NODE, F.shiftright("key", LIST).alias("piece")).agg(F.sort_array(F.collect_list("key")).alias("ids"))
    text = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    pieces = pieces.select(*NODE, "piece", text.alias("ids")).repartition(*NODE).sortWithinPartitions(*NODE, "piece")

    def digest(batches):
        last, state = None, None
        for b in batches:
            done = []
            for node, ids in zip(zip(*(b[c].to_pylist() for c in NODE), strict=True), b["ids"].to_pylist(), strict=True):
                if node == last:
                    state.update(b"," + ids.encode())
                    continue
                if last is not None:
                    done.append((*last, state.hexdigest()))
                last, state = node, hashlib.sha256(ids.encode())
            yield out(done)
        if last is not None:
            yield out([(*last, state.hexdigest())])

    def out(rows):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [*NODE, "ends_sha256"])

    return pieces.mapInArrow(digest, "depth long, hi long, lo long, ends_sha256 string")


def nodes_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie of numbered turns (key, pos, digest, chars); ``convs``: (key, n), the lengths, with those of conversations without turns."""
    hashes = [F.xxhash64(F.lit(lane), "pos", "digest").alias(c) for lane, c in ((1, "hi"), (2, "lo"))]
    terms = materialise(turns.select("key", "pos", "digest", "chars", *hashes), "terms")
    whole = terms.groupBy("key").agg(F.count(F.lit(1)).alias("depth"), F.bit_xor("hi").alias("hi"), F.bit_xor("lo").alias("lo"))
    bare = convs.where("n = 0").select("key", *[F.lit(0).cast("long").alias(c) for c in NODE])
    whole = materialise(whole.unionByName(bare), "whole")
    seqs = materialise(whole.groupBy(*NODE).agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("weight")), "seqs")
    # prefixes of one representative per sequence
    chosen = seqs.select("key", F.col("depth").alias("n"), "weight", F.explode(blocks_to(F.col("depth"))).alias("block"))
    mine = terms.withColumn("block", block(F.col("pos"))).join(chosen, ["key", "block"]).drop("block")
    deep = running(mine, "key", "pos", ["hi", "lo"], F.bit_xor, Column.bitwiseXOR).select(
        "key", "block", (F.col("pos") + 1).alias("depth"), F.col("run_hi").alias("hi"), F.col("run_lo").alias("lo"), F.col("run_hi").bitwiseXOR(F.col("hi")).alias("up_hi"),
        F.col("run_lo").bitwiseXOR(F.col("lo")).alias("up_lo"), "digest", "chars", "weight", (F.col("pos") + 1 < F.col("n")).alias("inner"),
    )
    zero = F.lit(0).cast("long")
    root = seqs.select("key", F.lit(0).alias("block"), zero.alias("depth"), zero.alias("hi"), zero.alias("lo"), zero.alias("up_hi"), zero.alias("up_lo"), F.lit(None).cast("binary").alias("digest"), zero.alias("chars"), "weight", (F.col("depth") > 0).alias("inner"))
    paths = materialise(deep.unionByName(root), "paths")
    one = lambda c: F.min(c).eqNullSafe(F.max(c))
    clash = F.raise_error(F.lit("two prefixes have the same hashes")).cast("long")
    nodes = paths.groupBy(*NODE).agg(
        F.min("key").alias("owner"), F.when(one("digest") & one("up_hi") & one("up_lo"), F.sum("weight")).otherwise(clash).alias("n_convs"),
        F.max("inner").alias("inner"), F.min("up_hi").alias("up_hi"), F.min("up_lo").alias("up_lo"), F.max("chars").alias("chars"),
    )
    nodes = materialise(nodes, "nodes")
    leaves = seqs.join(nodes.where("inner").select(*NODE), NODE, "left_anti").select("key", F.lit(1).alias("leaf"))
    # what a sequence owns, and what its owner has above each node
    saves = (F.col("n_convs") - 1) * F.col("chars")
    owned = running(nodes.withColumn("saves", saves), "owner", "depth", ["saves"], F.sum, operator.add)
    owned = materialise(owned.select(*NODE, "owner", "n_convs", "up_hi", "up_lo", (F.col("run_saves") - F.col("saves")).alias("above"), "top"), "owned")
    total = nodes.groupBy(F.col("owner").alias("key")).agg(F.sum(saves).alias("owns"))
    carried = seqs.select("key", "depth").join(total, "key", "left").join(leaves, "key", "left").na.fill(0, ["owns", "leaf"])
    carried = carried.select("key", "owns", "leaf", F.explode(blocks_to(F.col("depth"))).alias("block"))
    below = paths.select("key", "block", *NODE).join(carried, ["key", "block"]).groupBy(*NODE).agg(F.sum("owns").alias("below"), F.sum("leaf").alias("n_leaves"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(F.count(F.lit(1)).alias("n_children"))
    # the parent has the same owner unless the node is the first that its owner owns
    parts = max(1, -(-seqs.count() // PART_ROWS))
    up = [(F.col("depth") - 1).alias("d"), F.col("up_hi").alias("uh"), F.col("up_lo").alias("ul")]
    part = F.pmod(F.xxhash64("owner"), F.lit(parts)).alias("part")
    first = owned.where("depth = top and depth > 0").select("owner", part, *up)
    asked = first.groupBy("part", "d", "uh", "ul").agg(F.count(F.lit(1)).alias("askers"))
    told = asked.join(nodes.select(F.col("depth").alias("d"), F.col("hi").alias("uh"), F.col("lo").alias("ul"), F.col("owner").alias("parent")), ["d", "uh", "ul"])
    above = first.join(told, ["part", "d", "uh", "ul"]).select("owner", (F.col("d") + 1).alias("depth"), "parent")
    parent = F.when(F.col("depth") == 0, None).when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("owner"))
    full = owned.join(below, NODE).join(children, NODE, "left").join(end_lists(whole), NODE, "left").join(above, ["owner", "depth"], "left")
    return full.select(
        F.col("owner").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.col("n_leaves").cast("long").alias("n_leaves"), (F.col("below") - F.col("above")).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rebuild: bool = False) -> DataFrame:
    """One row per node: every distinct sequence of first turns (role, text), from the root without turns.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens`` of
    the subtree, ``ends_sha256``.  Turns are ordered by ``turn``, null first, equal turns by the digest of role
    and text; repeated rows are turns of their own.  Null role or text is empty.  Rows with a null key belong to no conversation.  Other columns are not
    read.  An empty table has no root.  ``rebuild`` first replaces the heads of conversations by those of their family.
    """
    rows = materialise(numbered(digests(turns, key, turn, role, text)), "turns")
    if rebuild:
        return nodes_of(*rebuilt(rows))
    return nodes_of(rows, rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")))


@query(
    "op11_sequence_trie",
    """WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t),
h AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), range(0, 8 * length(s))), lambda x, i:
  xor((CASE WHEN i % 8 = 0 THEN xor(x, CAST(ord(substr(s, i // 8 + 1, 1)) AS BIGINT)) ELSE x END) >> 1,
    3988292384 * ((CASE WHEN i % 8 = 0 THEN xor(x, CAST(ord(substr(s, i // 8 + 1, 1)) AS BIGINT)) ELSE x END) & 1)))) % 6 AS h FROM c),
a AS (SELECT h.conv_id, 0 AS own, t.pos, role, text FROM h JOIN t ON t.conv_id = h.base AND t.pos < h.h
  UNION ALL SELECT h.conv_id, 1, t.pos, role, text FROM h JOIN t ON t.conv_id = h.conv_id AND t.pos >= h.h),
b AS (SELECT conv_id, text, md5(strlen(role) || ':' || role || text) AS m, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS d FROM a),
p AS (SELECT conv_id, d, length(text) AS chars, string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY d) AS node FROM b
  UNION ALL SELECT conv_id, 0, 0, '' FROM h),
l AS (SELECT conv_id, max(d) AS n FROM p GROUP BY conv_id),
n AS (SELECT node, d, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
  sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM p JOIN l ON p.conv_id = l.conv_id GROUP BY node, d),
k AS (SELECT n.*, left(node, 32 * (CAST(d AS INTEGER) - 1)) AS up FROM n),
ch AS (SELECT up, d - 1 AS d, count(*) AS n_children FROM k WHERE d > 0 GROUP BY up, d),
e AS (SELECT k.*, coalesce(n_children, 0) AS n_children FROM k LEFT JOIN ch ON ch.up = k.node AND ch.d = k.d),
s AS (SELECT p.node, sum((e.n_convs - 1) * e.chars) AS saved, count(*) FILTER (e.n_children = 0) AS n_leaves FROM e JOIN p ON p.conv_id = e.conv_id AND p.d <= e.d GROUP BY p.node)
SELECT e.conv_id, e.d AS depth, u.conv_id AS parent_conv_id, e.n_convs, e.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, e.ends_sha256
FROM e JOIN s ON s.node = e.node LEFT JOIN n u ON e.d > 0 AND u.node = e.up AND u.d = e.d - 1""",
)
def op11(spark, sf):
    return prefix_trie(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), rebuild=True)
