"""Exact Jaccard join of word-shingle sets with a token-group matrix, and the groups it links.

1. Equal texts are one class; one row of each class goes on.
2. A shingle in one class only cannot be in an intersection.  Blocks learn for each of their shingles how
   many blocks have it; a set whose shared shingles are too few for the threshold has no link and is done.
3. The other sets are partitioned into groups: sets with the same smallest shingle hash join the most central of them
   (the leader) if they really link to it.  Leaders and the sets left over do so again under other hashes, so that
   groups of near copies grow together and hardly any links between groups are left.
4. The token-group matrix has a row for each group and prefix shingle of its members (rarest first).  A
   set's prefix finds the groups it could link to; its overlap with the group's token union bounds its
   overlap with any member; only groups that the bound lets through are opened: the leader first, and members,
   part by part, only if the two groups are not connected by then.
5. Links between groups are joined to components.  Pairs inside a group are never listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetable.llm.blocks import ASKED, LAST, Block, answer, answers, ask, blocked, mix
from wavetable.llm.common import fresh, learn, query, table
from wavetable.llm.components import components
from wavetable.session import materialise

WORDS = 5
PERCENT = 80
MEMBERS_PER_TASK = 256
DEALT, PART_ROWS = 32, 65_536  # least number of parts, and rows of a part, in which rows ask for facts about their group
GROUPINGS = 2
CHUNK = 4_096  # shingles of a union that are compared at once
SETS = "class binary, id long, mark long, n long, central double, tokens array<long>, prefix int"
ONE_BLOCK = np.uint64(0x452821E638D01377)


def _sets(t: pa.Table, k: int):
    """A block of representatives in its order; hash and row of the members of each set, sorted by row and hash."""
    if len(t):
        # a class has one representative; identical repeated rows are told apart by nothing, so the first is taken
        t = t.sort_by([("id", "ascending"), ("mark", "ascending")])
        i, m = t["id"].to_numpy(), t["mark"].to_numpy()
        t = t.filter(pa.array(np.append(True, (i[1:] != i[:-1]) | (m[1:] != m[:-1]))))
    b = Block(t, lower=True)
    b.words()
    wh = b.word_hashes()
    h, at = b.windows(wh, k)
    row = b.wd[at]
    short = np.flatnonzero((b.wn > 0) & (b.wn < k))
    whole = np.zeros(len(short), np.uint64)
    for j in range(k - 1):
        on = b.wn[short] > j
        whole[on] = mix(whole[on] * np.uint64(0x9E3779B97F4A7C15) + wh[b.w0[short[on]] + j] + ONE_BLOCK)
    h, row = np.concatenate([h, whole]), np.concatenate([row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])) if len(h) else np.zeros(0, bool)
    return t, b, h[new], row[new]


def shared_sets(docs: DataFrame, key: str, text: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(classes of rows, one set per class): ``tokens`` are the shared shingles, rarest first, of sets that can have a link."""
    base, blocks = blocked(docs, key, text)
    rows = base.select("block", "id", "mark", F.unhex(F.md5("text")).alias("class"))
    chosen = rows.groupBy("class").agg(F.min(F.struct("id", "mark", "block")).alias("r")).select("r.*", "class")

    def pick(t: pa.Table, told: pa.Table) -> pa.Table:
        """Rows of the block that represent a class, with the class."""
        t = t.join(told.select(["id", "mark", "class"]), ["id", "mark"], join_type="inner") if len(t) and len(told) else t.slice(0, 0).append_column("class", pa.array([], pa.binary()))
        return t

    def send(t: pa.Table, told: pa.Table) -> pa.Table:
        t = pick(t, told)
        if not len(t):
            return ask(-1, np.zeros(0, np.uint64), blocks)
        _, b, h, _ = _sets(t, k)
        return ask(b.number, np.unique(h), blocks)

    def senders(low: np.ndarray, _block: np.ndarray, _extra=None) -> np.ndarray:
        _, back, n = np.unique(low, return_inverse=True, return_counts=True)
        return np.minimum(n, 65535).astype(np.uint16)[back]

    def sets(t: pa.Table, told: pa.Table) -> pa.Table:
        schema = pa.schema([("class", pa.binary()), ("id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("central", pa.float64()), ("tokens", pa.list_(pa.int64())), ("prefix", pa.int32())])
        t = pick(t, told.filter(pa.compute.is_valid(told["class"])))
        if not len(t):
            return schema.empty_table()
        t, b, h, row = _sets(t, k)
        distinct, index, here = np.unique(h, return_inverse=True, return_counts=True)
        count = answers(told.filter(pa.compute.is_null(told["class"])), distinct, blocks, np.uint16)
        shared = ((count > 1) | (here > 1))[index]
        rows = len(b.start)
        n, c = np.bincount(row, minlength=rows), np.bincount(row[shared], minlength=rows)
        need = -(-percent * n // 100)
        able = (c >= need) & (n > 0)
        keep = shared & able[row]
        h, row, count = h[keep], row[keep], count[index[keep]]
        order = np.lexsort((h, count, row))
        sizes = np.where(able, c, 0)
        central = np.bincount(row, weights=count, minlength=rows) / np.maximum(n, 1)
        offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        tokens = pa.ListArray.from_arrays(offsets, pa.array(h[order].view(np.int64)))
        return pa.table([t["class"].combine_chunks(), pa.array(b.id), t["mark"].combine_chunks(), pa.array(n), pa.array(central), tokens, pa.array(np.where(able, c - need + 1, 0).astype(np.int32))], schema=schema)

    counted = answer(base.groupBy("block").cogroup(chosen.groupBy("block")).applyInArrow(send, ASKED), senders)
    none = {"id": "long", "mark": "long", "class": "binary"}
    told = counted.select("*", *[F.lit(None).cast(v).alias(c) for c, v in none.items()]).unionByName(
        chosen.select("block", *none, F.lit(None).cast("int").alias("bucket"), F.lit(False).alias("carried"), F.lit(None).cast("binary").alias("data"))
    )
    return rows, base.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(sets, SETS)


def similar(a: Column, b: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether two sets reach the threshold; their shared shingles hold the whole intersection."""
    both = F.size(F.array_intersect(a, b))
    return both * 100 >= (n + m - both) * percent


def leaders(sets: DataFrame, percent: int, turn: int) -> DataFrame:
    """(class, leader) of the sets that really link to the most central set with the same smallest hash; each ``turn`` hashes anew."""
    seed = F.array_min(F.transform("tokens", lambda t: F.xxhash64(t, F.lit(turn))))
    narrow = materialise(sets.select("class", "central", seed.alias("seed")), "seeds")
    heads = narrow.groupBy("seed").agg(F.max(F.struct("central", "class")).alias("l"), F.count(F.lit(1)).alias("size")).where("size > 1")
    heads = heads.select("seed", F.col("l.class").alias("leader"), F.ceil(F.col("size") / MEMBERS_PER_TASK).cast("int").alias("parts"))
    # members meet a leader in as many parts as the group is large; the narrow side learns the parts first
    member = narrow.join(heads, "seed").where("class <> leader")
    member = member.select("class", "leader", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int").alias("part"))
    center = heads.select(F.col("leader").alias("class"), "leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    # one join gives all their parts to members and leaders
    met = sets.select("class", "n", "tokens").join(member.unionByName(center), "class")
    center = met.where("class = leader").select("leader", "part", F.col("n").alias("ln"), F.col("tokens").alias("lt"))
    joined = met.where("class <> leader").join(center, ["leader", "part"])
    return materialise(joined.where(similar(F.col("tokens"), F.col("lt"), F.col("n"), F.col("ln"), percent)).select("class", "leader"), "near")


def token_unions(grouped: DataFrame, opened: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((other, chunk, held): tokens of all members of each group in ``opened``, (other, chunks)).

    Parts of a group fold the tokens of their members before anything leaves them; chunks of about ``CHUNK`` tokens then fold the parts.
    """
    each = parts.join(opened.select(F.col("other").alias("grp")).distinct(), "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    folded = grouped.join(each, ["grp", "part"]).groupBy(F.col("grp").alias("other"), "part").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("held"))
    folded = materialise(folded, "unions")
    sizes = folded.groupBy("other").agg(F.ceil(F.sum(F.size("held")) / CHUNK).cast("int").alias("chunks"))
    cut = folded.join(sizes, "other").select("other", "held", "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    mine = F.filter("held", lambda t: F.pmod(F.xxhash64(t), F.col("chunks")) == F.col("chunk"))
    return cut.groupBy("other", "chunk").agg(F.array_distinct(F.flatten(F.collect_list(mine))).alias("held")), sizes


def member_links(opened: DataFrame, grouped: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """(mine, other) of groups with a link between the asking set and some member, part by part of the opened group."""
    asked = opened.join(grouped.select("class", "n", "tokens"), "class").join(parts.withColumnRenamed("grp", "other"), "other")
    asked = asked.select("class", "mine", "other", "c", "n", "tokens", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    inside = grouped.select(F.col("grp").alias("other"), "part", F.col("n").alias("m"), F.col("tokens").alias("ot"))
    small = (F.col("m") <= F.col("n")) & (F.col("m") * 100 >= F.col("n") * percent)
    room = (F.least("c", F.size("ot")) * (100 + percent)) >= (F.col("n") + F.col("m")) * percent
    pairs = asked.join(inside, ["other", "part"]).where(small & room)
    return pairs.where(similar(F.col("tokens"), F.col("ot"), F.col("n"), F.col("m"), percent)).select("mine", "other").distinct()


def components_of_classes(docs: DataFrame, key: str, text: str, k: int, percent: int) -> tuple[DataFrame, DataFrame, int]:
    """(classes of rows, one row per class: ``id`` and ``mark`` of its first row, ``n`` shingles, ``comp``; parts for :func:`learn`)."""
    rows, found = shared_sets(docs, key, text, k, percent)
    sets = materialise(found, "sets")
    able = materialise(sets.where("prefix > 0").select("class", "n", "central", "tokens", "prefix"), "able")
    member = able.select("class", F.col("class").alias("grp"))
    for r in range(GROUPINGS):
        heads = able.join(member.where("class = grp").select("class"), "class", "left_semi") if r else able
        near = leaders(heads, percent, r).withColumnsRenamed({"class": "grp", "leader": "to"})
        member = materialise(member.join(near, "grp", "left").select("class", F.coalesce("to", "grp").alias("grp")), "member")
    # members learn the number of parts of their group
    deal = max(DEALT, docs.count() // PART_ROWS)
    parts = materialise(member.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_PER_TASK).cast("int").alias("parts")), "parts")
    part = F.pmod(F.xxhash64("class", F.lit(1)), F.col("parts")).cast("int").alias("part")
    grouped = materialise(able.drop("central").join(learn(member, parts, ["grp"], "class", deal).select("class", "grp", part), "class"), "grouped")
    # The token-group matrix.  In a linked pair let y be no longer than x.  Their intersection is at least p/(100 + p) of
    # their sizes together, so at least 2p/(100 + p) of y: the rarest shingles of y up to there (its index prefix) meet those
    # of x up to p % of x.  An intersection is within the shared shingles of either, which bounds the sizes that can meet.
    shared, part = F.size("tokens"), 100 + percent
    short = shared - F.ceil(F.col("n") * (2 * percent) / part).cast("int") + 1
    held = grouped.where(short > 0).select("grp", F.col("n").alias("m"), F.explode(F.slice("tokens", 1, short)).alias("token"))
    matrix = held.groupBy("token", "grp").agg(F.min("m").alias("least"), F.max("m").alias("most")).withColumnRenamed("grp", "other")
    asks = grouped.select("class", "grp", "n", shared.alias("c"), F.explode(F.slice("tokens", 1, F.col("prefix"))).alias("token"))
    fits = (F.col("least") <= F.col("n")) & (F.col("most") * 100 >= F.col("n") * percent) & (F.col("c") * part >= (F.col("n") + F.col("least")) * percent)
    hits = materialise(asks.join(matrix, "token").where((F.col("grp") != F.col("other")) & fits).select("class", "grp", "other").distinct(), "hits")
    # the bound: shingles of the set in the union of the group, chunk by chunk
    unions, sizes = token_unions(grouped, hits, parts)
    asked = grouped.select("class", "n", "tokens").join(learn(hits, sizes, ["other"], "class", deal), "class").select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    bound = learn(asked, unions, ["other", "chunk"], "class", deal).select("class", "grp", "other", "n", F.size(F.array_intersect("tokens", "held")).alias("c"))
    bound = bound.groupBy("class", "grp", "other", "n").agg(F.sum("c").cast("int").alias("c")).where(F.col("c") * 100 >= F.col("n") * percent)
    opened = materialise(bound.select("class", F.col("grp").alias("mine"), "other", "c"), "opened")
    # only whether two groups are linked counts: leaders first, and no group is opened for one that it is connected with by then
    leader = grouped.where("class = grp").select(F.col("grp").alias("other"), F.col("n").alias("m"), F.col("tokens").alias("ot"))
    met = learn(opened.join(grouped.select("class", "n", "tokens"), "class"), leader, ["other"], "class", deal)
    first = materialise(met.where(similar(F.col("tokens"), F.col("ot"), F.col("n"), F.col("m"), percent)).select("mine", "other").distinct(), "links")
    so_far = components(first, "mine", "other")
    groups = opened.select("mine", "other").distinct()
    for c in ("mine", "other"):
        groups = groups.join(so_far.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left").withColumn(f"{c}_root", F.coalesce(f"{c}_root", c))
    unknown = groups.where("mine_root <> other_root").select("mine", "other")
    links = first.unionByName(member_links(learn(opened, unknown, ["mine", "other"], "class", deal), grouped, parts, percent))
    roots = components(links, "mine", "other").withColumnRenamed("node", "grp")
    comp = parts.select("grp").join(roots, "grp", "left").select("grp", F.coalesce("root", "grp").alias("comp"))
    of_class = learn(grouped.select("class", "grp"), comp, ["grp"], "class", deal).select("class", "comp")
    full = sets.select("class", "id", "mark", "n").join(of_class, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    return rows, full, deal


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: key, ``n_shingles`` and ``component_id``, the smallest key reachable by links.

    A-Z are lower-cased; words are runs of bytes other than space and U+0009 to U+000D.  A text with fewer than ``k``
    words has its whole sequence as one shingle; null texts and those without words have none and are
    linked with nothing.  Rows with equal keys are linked by their texts only.  A null key counts as the largest.
    """
    rows, full, deal = components_of_classes(docs, key, text, k, percent)
    least = full.groupBy("comp").agg(F.min("id").alias("least"))
    per_class = learn(full, least, ["comp"], "class", deal).select("class", "n", "least")
    out = learn(rows, per_class, ["class"], "id", deal)
    real = lambda c: F.when(c != LAST, c)
    return out.select(real(F.col("id")).alias(key), F.col("n").alias("n_shingles"), real(F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id"))).alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns: of each linked group the one with the smallest key.

    Texts without words are linked with nothing and stay.  Of rows with equal key and text the first
    in order of the other columns stays.
    """
    rows, full, deal = components_of_classes(docs, key, text, k, percent)
    i, m, copies, turn = fresh(docs, "_id", "_mark", "_copies", "_turn")
    first = full.where("n > 0").groupBy("comp").agg(F.min(F.struct("id", "mark")).alias("r")).select("r.*")
    blank = rows.join(full.where("n = 0").select("class"), "class", "left_semi").select("id", "mark").distinct()
    counted = rows.groupBy("id", "mark").agg(F.count(F.lit(1)).alias(copies))
    chosen = counted.join(first.withColumn("one", F.lit(True)).unionByName(blank.withColumn("one", F.lit(False))), ["id", "mark"])
    chosen = materialise(chosen.select(F.col("id").alias(i), F.col("mark").alias(m), F.when(F.col("one"), F.col(copies)).otherwise(1).alias(copies)), "chosen")
    marked = docs.withColumn(i, F.coalesce(F.col(key).cast("long"), F.lit(LAST))).withColumn(m, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    kept = marked.join(chosen, [i, m])
    again = Window.partitionBy(i, m).orderBy(*[c for c in docs.columns if c not in (key, text)] or [F.lit(0)])
    single = kept.where(F.col(copies) > 1).dropDuplicates().withColumn(turn, F.row_number().over(again)).where(F.col(turn) == 1)
    return kept.where(F.col(copies) == 1).select(*docs.columns).unionByName(single.select(*docs.columns))


@query("op4_token_groups")
def op4(spark, sf):
    return link(table(spark, sf, "documents").select("doc_id", "text"))

