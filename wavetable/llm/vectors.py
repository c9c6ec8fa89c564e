"""Approximate nearest neighbours: an NN-descent graph and greedy search on it.

Graph.  Random-projection cells of bounded size give each vector a first list of neighbours.  An entry of a list is new until
a round has picked it.  Every round picks new and old neighbours and reverse neighbours of each vector and compares the new ones with
each other and with the old ones (neighbours of neighbours), so a pair is not compared again because nothing changed; lists keep
their nearest.  Rounds end when less than ``CONVERGED`` of the entries are new.

Search.  A query walks from its own list: it asks the blocks that hold its candidates for their distances
and, where these are near enough, their neighbours, keeps the nearest of a beam, and ends when the neighbours of
all of them have been looked at.  Tree depth, list length and beam grow with the table.  Distances of the search are computed in double precision on the given
vectors; only the graph is built from half-precision copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavetable.llm.blocks import mix
from wavetable.llm.common import bucketed, query, table
from wavetable.session import materialise

GROWS = 20_000  # vectors above which lists and beam grow
NEIGHBOURS = 24  # length of a list; 4 more for each doubling of the table
TREES = 3
CELL = 1_500  # vectors of a cell, in expectation at most
SAMPLE, PER_LEAF = 20_000, 16  # vectors that the cells are fitted on, in expectation, and how many of them the smallest fitted node holds
JOINED = 10  # new neighbours of a vector that a round picks; as many old ones and reverse ones of either kind
CONVERGED = 0.02  # share of list entries that are new after the last round
BEAM = 320  # times the square root of the table's growth
BLOCK = 2_048  # vectors of a block
CENTERS = 8_192  # vectors whose neighbours one task brings together; it sends one list per id, so the more, the fewer
LISTS = "id long, nbr array<long>, dist array<float>, new array<boolean>"


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): one row per key with a vector that is not null, not zero, and whose components are all finite numbers.

    Of several rows with one key, the vector that comes first in order counts.
    """
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.coalesce(good, F.lit(False))).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)


def _lists(rows: np.ndarray, nbr: np.ndarray, dist: np.ndarray, new: np.ndarray, ids: np.ndarray, keep: int) -> pa.Table:
    """The ``keep`` nearest distinct neighbours of each of ``ids`` from flat (row, neighbour, squared distance, new) rows.

    A neighbour that is there more than once is as old as its oldest entry.
    """
    order = np.lexsort((new, nbr, rows))
    rows, nbr, dist, new = rows[order], nbr[order], dist[order], new[order]
    first = np.append(True, (rows[1:] != rows[:-1]) | (nbr[1:] != nbr[:-1])) if len(rows) else np.zeros(0, bool)
    rows, nbr, dist, new = rows[first], nbr[first], dist[first], new[first]
    order = np.lexsort((nbr, dist, rows))
    rows, nbr, dist, new = rows[order], nbr[order], dist[order], new[order]
    start = np.searchsorted(rows, np.arange(len(ids)))
    top = np.arange(len(rows)) - start[rows] < keep
    rows, nbr, dist, new = rows[top], nbr[top], dist[top], new[top]
    cut = pa.array(np.searchsorted(rows, np.arange(len(ids) + 1)).astype(np.int32))
    columns = [pa.array(nbr), pa.array(dist.astype(np.float32)), pa.array(new.astype(bool))]
    return pa.table([pa.array(ids), *[pa.ListArray.from_arrays(cut, c) for c in columns]], ["id", "nbr", "dist", "new"])


def _merge(keep: int):
    def merge(t: pa.Table) -> pa.Table:
        ids, back = np.unique(t["id"].to_numpy(), return_inverse=True)
        nbr, dist, new = (t[c].combine_chunks() for c in ("nbr", "dist", "new"))
        n = np.diff(nbr.offsets.to_numpy())
        return _lists(np.repeat(back, n), nbr.flatten().to_numpy(), dist.flatten().to_numpy(), new.flatten().to_numpy(zero_copy_only=False), ids, keep)

    return merge


def cells(vectors: DataFrame, n: int, trees: int, cell: int, seed: int) -> DataFrame:
    """(tree, cell, id, v): each vector in one cell per tree.

    A tree has one direction per level and the medians of a sample of bounded size at its nodes; levels below the smallest node that
    the sample fits are cut at the medians of that node's sample along their own directions. A cell larger than
    twice ``cell`` is split by hash.
    """
    share = min(1.0, SAMPLE / max(n, 1))
    sample = _matrix(vectors.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").toArrow()["v"]) if n else np.zeros((0, 1))
    depth = int(max(0, np.ceil(np.log2(max(n, 1) / cell))))
    fitted_depth = int(max(0, min(depth, np.floor(np.log2(max(len(sample), 1) / PER_LEAF)))))
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    fitted = []
    for _ in range(trees):
        directions = rng.standard_normal((dims, depth))
        at, cuts = np.zeros(len(sample), np.int64), []
        for level in range(depth):
            p = sample @ directions[:, level]
            order = np.argsort(at, kind="stable")
            nodes = np.split(p[order], np.searchsorted(at[order], np.arange(1, 1 << min(level, fitted_depth))))
            cuts.append(np.array([np.median(x) if len(x) else 0.0 for x in nodes]))
            if level < fitted_depth:
                at = 2 * at + (p > cuts[-1][at])
        fitted.append((directions, cuts))

    def place(batches):
        for b in batches:
            x = _matrix(b["v"])
            for tree, (directions, cuts) in enumerate(fitted):
                at = np.zeros(len(x), np.int64)
                for level, cut in enumerate(cuts):
                    at = 2 * at + (x @ directions[:, level] > cut[at >> max(0, level - fitted_depth)])
                yield pa.record_batch([pa.array(np.full(len(x), tree, np.int32)), pa.array(at), b["id"], b["v"]], ["tree", "cell", "id", "v"])

    placed = vectors.mapInArrow(place, "tree int, cell long, id long, v array<double>")
    sizes = placed.groupBy("tree", "cell").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 2 * cell)
    # only overfull cells are listed here: at most n * trees / (2 * cell) rows
    split = placed.join(sizes, ["tree", "cell"], "left")
    return split.withColumn("part", F.coalesce(F.pmod(F.xxhash64("id", "tree"), F.ceil(F.col("size") / cell)), F.lit(0)).cast("int")).drop("size")


def neighbour_graph(vectors: DataFrame, n: int, keep: int = NEIGHBOURS, trees: int = TREES, cell: int = CELL, joined: int = JOINED, converged: float = CONVERGED, seed: int = 7) -> DataFrame:
    """(id, nbr, dist): approximate nearest neighbours of every vector, nearest first, with squared distances."""
    blocks = max(1, n // BLOCK)

    def inside(t: pa.Table) -> pa.Table:
        x, ids = _matrix(t["v"]).astype(np.float32), t["id"].to_numpy()
        sq = (x * x).sum(1)
        rows, nbr, dist = [], [], []
        k = min(keep, len(ids) - 1)
        for a in range(0, len(ids) if k > 0 else 0, 512):
            d = np.maximum(sq[a : a + 512, None] + sq - 2 * x[a : a + 512] @ x.T, 0)
            m = len(d)
            d[np.arange(m), a + np.arange(m)] = np.inf
            top = np.argpartition(d, k - 1, 1)[:, :k]
            rows.append(np.repeat(np.arange(a, a + m), k)), nbr.append(ids[top].ravel()), dist.append(np.take_along_axis(d, top, 1).ravel())
        empty = np.zeros(0, np.int64)
        rows, nbr, dist = np.concatenate([empty, *rows]), np.concatenate([empty, *nbr]), np.concatenate([empty.astype(np.float32), *dist])
        return _lists(rows, nbr, dist, np.ones(len(rows), bool), ids, keep)

    def merged(lists: DataFrame, name: str) -> DataFrame:
        return materialise(lists.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks))).applyInArrow(_merge(keep), LISTS), name)

    graph = merged(cells(vectors, n, trees, cell, seed).groupBy("tree", "cell", "part").applyInArrow(inside, LISTS), "graph")

    def half(batches):
        for b in batches:
            x = _matrix(b["v"])
            scale = np.abs(x).max(initial=1e-300)  # half precision has a narrow range
            yield pa.record_batch([b["id"], pa.array([r.tobytes() for r in x.astype(np.float32)] if scale > 1e4 or scale < 1e-3 else [r.tobytes() for r in x.astype(np.float16)], pa.binary())], ["id", "h"])

    def vector_of(raw: pa.ChunkedArray, dims: int) -> np.ndarray:
        return np.stack([np.frombuffer(r.as_py(), np.float16 if len(r.as_py()) == 2 * dims else np.float32).astype(np.float32) for r in raw])

    dims = vectors.select(F.size("v")).first()[0] if n else 0

    def compare(t: pa.Table) -> pa.Table:
        """Per id of the part its nearest among those that a common vector brought it together with for the first time."""
        t = t.sort_by([("center", "ascending"), ("id", "ascending")])
        center, ids, worst, new = (t[c].to_numpy() for c in ("center", "id", "worst", "new"))
        code = codes(ids)
        known = np.repeat(code[:, None], keep, 1)  # short lists are filled up with the id itself
        for row, k in enumerate(t["known"]):
            k = np.frombuffer(k.as_py(), np.uint16)
            known[row, : len(k)] = k
        x = vector_of(t["h"], dims)
        sq = (x * x).sum(1)
        edge = np.flatnonzero(np.append(True, center[1:] != center[:-1]))
        us, ws, ds = [], [], []
        for a, z in zip(edge, np.append(edge[1:], len(center)), strict=True):
            d = np.maximum(sq[a:z, None] + sq[a:z] - 2 * x[a:z] @ x[a:z].T, 0)
            i, j = np.nonzero((d < worst[a:z, None]) & (ids[a:z, None] != ids[a:z]) & (new[a:z, None] | new[a:z]))
            fresh = (known[a + i] != code[a + j, None]).all(1)
            i, j = i[fresh], j[fresh]
            us.append(ids[a + i]), ws.append(ids[a + j]), ds.append(d[i, j])
        u, back = np.unique(np.concatenate(us), return_inverse=True)
        return _lists(back, np.concatenate(ws), np.concatenate(ds), np.ones(len(back), bool), u, keep)

    packed = materialise(vectors.mapInArrow(half, "id long, h binary"), "half")
    r, pending = 0, 1.0
    while n > 1 and pending > converged:
        graph, around = picked(graph, joined, seed + r)
        ends = F.when(F.size("dist") < keep, float("inf")).otherwise(F.array_max("dist")).cast("float").alias("worst")
        known = packed.join(graph.select("id", ends, "nbr"), "id").mapInArrow(coded, "id long, h binary, worst float, known binary")
        local = around.join(known, "id").groupBy(F.pmod(F.xxhash64("center"), F.lit(max(1, n // CENTERS))).alias("part")).applyInArrow(lambda t: compare(t), LISTS)
        graph = merged(graph.union(local), "graph")
        pending = graph.agg((F.sum(F.size(F.filter("new", lambda x: x))) / F.sum(F.size("new"))).alias("share")).first()["share"] or 0.0
        r += 1
    return graph.select("id", "nbr", "dist")


def codes(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def coded(batches):
    """The list of each id as 16-bit codes of its entries, so that listed pairs are not sent again; equal codes of two ids hide one candidate in 2,000."""
    for b in batches:
        nbr = b["nbr"]
        listed = codes(nbr.flatten().to_numpy())
        cut = nbr.offsets.to_numpy() - nbr.offsets[0].as_py()
        yield pa.record_batch([b["id"], b["h"], b["worst"], pa.array([listed[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["id", "h", "worst", "known"])


def picked(graph: DataFrame, joined: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(the graph with what was picked no longer new, (center, id, new): what each center brings together in this round).

    About ``joined`` new and as many old entries of every list are picked by hash, and of the reverse entries of a vector about as many again.
    """
    u = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 20)) / float(1 << 20)
    entries = F.transform("nbr", lambda b, i: F.struct(b.alias("b"), F.get("new", i).alias("new")))
    count = F.size(F.filter("new", lambda x: x))
    chosen = lambda a, b, new: u(a, b, F.lit(seed)) * F.when(new, F.col("fresh")).otherwise(F.size("nbr") - F.col("fresh")) < joined
    marked = graph.withColumn("fresh", count).withColumn("entries", entries)
    took = F.filter("entries", lambda e: chosen(F.col("id"), e["b"], e["new"]))
    edges = marked.select(F.col("id").alias("a"), F.explode(took).alias("e")).select("a", "e.b", "e.new")
    degree = edges.groupBy("b", "new").agg(F.count(F.lit(1)).alias("degree"))
    back = edges.join(degree, ["b", "new"]).where(u("b", "a", F.lit(-seed)) * F.col("degree") < joined).select(F.col("b").alias("center"), F.col("a").alias("id"), "new")
    around = edges.select(F.col("a").alias("center"), F.col("b").alias("id"), "new").union(back).groupBy("center", "id").agg(F.max("new").alias("new"))
    still = F.transform("entries", lambda e: e["new"] & ~chosen(F.col("id"), e["b"], e["new"]))
    return marked.select("id", "nbr", "dist", still.alias("new")), around


NEARLY = 1 + 1e-12
NODES = "blk int, id long, v array<double>, adj array<long>"
STATE = "q long, qv array<double>, width int, seen array<long>, done array<long>, best array<long>, dist array<double>, open array<struct<blk:int,ids:array<long>>>"
OPEN = pa.list_(pa.struct([("blk", pa.int32()), ("ids", pa.list_(pa.int64()))]))


def block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) % np.uint64(blocks)).astype(np.int32)


def by_block(ids: np.ndarray, blocks: int) -> list[dict]:
    """The ids that a query asks about, one list per block: a round sends a row per query and block, not per id."""
    if not len(ids):
        return []
    at = block_of(ids, blocks)
    order = np.argsort(at, kind="stable")
    cut = np.flatnonzero(np.diff(at[order], prepend=-1))
    return [{"blk": int(at[order[i]]), "ids": ids[order[i:j]]} for i, j in zip(cut, np.append(cut[1:], len(ids)), strict=True)]


def walk(nodes: DataFrame, blocks: int, starts: DataFrame, beam: int) -> DataFrame:
    """(q, best, dist): the nearest ids that each query's walk has found, nearest first.

    ``nodes``: id, vector and adjacent ids by block; ``starts``: q, its vector and the ids to look at first.
    An id is asked again when a grown width takes in a place that was too far before.  Every round stores its state, so a lost
    executor costs one round.
    """
    parts = max(1, blocks)

    def begin(batches):
        for b in batches:
            none = [[]] * b.num_rows
            kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64())]
            empty = [pa.array(x, k) for x, k in zip([[32] * b.num_rows, none, none, none, none], kinds, strict=True)]
            first = pa.array([by_block(np.unique(a.values.to_numpy()), blocks) for a in b["adj"]], OPEN)
            yield pa.record_batch([b["q"], b["qv"], *empty, first], ["q", "qv", "width", "seen", "done", "best", "dist", "open"])

    state = materialise(starts.select("q", "qv", "adj").mapInArrow(begin, STATE), "walk")

    def measure(asked: pa.Table, held: pa.Table) -> pa.Table:
        schema = pa.schema([("q", pa.int64()), ("ids", pa.list_(pa.int64())), ("d", pa.list_(pa.float64())), ("from", pa.list_(pa.int64())), ("adj", pa.list_(pa.int64()))])
        if not len(asked) or not len(held):
            return schema.empty_table()
        held = held.sort_by("id")
        ids, x = held["id"].to_numpy(), _matrix(held["v"])
        adj = held["adj"].combine_chunks()
        cut, near = adj.offsets.to_numpy(), adj.flatten().to_numpy()
        cut = cut - cut[0]
        out = []
        for q, qv, bound, want in zip(asked["q"].to_pylist(), asked["qv"], asked["bound"].to_pylist(), asked["ids"], strict=True):
            at = np.searchsorted(ids, want.values.to_numpy())
            d = np.sqrt(((x[at] - qv.values.to_numpy()) ** 2).sum(1))
            go = at[d <= bound]
            n = cut[go + 1] - cut[go]
            flat = np.repeat(cut[go], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append((q, want.values.to_numpy(), d, np.repeat(ids[go], n), near[flat]))
        return pa.Table.from_arrays([pa.array([o[0] for o in out]), *[pa.array([o[i] for o in out], schema.types[i]) for i in range(1, 5)]], schema=schema)

    def advance(old: pa.Table, told: pa.Table) -> pa.Table:
        replies: dict[int, list] = {}
        for q, *r in zip(told["q"].to_pylist(), told["ids"], told["d"], told["from"], told["adj"], strict=True):
            replies.setdefault(q, []).append([v.values.to_numpy() for v in r])
        rows = []
        for r in range(len(old)):
            q, width = old["q"][r].as_py(), old["width"][r].as_py()
            seen, done, best, dist = (old[c][r].values.to_numpy() for c in ("seen", "done", "best", "dist"))
            asked = np.array([i for o in old["open"][r].as_py() for i in o["ids"]], np.int64)
            if len(asked):
                reach = min(2 * width, beam)
                bound = dist[reach - 1] * NEARLY if len(dist) >= reach else np.inf
                got = replies.get(q, [])
                ids, d, source, adj = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, np.int64) for i in range(4))
                new = ~np.isin(ids, seen)
                best, dist = np.append(best, ids[new]), np.append(dist, d[new])
                seen = np.union1d(seen, asked)
                width = min(beam, width * 2)
                order = np.lexsort((best, dist))[:beam]
                best, dist = best[order], dist[order]
                told_of = np.intersect1d(ids[d <= bound], best[:width])
                done = np.union1d(done, told_of)
                asked = np.union1d(np.setdiff1d(adj[np.isin(source, told_of)], seen), np.setdiff1d(best[:width], done))
                while not len(asked) and width < min(beam, len(best)):
                    width = min(beam, width * 2)
                    asked = np.setdiff1d(best[:width], done)
            rows.append((q, old["qv"][r].values.to_numpy(), width, seen, done, best, dist, by_block(asked, blocks)))
        kinds = [pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), OPEN]
        return pa.Table.from_arrays([pa.array([x[i] for x in rows], kinds[i]) for i in range(8)], names=["q", "qv", "width", "seen", "done", "best", "dist", "open"])

    held = nodes.groupBy("blk")
    while state.where(F.size("open") > 0).limit(1).count():
        live = state.where(F.size("open") > 0)
        # a candidate is expanded if it could be among the nearest of this round's width
        bound = F.coalesce(F.get("dist", F.least(F.col("width") * 2, F.lit(beam)) - 1) * NEARLY, F.lit(float("inf")))
        asked = live.select("q", "qv", bound.alias("bound"), F.explode("open").alias("o")).select("o.blk", "q", "qv", "bound", "o.ids")
        told = asked.groupBy("blk").cogroup(held).applyInArrow(measure, "q long, ids array<long>, d array<double>, from array<long>, adj array<long>")
        part = F.pmod(F.xxhash64("q"), F.lit(parts))
        state = materialise(state.groupBy(part).cogroup(told.groupBy(part)).applyInArrow(advance, STATE), "walk")
    return state.select("q", "best", "dist")


def search(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, every: int = 100, beam: int = BEAM) -> DataFrame:
    """The ``k`` nearest found of each vector whose key is divisible by ``every``: ``query_id``, ``rank``, key, ``score``.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do null keys; a key is one
    vector (of repeated rows the first in order).  Equal vectors are one node of the graph, and each answer
    expands to the smallest keys that share it, so ties go to smaller keys.  Vectors of another length than most are
    compared among themselves.  Fewer candidates than ``k`` give them all; an empty table gives no row.
    """
    rows = materialise(usable(vectors, key, vector).withColumn("dims", F.size("v")), "vectors")
    out = None
    for dims in sorted(r[0] for r in rows.select("dims").distinct().collect()):
        one = _search(rows.where(F.col("dims") == dims).select("id", "v"), k, every, beam)
        out = one if out is None else out.union(one)
    if out is None:
        out = rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("v_id"), F.lit(0.0).alias("score")).limit(0)
    return out.withColumnRenamed("v_id", key)


def _search(rows: DataFrame, k: int, every: int, beam: int) -> DataFrame:
    # equal vectors: a salted ranking keeps the k + 1 smallest keys of each, the smallest is the node
    hashed = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)))
    some = Window.partitionBy("v", "salt").orderBy("id")
    every_salt = Window.partitionBy("v").orderBy("id")
    firsts = hashed.withColumn("r", F.row_number().over(some)).where(F.col("r") <= k + 1).withColumn("r", F.row_number().over(every_salt)).where(F.col("r") <= k + 1)
    same = materialise(firsts.groupBy("v").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids")), "same")
    n = same.count()
    growth = max(1.0, n / GROWS)
    keep, beam = NEIGHBOURS + int(4 * np.log2(growth)), int(beam * growth**0.5)
    graph = neighbour_graph(same.select("id", "v"), n, keep)
    edges = graph.select(F.col("id").alias("a"), F.explode("nbr").alias("b"))
    degree = edges.groupBy("b").agg(F.count(F.lit(1)).alias("degree"))
    u = F.pmod(F.xxhash64("b", "a"), F.lit(1 << 20)) / float(1 << 20)
    back = edges.join(degree, "b").where(u * F.col("degree") < keep).select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = edges.union(back).groupBy("a").agg(F.collect_set("b").alias("adj"))
    blocks = max(1, n // BLOCK)
    nodes = same.select("id", "v").join(both.withColumnRenamed("a", "id"), "id", "left").select("id", "v", F.coalesce("adj", F.array().cast("array<long>")).alias("adj"))

    def placed(batches):
        for b in batches:
            yield pa.record_batch([pa.array(block_of(b["id"].to_numpy(), blocks)), b["id"], b["v"], b["adj"]], ["blk", "id", "v", "adj"])

    nodes = nodes.mapInArrow(placed, NODES)
    nodes = bucketed(nodes, "blk", "nodes")  # every round of the walk reads it where it lies
    queries = rows.where(F.col("id") % every == 0).withColumnsRenamed({"id": "q", "v": "qv"})
    own = same.select(F.col("v"), F.col("id").alias("node"))
    starts = queries.join(own, F.col("qv") == F.col("v")).join(nodes.select(F.col("id").alias("node"), "adj"), "node")
    found = walk(nodes, blocks, starts.select("q", "qv", F.array_append("adj", F.col("node")).alias("adj")), beam)
    hits = found.select("q", F.explode(F.arrays_zip("best", "dist")).alias("h")).select("q", F.col("h.best").alias("id"), F.col("h.dist").alias("score"))
    full = hits.join(same.select("id", "ids"), "id").select("q", "score", F.explode("ids").alias("v_id")).where("q <> v_id")
    nearest = Window.partitionBy("q").orderBy("score", "v_id")
    return full.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), "rank", "v_id", "score")


@query("op10_nn_descent")
def op10(spark, sf):
    return search(table(spark, sf, "embeddings"))
