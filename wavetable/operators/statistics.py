"""Group comparisons, rank statistics, similarity and resampling.

Everything is built from mergeable aggregates.  Similarity between samples never pairs them: sums of
pairwise products follow from the sum vectors of the groups.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetable.functions import stats as fx
from wavetable.functions.series import norm
from wavetable.operators.rollup import unpivot
from wavetable.operators.scale import checked_broadcast, exact_percentiles, hash_bucket, hash_key, null_safe_join, ranked, running_totals, with_totals
from wavetable.operators.vectorsums import position_sums, vector_sums
from wavetable.session import materialise

c = F.col
DRAW_CHUNK = 128  # resamples whose sums travel as one vector
#: P(X <= k) of a Poisson distribution with mean 1, for all k that 52 bits can tell apart
POISSON_EDGES = [float(x) for x in np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])]


def sides(df: DataFrame, by: str, contrasts: dict[str, tuple[Sequence, Sequence]]) -> DataFrame:
    """Copy each row to the contrasts it takes part in, with ``side`` 1 (first group) or 0."""
    parts = [
        F.struct(F.lit(n).alias("contrast"), F.when(c(by).isin(list(a)), 1).when(c(by).isin(list(b)), 0).alias("side"))
        for n, (a, b) in contrasts.items()
    ]
    return df.withColumn("_s", F.explode(F.array(*parts))).select(*df.columns, "_s.contrast", "_s.side").where("side is not null")


def two_group_moments(long_df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean, sample variance and count of both sides in one aggregation."""
    v = lambda s: F.when(c("side") == s, F.nanvl(c(value), F.lit(None).cast("double")))
    aggs = []
    for n, s in (("a", 1), ("b", 0)):
        aggs += [F.avg(v(s)).alias(f"m{n}"), F.var_samp(v(s)).alias(f"v{n}"), F.count(v(s)).alias(f"n{n}")]
    return long_df.groupBy(*keys).agg(*aggs)


def moment_args() -> tuple[Column, ...]:
    return tuple(c(x) for x in ("ma", "va", "na", "mb", "vb", "nb"))


def effect_sizes(df: DataFrame, features: Sequence[str], by: str, contrasts: dict[str, tuple[Sequence, Sequence]]) -> DataFrame:
    """Cohen's d (both poolings) of every feature for every contrast."""
    m = two_group_moments(sides(unpivot(df, [by], features), by, contrasts), ["feature", "contrast"])
    return m.select(
        "feature", "contrast",
        fx.cohens_d(*moment_args()).alias("d"), fx.cohens_d_unweighted(*moment_args()).alias("d_unweighted"), "na", "nb",
    )


def welch(long_df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Welch t and its degrees of freedom per key; needs a ``side`` column."""
    m = two_group_moments(long_df, keys, value)
    return m.select(*keys, fx.welch_t(*moment_args()).alias("t"), fx.welch_df(c("va"), c("na"), c("vb"), c("nb")).alias("df"))


def rank_sums(long_df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mann-Whitney U, tie-corrected z and p, AUROC and its symmetric form per key."""
    keys = list(keys)
    ok = long_df.where(c(value).isNotNull() & ~F.isnan(value)).withColumn(value, c(value) + F.lit(0.0))
    one = lambda s: F.when(c("side") == s, F.lit(1)).otherwise(F.lit(0)).cast("long")
    t = running_totals(ok, keys, value, {"n1": one(1), "n0": one(0)})
    d = lambda x: c(x).cast("double")
    g = t.groupBy(*keys).agg(
        F.sum(d("n1") * (d("n0_before") + d("n0") / 2)).alias("u"),
        F.sum(d("n1")).alias("na"),
        F.sum(d("n0")).alias("nb"),
        F.sum(F.pow(d("n1") + d("n0"), F.lit(3.0)) - (d("n1") + d("n0"))).alias("ties"),
    )
    n = c("na") + c("nb")
    auc = F.try_divide(c("u"), c("na") * c("nb"))
    var = F.try_divide(c("na") * c("nb"), F.lit(12.0)) * ((n + 1) - F.try_divide(c("ties"), n * (n - 1)))
    z = F.try_divide(F.greatest(F.abs(c("u") - c("na") * c("nb") / 2) - 0.5, F.lit(0.0)), F.sqrt(var))
    return g.select(
        *keys, "u", auc.alias("auroc"), F.greatest(auc, 1 - auc).alias("auroc_sym"), z.alias("z"),
        fx.normal_two_sided(z).alias("p"), c("na").cast("long").alias("na"), c("nb").cast("long").alias("nb"),
    )


def anova(long_df: DataFrame, keys: Sequence[str], by: str, value: str = "value") -> DataFrame:
    """One-way F per key over the classes in ``by``."""
    g = long_df.groupBy(*keys, by).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    a = g.groupBy(*keys).agg(
        F.sum("n").cast("double").alias("N"), F.count(F.lit(1)).cast("double").alias("k"),
        F.sum(c("n") * c("m")).alias("s"), F.sum(c("n") * c("m") * c("m")).alias("sm"), F.sum(c("n") * c("v")).alias("ssw"),
    )
    between = F.try_divide(c("sm") - c("s") * c("s") / c("N"), c("k") - 1)
    within = F.try_divide(c("ssw"), c("N") - c("k"))
    return a.select(*keys, F.try_divide(between, within).alias("f"), c("N").cast("long").alias("n"))


def variance_ratio(df: DataFrame, by: str, y: str = "y") -> DataFrame:
    """Between-label share of the total variance of series."""
    g = position_sums(df, [by], y).select("pos", by, "n", (c("s") / c("n")).alias("m"), (c("m2") / c("n")).alias("s"))
    p = g.groupBy("pos").agg(
        F.sum(c("n") * c("m") * c("m")).alias("q"), F.sum(c("n") * c("m")).alias("t"), F.sum("n").alias("N"), F.sum(c("n") * c("s")).alias("w")
    )
    between = F.sum(c("q") - c("t") * c("t") / c("N"))
    return p.agg(F.try_divide(between, between + F.sum("w")).alias("ratio"))


# ---------------------------------------------------------------- dependence between features

def mutual_information(df: DataFrame, features: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Mutual information (nats) between each feature, cut into exact quantile bins, and the label."""
    return information(unpivot(df, [label], features), ["feature"], label, bins)


def information(flat: DataFrame, keys: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Mutual information per ``keys`` of the long column ``value`` with the label; nulls and NaN are left out."""
    from wavetable.operators.ranking import quantile_bins

    keys = list(keys)
    u = quantile_bins(materialise(flat.where("value is not null and not isnan(value)"), "mi"), "value", bins, keys)
    cells = u.groupBy(*keys, "bin", label).agg(F.count(F.lit(1)).alias("n"))
    # the contingency table is at most bins x labels per key
    wf, wb, wl = Window.partitionBy(*keys), Window.partitionBy(*keys, "bin"), Window.partitionBy(*keys, label)
    t = cells.select(*keys, "n", F.sum("n").over(wf).alias("nt"), F.sum("n").over(wb).alias("nb"), F.sum("n").over(wl).alias("nl"))
    return t.groupBy(*keys).agg(F.sum(c("n") / c("nt") * F.log(c("n") * c("nt") / (c("nb") * c("nl")))).alias("mi"))


EULER = 0.5772156649015329
NEIGHBOUR_BLOCK = 4_096  # ranks whose neighbours one task looks up; a few more on either side belong to it as a halo


def digamma(n: Column) -> Column:
    """Digamma of a whole number from 1: exact harmonic sums below 6, the asymptotic series above (error under 1e-9)."""
    small = F.array(*[F.lit(sum(1.0 / i for i in range(1, m)) - EULER) for m in range(1, 6)])
    x = n.cast("double")
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    return F.when(n < 6, F.get(small, (n - 1).cast("int"))).otherwise(series)


def nearest_information(flat: DataFrame, keys: Sequence[str], label: str, k: int = 3) -> DataFrame:
    """Mutual information per ``keys`` of the long column ``value`` with a label, from nearest neighbours.

    The distance from a value to its k-th nearest of the same label (fewer, if the label has fewer) is compared with how many values of any
    label lie closer.  Neighbours are found among ranks, in blocks with a halo from the blocks beside them; values inside a distance are counted
    from running totals at its two ends.  No group is gathered and no pairs are made.  Labels with one value are left out.
    """
    keys = list(keys)
    own = [*keys, label]
    flat = materialise(flat.where(F.col("value").isNotNull() & ~F.isnan("value")).select(*own, (c("value") + 0.0).alias("value")), "values")
    edges = flat.groupBy(*own).agg(F.percentile_approx("value", [i / 64 for i in range(1, 64)], 1_000).alias("_edges"), F.count(F.lit(1)).alias("_n"))
    many = null_safe_join(flat, checked_broadcast(edges), own).where("_n > 1")
    rows = ranked(many, own, [c("value")], F.size(F.filter("_edges", lambda e: e < c("value"))), "_r").drop("_edges")
    at = F.floor((c("_r") - 1) / NEIGHBOUR_BLOCK)
    near = F.filter(F.array(at - 1, at, at + 1), lambda b: (c("_r") - 1 >= b * NEIGHBOUR_BLOCK - k) & (c("_r") - 1 < (b + 1) * NEIGHBOUR_BLOCK + k))
    blocks = rows.withColumn("_at", at).withColumn("_b", F.explode(near))
    line = Window.partitionBy(*own, "_b").orderBy("_r")
    sides = [F.struct((c("value") - F.lag("value", j).over(line)).alias("d"), F.lit(0).alias("side"), F.lag("value", j).over(line).alias("v")) for j in range(1, k + 1)]
    sides += [F.struct((F.lead("value", j).over(line) - c("value")).alias("d"), F.lit(1).alias("side"), F.lead("value", j).over(line).alias("v")) for j in range(1, k + 1)]
    kk = F.least(F.lit(k), c("_n") - 1).cast("int")
    seen = blocks.withColumn("_s", F.array(*sides)).where("_b = _at").withColumn("_k", kk)
    kth = F.element_at(F.array_sort(F.filter("_s", lambda s: s["d"].isNotNull())), c("_k"))
    seen = seen.select(*own, "value", "_n", "_k", kth.alias("s")).select(
        *own, "_n", "_k", c("s.d").alias("_d"), F.when(c("s.side") == 0, c("s.v")).otherwise(c("value") - c("s.d")).alias("_lo"), F.when(c("s.side") == 1, c("s.v")).otherwise(c("value") + c("s.d")).alias("_hi")
    )
    seen = materialise(seen, "neighbours")
    points = many.select(*keys, "value", F.lit(1).alias("one"))
    for end in ("_lo", "_hi"):
        points = points.unionByName(seen.select(*keys, c(end).alias("value"), F.lit(0).alias("one")))
    totals = materialise(running_totals(points, keys, "value", {"n": c("one")}), "totals")
    below = totals.select(*keys, c("value").alias("_hi"), c("n_before").alias("_below"))
    upto = totals.select(*keys, c("value").alias("_lo"), (c("n_before") + c("n")).alias("_upto"), c("n").alias("_same"))
    met = null_safe_join(null_safe_join(seen, below, [*keys, "_hi"]), upto, [*keys, "_lo"])
    m = F.when(c("_d") == 0, c("_same")).otherwise(c("_below") - c("_upto"))
    g = met.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"), (F.avg(digamma(c("_k"))) - F.avg(digamma(c("_n"))) - F.avg(digamma(m))).alias("_part"))
    return g.select(*keys, F.greatest(F.lit(0.0), digamma(c("_all")) + c("_part")).alias("mi"))


def correlations(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pearson r of every feature pair (i < j).  One pass builds the k x k matrix."""
    k = len(features)
    m = Correlation.corr(df.select(array_to_vector(F.array(*features)).alias("f")), "f").first()[0].toArray()
    rows = [(features[i], features[j], float(m[i, j])) for i in range(k) for j in range(i + 1, k)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


# ---------------------------------------------------------------- similarity without pairs

def _unit(df: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    return df.select(*keys, y, norm(y).alias("_n")).select(*keys, F.transform(y, lambda v: F.try_divide(v, c("_n"))).alias("u"))


def class_cosine(df: DataFrame, by: str, y: str = "y") -> DataFrame:
    """Mean cosine between samples of every pair of classes; pairs of a sample with itself excluded.

    With unit rows u, the sum of all cosines between classes a and b is <sum_a u, sum_b u>.
    """
    s = position_sums(_unit(df, [by], y), [by], "u")
    a = s.select(c(by).alias("a"), "pos", c("s").alias("sa"), c("n").alias("na"))
    b = s.select(c(by).alias("b"), "pos", c("s").alias("sb"), c("n").alias("nb"))
    g = a.join(b, "pos").where(c("a") <= c("b")).groupBy("a", "b").agg(F.sum(c("sa") * c("sb")).alias("d"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    same = c("a") == c("b")
    pairs = F.when(same, c("na") * (c("na") - 1) / 2).otherwise(c("na") * c("nb")).cast("double")
    total = F.when(same, (c("d") - c("na")) / 2).otherwise(c("d"))
    return g.select("a", "b", pairs.cast("long").alias("n_pairs"), F.try_divide(total, pairs).alias("mean_cosine"))


def batch_effect(df: DataFrame, batch: str, y: str = "y") -> DataFrame:
    """Mean squared distance between samples of the same batch and of different batches, and the ratio.

    The sum over pairs inside a group is n * sum|x|^2 - |sum x|^2, so no pair is ever formed.
    """
    per = position_sums(df, [batch], y).select(batch, "pos", "n", "s", (c("m2") + c("s") * c("s") / c("n")).alias("q"))
    inner = per.agg(
        F.sum(c("n") * c("q") - c("s") * c("s")).alias("inside"),
        F.sum(F.when(c("pos") == 0, c("n") * (c("n") - 1) / 2)).alias("pairs_in"),
    )
    total = per.groupBy("pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).agg(
        F.sum(c("n") * c("q") - c("s") * c("s")).alias("all"), F.max(c("n") * (c("n") - 1) / 2).alias("pairs_all")
    )
    same = F.try_divide(c("inside"), c("pairs_in"))
    other = F.try_divide(c("all") - c("inside"), c("pairs_all") - c("pairs_in"))
    return with_totals(inner, total).select(same.alias("same_batch_squared"), other.alias("other_batch_squared"), F.try_divide(same, other).alias("squared_ratio"))


def silhouette(df: DataFrame, key: str, by: str, y: str = "y", max_clusters: int = 1_000) -> DataFrame:
    """Squared-distance silhouette of every row against the clusters in ``by``.

    The mean squared distance from a row to a cluster is |x|^2 - 2 x.mean + mean|.|^2 of the cluster, so
    a row meets cluster summaries, never other rows.  The number of clusters is checked.
    """
    from wavetable.functions.series import row_map

    mean = c("s") / c("n")
    per = position_sums(df, [by], y).select(by, "pos", mean.alias("m"), (c("m2") / c("n") + mean * mean).alias("q"), "n")
    packed = per.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("s"), F.sum("q").alias("q"), F.max("n").alias("n"))
    rows = packed.limit(max_clusters + 1).collect()
    if len(rows) > max_clusters:
        raise ValueError(f"more than {max_clusters} clusters")
    rows = sorted(rows, key=lambda r: r[by])
    means, q, n = np.array([[p.m for p in r.s] for r in rows]), np.array([r.q for r in rows]), [int(r.n) for r in rows]
    dist = row_map(lambda x: (x**2).sum(1, keepdims=True) - 2 * x @ means.T + q)(y)
    names = [r[by] for r in rows]
    d = df.select(key, by, dist.alias("_d"))
    items = [F.struct(F.lit(v).alias("k"), F.lit(m).alias("n"), c("_d")[i].alias("d")) for i, (v, m) in enumerate(zip(names, n))]
    own = F.filter(F.array(*items), lambda t: t["k"] == c(by))[0]
    a = F.try_divide(own["d"] * own["n"], (own["n"] - 1).cast("double"))
    b = F.array_min(F.transform(F.filter(F.array(*items), lambda t: t["k"] != c(by)), lambda t: t["d"]))
    return d.select(key, by, F.when(own["n"] == 1, F.lit(0.0)).otherwise(F.try_divide(b - a, F.greatest(a, b))).alias("silhouette"))


# ---------------------------------------------------------------- resampling and paired tests

def bootstrap_means(df: DataFrame, keys: Sequence[str], order: str, value: str, draws: int, seed: int = 0) -> DataFrame:
    """Mean of ``value`` in each of ``draws`` resamples, per key; nulls are left out.

    A row counts in resample b as often as a Poisson(1) number from md5(seed, b, its order key) says, so a resample is a sum over rows:
    tasks add whole chunks of resamples as vectors, and what is shuffled does not grow with the number of rows.  A resample
    that draws no row has no mean.
    """
    keys = list(keys)
    chunk = F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // DRAW_CHUNK)))
    rows = df.where(c(value).isNotNull()).select(*keys, c(order).alias("_o"), c(value).cast("double").alias("_v"), chunk.alias("_c"))
    mine = F.sequence(c("_c") * DRAW_CHUNK, F.least((c("_c") + 1) * DRAW_CHUNK, F.lit(draws)) - 1)

    def uniform(b: Column) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), b.cast("string"), c("_o").cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)

    # two steps: inside one, the hash would be computed for every edge
    weight = lambda u: reduce(lambda n, edge: n + F.when(u >= edge, 1.0).otherwise(0.0), POISSON_EDGES, F.lit(0.0))
    drawn = rows.select(*keys, "_c", "_v", F.transform(F.transform(mine, uniform), weight).alias("_w"))
    both = F.concat(F.transform("_w", lambda w: w * c("_v")), c("_w"))
    sums = vector_sums(drawn.select(*keys, "_c", both.alias("_s")), [*keys, "_c"], "_s")
    half = (F.size("s") / 2).cast("int")
    means = F.transform(F.slice("s", F.lit(1), half), lambda v, i: F.try_divide(v, F.get("s", half + i)))
    out = sums.select(*keys, "_c", F.posexplode(means).alias("_i", "mean")).where("mean is not null")
    return out.select(*keys, (c("_c") * DRAW_CHUNK + c("_i")).alias("b"), "mean")


def bootstrap_interval(df: DataFrame, keys: Sequence[str], order: str, value: str, draws: int, seed: int = 0) -> DataFrame:
    """Observed mean with a 95 % percentile interval."""
    means = bootstrap_means(df, keys, order, value, draws, seed)
    seen = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    return null_safe_join(seen, exact_percentiles(means, list(keys), "mean", {"lo": 0.025, "hi": 0.975}), list(keys))


def mcnemar(df: DataFrame, key: str, model: str, correct: str, a, b) -> DataFrame:
    """Paired 2 x 2 counts of two models on the same keys and the exact two-sided p."""
    left = df.where(c(model) == a).select(key, c(correct).alias("ok_a"))
    right = df.where(c(model) == b).select(key, c(correct).alias("ok_b"))
    n = left.join(right, key).agg(
        F.count_if(c("ok_a") & c("ok_b")).alias("both"), F.count_if(c("ok_a") & ~c("ok_b")).alias("only_a"),
        F.count_if(~c("ok_a") & c("ok_b")).alias("only_b"), F.count_if(~c("ok_a") & ~c("ok_b")).alias("neither"),
    )
    return n.withColumn("p", fx.binomial_two_sided(F.least("only_a", "only_b"), c("only_a") + c("only_b")))


def overlap_interval(df: DataFrame, by: str, value: str, a, b) -> DataFrame:
    """Interval covered by the ranges of two groups, and how many of each lie in it."""
    v = lambda k: F.when(c(by) == k, c(value))
    edges = df.agg(F.greatest(F.min(v(a)), F.min(v(b))).alias("lo"), F.least(F.max(v(a)), F.max(v(b))).alias("hi"))
    inside = c(value).between(c("lo"), c("hi"))
    return with_totals(df, edges).groupBy("lo", "hi").agg(
        F.count_if((c(by) == a) & inside).alias("n_a"), F.count_if((c(by) == b) & inside).alias("n_b")
    )


def verdict(df: DataFrame, clear: Column, by: Sequence[str], wanted: int) -> DataFrame:
    """A when every wanted row is clear, B when some are, C when none is."""
    g = df.groupBy(*by).agg(F.count_if(clear).alias("n_clear"))
    return g.withColumn("branch", F.when(c("n_clear") >= wanted, "A").when(c("n_clear") > 0, "B").otherwise("C"))
