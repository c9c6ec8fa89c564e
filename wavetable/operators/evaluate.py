"""Evaluation of class probabilities.  Probability columns are p0 .. p{k-1} in canonical class order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetable.operators.ranking import quantile_bins

c = F.col


def probs(k: int) -> list[str]:
    return [f"p{i}" for i in range(k)]


def arg_max(k: int) -> Column:
    """Index of the largest probability; ties go to the earlier class."""
    top = F.greatest(*probs(k))
    return F.coalesce(*[F.when(c(p) == top, F.lit(i)) for i, p in enumerate(probs(k))]).cast("long")


def with_prediction(df: DataFrame, k: int) -> DataFrame:
    return df.withColumn("pred", arg_max(k)).withColumn("top_p", F.greatest(*probs(k)))


def soft_vote(df: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Mean probability per file, its argmax, and the file's truth and subclass."""
    constant = [x for x in ("y_true", "subclass") if x in df.columns and x not in keys]
    g = df.groupBy(*keys).agg(*[F.min(x).alias(x) for x in constant], *[F.avg(p).alias(p) for p in probs(k)])
    return with_prediction(g, k)


def confusion(df: DataFrame, row: str, rows: Sequence, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts of every (row label, predicted class), zero cells included.

    Rows of the result: labels x classes per group.  Counts are taken first, the grid is filled from
    the vocabulary afterwards.
    """
    by = list(by)
    g = df.groupBy(*by, c(row).alias("row")).agg(*[F.count_if(c("pred") == i).alias(f"_c{i}") for i in range(k)])
    groups = g.select(*by).distinct() if by else df.sparkSession.range(1).select()
    grid = groups.select(*by, F.explode(F.array(*[F.lit(x) for x in rows])).alias("row"))
    cells = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("pred"), F.coalesce(f"_c{i}", F.lit(0)).cast("long").alias("n")) for i in range(k)]))
    return grid.join(g, [*by, "row"], "left").select(*by, "row", cells.alias("e")).select(*by, "row", "e.pred", "e.n")


def class_metrics(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Recall, precision and F1 per class from confusion cells; an empty denominator gives 0."""
    by = list(by)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    hit = F.sum(F.when(c("row") == c("pred"), c("n")).otherwise(0))
    t = cells.groupBy(*by, c("row").alias("cls")).agg(F.sum("n").alias("support"), hit.alias("hits"))
    p = cells.groupBy(*by, c("pred").alias("cls")).agg(F.sum("n").alias("predicted"))
    j = t.join(p, [*by, "cls"])
    rec, pre = zero(F.try_divide(c("hits"), c("support"))), zero(F.try_divide(c("hits"), c("predicted")))
    return j.select(*by, "cls", "support", rec.alias("recall"), pre.alias("precision"), zero(F.try_divide(2 * c("hits"), c("support") + c("predicted"))).alias("f1"))


def summary_metrics(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Macro and weighted F1, balanced accuracy (classes that occur) and accuracy."""
    n = F.sum("support")
    return metrics.groupBy(*by).agg(
        F.avg("f1").alias("macro_f1"),
        F.try_divide(F.sum(c("f1") * c("support")), n).alias("weighted_f1"),
        F.avg(F.when(c("support") > 0, c("recall"))).alias("balanced_accuracy"),
        F.try_divide(F.sum(c("recall") * c("support")), n).alias("accuracy"),
    )


def brier(df: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Mean over rows of the summed squared distance to the one-hot truth."""
    sq = [F.pow(c(p) - F.when(c("y_true") == i, 1.0).otherwise(0.0), F.lit(2.0)) for i, p in enumerate(probs(k))]
    return df.groupBy(*by).agg(F.avg(reduce(lambda a, b: a + b, sq)).alias("brier"))


def reliability(df: DataFrame, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Mean top probability and hit rate in equal-frequency bins; empty bins are left out."""
    b = quantile_bins(df, "top_p", bins, list(by))
    return b.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("top_p").alias("mean_predicted"),
        F.avg((c("pred") == c("y_true")).cast("double")).alias("fraction_correct"),
    )


def subclass_recall(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, "subclass").agg(F.count(F.lit(1)).alias("n"), F.avg((c("pred") == c("y_true")).cast("double")).alias("recall"))


def cell_members(df: DataFrame, key: str, chunk: int = 65_536, within: Sequence[str] = ()) -> DataFrame:
    """Files of every confusion cell as numbered rows (no collected lists)."""
    from wavetable.operators.scale import ranked

    return ranked(df.select(*within, "y_true", "pred", key), [*within, "y_true", "pred"], [c(key)], F.floor(c(key) / chunk), "member")


def fold_summary(per_fold: DataFrame, metric: str, by: Sequence[str]) -> DataFrame:
    """Mean, sample sd (0 for one fold), range and number of folds."""
    return per_fold.groupBy(*by).agg(
        F.avg(metric).alias("mean"),
        F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("sd"),
        F.min(metric).alias("min"),
        F.max(metric).alias("max"),
        F.count(metric).alias("folds"),
    )


def consensus_difficulty(df: DataFrame, key: str, correct: Column) -> DataFrame:
    """easy: all models right, hard: none, mixed: some."""
    g = df.groupBy(key).agg(F.count_if(correct).alias("n_correct"), F.count(F.lit(1)).alias("n_models"))
    level = F.when(c("n_correct") == 0, "hard").when(c("n_correct") == c("n_models"), "easy").otherwise("mixed")
    return g.withColumn("difficulty", level)


def held_out_recall(metrics: DataFrame, summary: DataFrame, held: DataFrame, by: Sequence[str]) -> DataFrame:
    """Recall of the fold's held-out parent class, or balanced accuracy where the class does not occur."""
    m = held.join(metrics.where("support > 0"), [*by, "cls"], "left").select(*by, "recall")
    return m.join(summary, list(by)).select(*by, F.coalesce("recall", "balanced_accuracy").alias("score"))


def seed_summary(per_fold: DataFrame, metric: str, algo: str, seed: str) -> DataFrame:
    """Mean over folds per seed, then mean and sd over seeds."""
    per_seed = per_fold.groupBy(algo, seed).agg(F.avg(metric).alias("_m"))
    return per_seed.groupBy(algo).agg(F.avg("_m").alias("mean"), F.stddev_samp("_m").alias("sd"), F.count(F.lit(1)).alias("seeds"))


def best_algorithm(summary: DataFrame, algo: str) -> DataFrame:
    """The algorithm with the highest mean; ties go to the lower name."""
    best = F.min_by(F.struct(algo, "mean"), F.struct(-F.round("mean", 12), algo))
    return summary.agg(best.alias("b")).select(f"b.{algo}", "b.mean")
