"""Combination of several models' class probabilities.

Input is one long table (model, fold_id, file_id, spectrum_id, subclass, y_true, p0..); models are
combined by grouping on the spectrum, so any number of models costs one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetable.operators.evaluate import probs

c = F.col
KEYS = ["fold_id", "file_id", "spectrum_id", "subclass", "y_true"]


def wide_over_models(df: DataFrame, keys: Sequence[str], models: Sequence, k: int) -> DataFrame:
    """Mean probability per key, one column per (model, class)."""
    return df.groupBy(*keys).agg(*[F.avg(F.when(c("model") == m, c(p))).alias(f"m{m}_{p}") for m in models for p in probs(k)])


def weighted_vote(df: DataFrame, weights: Column, k: int, n_models: int) -> DataFrame:
    """Weighted mean of the models' probabilities, renormalised.

    A spectrum that some model lacks fails the job, as does one a model has twice.
    """
    w = df.withColumn("_w", weights)
    g = w.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("model").alias("_m"), *[F.sum(c("_w") * c(p)).alias(p) for p in probs(k)])
    bad = F.raise_error(F.concat(F.lit("incomplete predictions for spectrum "), c("spectrum_id").cast("string")))
    total = sum((c(p) for p in probs(k)[1:]), c("p0"))
    g = g.where(F.when((c("_n") == n_models) & (c("_m") == n_models), F.lit(True)).otherwise(bad))
    return g.select(*KEYS, *[F.when(total == 0, c(p)).otherwise(F.try_divide(c(p), total)).alias(p) for p in probs(k)])


def tempered(k: int, temperature: Column, eps: float = 1e-12) -> list[Column]:
    """softmax(log p / T): p^(1/T) renormalised, probabilities cut at eps."""
    top = F.log(F.greatest(*[F.least(F.greatest(c(p), F.lit(eps)), F.lit(1.0)) for p in probs(k)]))
    e = [F.exp((F.log(F.least(F.greatest(c(p), F.lit(eps)), F.lit(1.0))) - top) / temperature) for p in probs(k)]
    total = sum(e[1:], e[0])
    return [(x / total).alias(p) for x, p in zip(e, probs(k))]


def fit_temperatures(df: DataFrame, k: int, grid: Sequence[float], eps: float = 1e-12) -> DataFrame:
    """Temperature per (model, held-out fold) with the least log loss on the other folds.

    Each row is scored at every grid value (a fixed list) and summed per (model, fold, T); the loss on
    the other folds is the model's total minus the fold's own part.
    """
    t = F.explode(F.array(*[F.lit(float(x)) for x in grid])).alias("T")
    d = df.select("model", "fold_id", "y_true", *probs(k), t)
    scored = d.select("model", "fold_id", "y_true", "T", *tempered(k, c("T"), eps))
    truth = F.coalesce(*[F.when(c("y_true") == i, c(p)) for i, p in enumerate(probs(k))])
    loss = scored.groupBy("model", "fold_id", "T").agg(F.sum(-F.log(F.greatest(truth, F.lit(eps)))).alias("loss"), F.count(F.lit(1)).alias("n"))
    total = loss.groupBy("model", "T").agg(F.sum("loss").alias("_l"), F.sum("n").alias("_n"))
    other = loss.join(total, ["model", "T"]).select(
        "model", "fold_id", "T", F.coalesce(F.try_divide(c("_l") - c("loss"), c("_n") - c("n")), F.lit(0.0)).alias("nll")
    )
    best = F.min_by(F.struct("T", "nll"), F.struct(F.round("nll", 9), "T"))
    return other.groupBy("model", "fold_id").agg(best.alias("b")).select("model", "fold_id", c("b.T").alias("temperature"), c("b.nll").alias("nll"))


def calibrated_vote(df: DataFrame, k: int, grid: Sequence[float], n_models: int) -> DataFrame:
    """Temper every model with its leave-one-fold-out temperature, then average."""
    j = df.join(fit_temperatures(df, k, grid), ["model", "fold_id"])
    return weighted_vote(j.select("model", *KEYS, *tempered(k, c("temperature"))), F.lit(1.0 / n_models), k, n_models)


def hard_select(scores: DataFrame) -> DataFrame:
    """Model with the best validation score per fold; NaN and null rank last, ties go to the lower model."""
    s = F.coalesce(F.nanvl(c("score"), F.lit(None).cast("double")), F.lit(float("-inf")))
    return scores.groupBy("fold_id").agg(F.max_by(F.struct("model", "score"), F.struct(s, -c("model"))).alias("b")).select("fold_id", c("b.model").alias("model"), c("b.score").alias("score"))


def soft_weights(scores: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Softmax of validation scores per fold; a missing score counts as the fold's smallest one."""
    ok = scores.withColumn("score", F.nanvl(c("score"), F.lit(None).cast("double")))
    low = ok.groupBy("fold_id").agg(F.coalesce(F.min("score"), F.lit(0.0)).alias("_lo"), F.coalesce(F.max("score"), F.lit(0.0)).alias("_hi"))
    e = ok.join(low, "fold_id").withColumn("_e", F.exp((F.coalesce("score", "_lo") - c("_hi")) / max(temperature, 1e-8)))
    total = e.groupBy("fold_id").agg(F.sum("_e").alias("_t"))
    return e.join(total, "fold_id").select("fold_id", "model", (c("_e") / c("_t")).alias("weight"))


def route(df: DataFrame, k: int, signal: str = "max_proba") -> DataFrame:
    """Per file, keep the rows of the model with the highest mean confidence (ties: lower model)."""
    ranked_p = F.reverse(F.array_sort(F.array(*probs(k))))
    score = ranked_p[0] if signal == "max_proba" else ranked_p[0] - ranked_p[1]
    per = df.groupBy("fold_id", "file_id", "model").agg(F.avg(score).alias("_s"))
    best = per.groupBy("fold_id", "file_id").agg(F.max_by("model", F.struct(F.round("_s", 12), -c("model"))).alias("model"))
    return df.join(best, ["fold_id", "file_id", "model"], "left_semi")
