"""Cross-validation folds over files, and the checks that they do not leak.

A fold table is long: (protocol, fold, file_id, role).  Random order is the md5 of seed and key, so the
assignment is the same on every run and needs no shuffle of state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetable.operators.rollup import group_constant
from wavetable.operators.scale import hash_bucket, hash_key, null_safe_join, ranked

c = F.col
MASTER_SEED = 42
MAX_FOLDS = 1_000


def fold_seed(fold: Column, seed: int = MASTER_SEED) -> Column:
    """Derived seed of a numbered fold: (seed * 31337 + fold) mod 2^31."""
    return F.pmod(F.lit(seed * 31337) + fold, F.lit(2**31))


def file_frame(rows: DataFrame, file: str, cls: str, sub: str) -> DataFrame:
    """One row per file; a file with two classes fails the job."""
    return group_constant(rows, [file], cls).join(group_constant(rows, [file], sub), file)


def stratified_folds(files: DataFrame, file: str, cls: str, k: int, seed: int = MASTER_SEED) -> DataFrame:
    """k folds; every class is dealt round-robin in hash order, each starting where the last one ended.

    Per class the fold sizes differ by at most one, over all classes by at most one as well.
    """
    from pyspark.sql import Window

    h = files.withColumn("_h", hash_key(file, seed=seed))
    n = ranked(h, [cls], [c("_h"), c(file)], hash_bucket(c("_h")), "_rn")
    sizes = files.groupBy(cls).agg(F.count(F.lit(1)).alias("_n"))  # one row per class
    start = sizes.withColumn("_s", F.coalesce(F.sum("_n").over(Window.orderBy(cls).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return null_safe_join(n, start, [cls]).withColumn("test_fold", F.pmod(c("_rn") - 1 + c("_s"), F.lit(k))).drop("_h", "_rn", "_s")


def kfold_roles(assigned: DataFrame, file: str, k: int) -> DataFrame:
    """Every file in every fold with its role."""
    fold = F.explode(F.array(*[F.lit(i).cast("long") for i in range(k)])).alias("fold")
    d = assigned.select(file, "test_fold", fold)
    return d.select(F.lit("group_kfold").alias("protocol"), "fold", file, F.when(c("fold") == c("test_fold"), "test").otherwise("train").alias("role"))


def leave_one_subclass_out(files: DataFrame, file: str, cls: str, sub: str, always_train: Sequence = ()) -> DataFrame:
    """One fold per subclass; files of the ``always_train`` classes are never tested.

    The subclass list is a vocabulary (checked), spread over the files as a literal array.
    """
    eligible = files.where(~c(cls).isin(list(always_train))) if always_train else files
    subs = [r[0] for r in eligible.where(c(sub).isNotNull()).select(sub).distinct().orderBy(sub).limit(MAX_FOLDS + 1).collect()]
    if len(subs) > MAX_FOLDS:
        raise ValueError(f"more than {MAX_FOLDS} subclasses")
    fold = F.explode(F.array(*[F.lit(s).cast(files.schema[sub].dataType) for s in subs])).alias("fold")
    test = (c(sub).eqNullSafe(c("fold"))) & (~c(cls).isin(list(always_train)) if always_train else F.lit(True))
    return files.select(file, cls, sub, fold).select(F.lit("loso").alias("protocol"), "fold", file, F.when(test, "test").otherwise("train").alias("role"))


def fold_rows(folds: DataFrame, rows: DataFrame, file: str, keep: str = "keep") -> DataFrame:
    """Quality-passing rows of every fold with their role."""
    return folds.join(rows.where(keep), file)


def fold_report(folds: DataFrame, files: DataFrame, file: str, cls: str, classes: Sequence) -> DataFrame:
    """Sizes and the class distribution of the test side per fold."""
    j = folds.join(files.select(file, cls), file)
    test = c("role") == "test"
    return j.groupBy("fold").agg(
        F.count_if(test).alias("n_test_files"),
        F.count_if(~test).alias("n_train_files"),
        *[F.count_if(test & (c(cls) == k)).alias(f"test_{k}") for k in classes],
    )


def date_overlap(folds: DataFrame, dates: DataFrame, file: str, date: str) -> DataFrame:
    """Calibration dates on both sides of a fold (a warning, not an error): one row per fold and date."""
    j = folds.join(dates.where(c(date).isNotNull()), file)
    g = j.groupBy("fold", date).agg(F.count_if(c("role") == "test").alias("n_test"), F.count_if(c("role") == "train").alias("n_train"))
    return g.where("n_test > 0 and n_train > 0")


def leakage(resolved: DataFrame, rows: DataFrame, key: str, file: str, keep: str = "keep") -> DataFrame:
    """Violations per fold; every count must be 0."""
    per_row = resolved.groupBy("fold", key).agg(F.count_distinct("role").alias("_roles"))
    shared_rows = per_row.groupBy("fold").agg(F.count_if(c("_roles") > 1).alias("shared_rows"))
    per_file = resolved.groupBy("fold", file).agg(F.count_distinct("role").alias("_roles"))
    shared_files = per_file.groupBy("fold").agg(F.count_if(c("_roles") > 1).alias("shared_files"))
    known = resolved.select("fold", key).join(rows.select(key, c(keep).alias("_keep"), F.lit(True).alias("_known")), key, "left")
    other = known.groupBy("fold").agg(
        F.count_if(c("_known").isNull()).alias("unknown_rows"), F.count_if(c("_known") & ~c("_keep")).alias("rejected_rows")
    )
    return shared_rows.join(shared_files, "fold").join(other, "fold")


def fingerprint(df: DataFrame, key: str, columns: Sequence[str], buckets: int = 4096) -> DataFrame:
    """Order-free hash of a table's content: hash of row hashes per bucket, then hash of the bucket hashes.

    Each bucket hash sums the row hashes, so no task collects a group; a changed, added or lost row
    changes the result.
    """
    # the text of a struct keeps nulls in place, which a hash of columns skips
    row = F.xxhash64(F.to_json(F.struct(*[c(x) for x in [key, *columns]]), {"ignoreNullFields": "false"}))
    g = df.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_b"), row.alias("_h"))
    per = g.groupBy("_b").agg(F.sum(c("_h").cast("decimal(38,0)")).alias("_s"), F.count(F.lit(1)).alias("_n"))
    text = F.concat_ws(":", c("_b").cast("string"), c("_n").cast("string"), c("_s").cast("string"))
    return per.agg(F.sum("_n").alias("n_rows"), F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(text))), 256).alias("fingerprint"))


def within_group_split(rows: DataFrame, group: str, key: str, share: float = 0.2, seed: int = MASTER_SEED) -> DataFrame:
    """In every group the first max(1, floor(share * n)) rows in hash order are test, the rest train."""
    h = rows.withColumn("_h", hash_key(key, seed=seed))
    n = ranked(h, [group], [c("_h"), c(key)], hash_bucket(c("_h")), "_rn")
    size = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    test = c("_rn") <= F.greatest(F.lit(1), F.floor(F.lit(share) * c("_n")))
    return null_safe_join(n, size, [group]).withColumn("role", F.when(test, "test").otherwise("train")).drop("_h", "_rn", "_n")
