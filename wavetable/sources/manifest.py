"""Which files are new or changed, and a log of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetable.sources.instrument import GLOB

c = F.col


def changed(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose path, size and time are not in the manifest.  No content is read for this."""
    return found.join(manifest.select("file_path", "file_size_bytes", "file_mtime"), ["file_path", "file_size_bytes", "file_mtime"], "left_anti")


def content_hashes(spark: SparkSession, root: str) -> DataFrame:
    """SHA-256 of every file under a root (one file per row, hashed where it is read)."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", GLOB).load(root)
    return f.select(c("path").alias("file_path"), F.sha2("content", 256).alias("file_sha256"))


def differing_content(hashes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose content hash is not the recorded one."""
    return hashes.join(manifest.select("file_path", "file_sha256"), ["file_path", "file_sha256"], "left_anti")


def run_id(model: str, protocol: str, seed: str):
    """First eight hex digits of the SHA-1 of (model, protocol, seed)."""
    return F.substring(F.sha1(F.concat_ws("|", c(model), c(protocol), c(seed).cast("string"))), 1, 8)


def append_runs(runs: DataFrame, folder: str) -> None:
    """Append run summaries to the JSON-lines log."""
    runs.write.mode("append").json(folder)
