"""File inventories and content hashes.

A folder walk and a file hash need the bytes of a file system, so these run in ``mapInPandas`` on the
executors, over a shared file system.  Everything else in the library starts from inventory tables.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from mementa.functions import paths as P
from mementa.session import reliable_checkpoint

CHUNK = 1 << 20
ENTRY_COLUMNS = ["root_path", "absolute_path", "is_dir", "size_bytes", "modified_unix", "error"]
ENTRY_SCHEMA = "root_path string, absolute_path string, is_dir boolean, size_bytes long, modified_unix long, error string"
ENTRIES_PER_FRAME = 50_000
MISSING = "missing"


def _entry_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=ENTRY_COLUMNS).astype({"modified_unix": "Int64", "size_bytes": "Int64", "is_dir": "boolean"})


def _entries(root: str, folder: str) -> Iterator[tuple]:
    """The rows of a folder; where it cannot be listed, what could be and a row with the error."""
    try:
        with os.scandir(folder) as entries:
            for entry in entries:
                is_dir = entry.is_dir(follow_symlinks=False)
                if not is_dir and not entry.is_file(follow_symlinks=False):
                    continue
                info = entry.stat(follow_symlinks=False)
                mtime = int(info.st_mtime // 1) if info.st_mtime >= 0 else None
                yield root, entry.path, is_dir, 0 if is_dir else info.st_size, mtime, None
    except FileNotFoundError:
        yield root, folder, None, None, None, MISSING
    except OSError as error:
        yield root, folder, None, None, None, error.strerror or type(error).__name__


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = []
    for batch in batches:
        for root, folder in zip(batch["root_path"], batch["absolute_path"]):
            for row in _entries(root, folder):
                rows.append(row)
                if len(rows) >= ENTRIES_PER_FRAME:  # a folder may hold any number of files
                    yield _entry_frame(rows)
                    rows = []
    yield _entry_frame(rows)


class Scan(NamedTuple):
    """``files``: the inventory; ``folders``: folder rows in the same form; ``outcomes``: (root_path, outcome, error,
    failed_folders) per root, where the outcome is missing, failed (the root itself), empty or listed."""

    files: DataFrame
    folders: DataFrame
    outcomes: DataFrame


def walk_roots(roots: DataFrame, partitions: int | None = None) -> Scan:
    """Regular files below each root (root_path), hidden and empty ones included.

    The walk proceeds level by level; the folders of a level are spread over all tasks, so one huge root does not end
    up in one task.  Every level is checkpointed.  A folder that cannot be listed is a row of its own: the other
    folders and roots go on, and its root's outcome tells it.
    """
    spark = roots.sparkSession
    width = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = roots.select("root_path", F.regexp_replace("root_path", "(?<=.)/+$", "").alias("absolute_path")).distinct()
    level, found = top, None
    while True:
        listed = reliable_checkpoint(level.repartition(width, "absolute_path").mapInPandas(_list_folders, ENTRY_SCHEMA))
        found = listed if found is None else found.unionByName(listed)
        level = listed.filter("is_dir").select("root_path", "absolute_path")
        if level.isEmpty():
            break
    failed = F.col("error").isNotNull()
    own = F.col("absolute_path") == F.regexp_replace("root_path", "(?<=.)/+$", "")
    told = found.groupBy("root_path").agg(
        F.max(F.when(failed & own, F.col("error"))).alias("error"), F.count_if(failed & ~own).alias("failed_folders"),
        F.count_if(~failed).alias("n"),
    )
    outcome = F.when(F.col("error") == MISSING, MISSING).when(F.col("error").isNotNull(), "failed").when(F.coalesce("n", F.lit(0)) == 0, "empty").otherwise("listed")
    outcomes = top.select("root_path").join(told, "root_path", "left").select(
        "root_path", outcome.alias("outcome"), "error", F.coalesce("failed_folders", F.lit(0)).alias("failed_folders")
    )
    entries = describe_entries(found.filter("error IS NULL").drop("error"))
    return Scan(entries.filter("NOT is_dir").drop("is_dir"), entries.filter("is_dir").drop("is_dir"), outcomes)


def walk(roots: DataFrame, partitions: int | None = None, folders: bool = False) -> DataFrame:
    """Only the files of ``walk_roots``; with ``folders``, folder rows, too, told apart by ``is_dir``."""
    scan = walk_roots(roots, partitions)
    if not folders:
        return scan.files
    return scan.files.withColumn("is_dir", F.lit(False)).unionByName(scan.folders.withColumn("is_dir", F.lit(True)))


def describe_entries(entries: DataFrame) -> DataFrame:
    return entries.withColumn("relative_path", P.relative_path("absolute_path", "root_path")).withColumn(
        "extension", P.extension("absolute_path")
    )


def from_table(spark: SparkSession, path: str) -> DataFrame:
    """The usual source at scale: an inventory table already collected."""
    return spark.read.parquet(path)


def binary_files(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """Inventory through Spark's binaryFile source; it leaves out hidden and empty files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    absolute = F.regexp_replace("path", "^file:/+", "/")
    table = raw.select(
        F.lit(root.rstrip("/")).alias("root_path"),
        absolute.alias("absolute_path"),
        F.col("length").alias("size_bytes"),
        F.unix_seconds("modificationTime").alias("modified_unix"),
        *([F.col("content")] if with_content else []),
    )
    return describe_entries(table)


def _hash_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path in batch["absolute_path"]:
            try:
                digest = hashlib.sha256()
                with open(path, "rb") as handle:
                    while chunk := handle.read(CHUNK):
                        digest.update(chunk)
            except OSError:
                continue
            rows.append((path, digest.hexdigest()))
        yield pd.DataFrame(rows, columns=["absolute_path", "content_hash"])


def hash_files(wanted: DataFrame) -> DataFrame:
    """SHA-256 of files on a shared file system, read in chunks (any size); unreadable ones are left out."""
    width = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = wanted.select("absolute_path").repartition(width, "absolute_path")
    return spread.mapInPandas(_hash_batches, "absolute_path string, content_hash string")


def hash_files_strict(wanted: DataFrame) -> DataFrame:
    """As ``hash_files``, but an unreadable file fails the job (consolidation must not skip files)."""
    hashed = wanted.select("absolute_path").join(hash_files(wanted), "absolute_path", "left")
    failed = F.raise_error(F.concat(F.lit("cannot read "), F.col("absolute_path"))).cast("string")
    return hashed.withColumn("content_hash", F.coalesce("content_hash", failed))


def hashed_content(table: DataFrame, content: str = "content") -> DataFrame:
    """Hash a bytes column in place (JVM side); the bytes leave the row."""
    return table.withColumn("content_hash", F.sha2(F.col(content), 256)).drop(content)
