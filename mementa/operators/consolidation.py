"""Consolidation of a backup into the content library: plan, run, provenance and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from mementa.functions import paths as P
from mementa.functions import text as X
from mementa.operators.common import group_winner, upsert
from mementa.operators.index import describe

# Processing order of a run: decides which of several identical files counts as copied.
RUN_ORDER = ["relative_path", "absolute_path"]


# What a run needs of an inventory.
INVENTORY = ["absolute_path", "relative_path", "extension", "size_bytes", "modified_unix", "content_hash"]


def readable(inventory: DataFrame) -> DataFrame:
    """The columns a run needs; a file without a hash ends the job, as it must not count as a content."""
    path = F.coalesce("absolute_path", F.lit("?"))
    unread = F.raise_error(F.concat(F.lit("File could not be read: "), path)).cast("string")
    return inventory.withColumn("content_hash", F.coalesce("content_hash", unread)).select(*INVENTORY)


def indexed_outside(files: DataFrame, destination: str) -> DataFrame:
    """Distinct hashes of indexed files that lie outside the destination."""
    return (
        files.filter(F.col("content_hash").isNotNull() & ~P.path_within("absolute_path", F.lit(destination)))
        .select("content_hash")
        .distinct()
    )


def _per_content(inventory: DataFrame) -> DataFrame:
    """Pre-aggregate a source by hash, so one popular content is one row in every later join."""
    return inventory.groupBy("content_hash").agg(
        F.count("*").alias("n"),
        F.sum("size_bytes").alias("bytes"),
        F.min(F.struct(*RUN_ORDER, "size_bytes")).alias("first"),
    )


def _flagged(inventory: DataFrame, contents: DataFrame, outside: DataFrame) -> DataFrame:
    known = contents.select(F.col("hash").alias("content_hash"), F.lit(True).alias("known"))
    elsewhere = outside.select("content_hash", F.lit(True).alias("elsewhere"))
    return (
        _per_content(inventory)
        .join(known, "content_hash", "left")
        .join(elsewhere, "content_hash", "left")
        .withColumn("known", F.coalesce("known", F.lit(False)))
        .withColumn("elsewhere", F.coalesce("elsewhere", F.lit(False)))
    )


def _counters(flagged: DataFrame, new_files, new_bytes) -> DataFrame:
    zero = F.lit(0)
    new = ~F.col("known")
    return flagged.agg(
        F.coalesce(F.sum("n"), zero).alias("total_files"),
        F.coalesce(F.sum("bytes"), zero).alias("total_bytes"),
        F.coalesce(F.sum(F.when(new, new_files)), zero).alias("new_files"),
        F.coalesce(F.sum(F.when(new, new_bytes)), zero).alias("new_bytes"),
        F.coalesce(F.sum(F.when(new, F.col("n") - new_files).otherwise(F.col("n"))), zero).alias("duplicate_files"),
        F.coalesce(F.sum(F.when(new, F.col("bytes") - new_bytes).otherwise(F.col("bytes"))), zero).alias(
            "duplicate_bytes"
        ),
        F.coalesce(F.sum(F.when(new & F.col("elsewhere"), new_files)), zero).alias("already_on_computer"),
    )


def plan_consolidation(inventory: DataFrame, contents: DataFrame, outside: DataFrame) -> DataFrame:
    """Read-only preview.  Identical new files inside the source all count as new."""
    return _counters(_flagged(inventory, contents, outside), F.col("n"), F.col("bytes"))


def run_summary(inventory: DataFrame, contents: DataFrame, outside: DataFrame) -> DataFrame:
    """Counters of a run: the second identical file of the source is a duplicate."""
    counters = _counters(
        _flagged(inventory, contents, outside), F.lit(1), F.col("first.size_bytes")
    )
    return counters.withColumn("copied_files", F.col("new_files")).withColumn(
        "copied_bytes", F.col("new_bytes")
    ).withColumn("occurrences_recorded", F.col("total_files"))


def copied_files(inventory: DataFrame, contents: DataFrame) -> DataFrame:
    """The first file of every content that the library does not hold yet."""
    first = group_winner(
        inventory,
        ["content_hash"],
        [F.col(c) for c in RUN_ORDER],
        ["absolute_path", "relative_path", "size_bytes", "extension", "modified_unix"],
    )
    return first.join(
        contents.select(F.col("hash").alias("content_hash")), "content_hash", "left_anti"
    )


def run_actions(inventory: DataFrame, contents: DataFrame, copied: DataFrame | None = None) -> DataFrame:
    """Every source file with its action; ``copied`` may pass winners already found.

    The winners are found per hash by aggregation, then matched back on the unique path, so no join
    moves all copies of one content to one task.
    """
    found = copied_files(inventory, contents) if copied is None else copied
    marks = [c for c in ("elsewhere",) if c in found.columns]
    winners = found.select("absolute_path", F.lit("copied").alias("_a"), *marks)
    return inventory.join(winners, "absolute_path", "left").withColumn(
        "action", F.coalesce("_a", F.lit("duplicate"))
    ).drop("_a")


def marked_outside(copied: DataFrame, outside: DataFrame) -> DataFrame:
    """Copied files with ``elsewhere``: their content is indexed outside the destination, too."""
    known = outside.select("content_hash", F.lit(True).alias("elsewhere"))
    return copied.join(known, "content_hash", "left").withColumn("elsewhere", F.coalesce("elsewhere", F.lit(False)))


RUN_COUNTERS = ["total_files", "total_bytes", "new_files", "new_bytes", "duplicate_files", "duplicate_bytes", "already_on_computer"]


def run_counters() -> list[Column]:
    """Counters over the actions of a run, for ``DataFrame.observe`` in the pass that writes them."""
    copied, size = F.col("action") == "copied", F.col("size_bytes")
    found = [
        F.count(F.lit(1)), F.sum(size), F.count_if(copied), F.sum(F.when(copied, size)), F.count_if(~copied),
        F.sum(F.when(~copied, size)), F.count_if(copied & F.coalesce("elsewhere", F.lit(False))),
    ]
    return [c.alias(name) for name, c in zip(RUN_COUNTERS, found)]


def summary_of(spark: SparkSession, counters: Row) -> DataFrame:
    """``run_summary`` from observed counters."""
    found = counters.asDict()
    found |= {"copied_files": found["new_files"], "copied_bytes": found["new_bytes"], "occurrences_recorded": found["total_files"]}
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{n} long" for n in found))


def new_contents(inventory: DataFrame, contents: DataFrame, destination: str,
                 copied: DataFrame | None = None) -> DataFrame:
    """Rows to append to ``contents``: insert-if-absent, the first file keeps extension and path."""
    found = copied_files(inventory, contents) if copied is None else copied
    return found.select(
        F.col("content_hash").alias("hash"),
        "size_bytes",
        "extension",
        P.storage_path(F.lit(destination), "content_hash", "extension").alias("storage_path"),
    )


def manifest_entries(actions: DataFrame, run: str) -> DataFrame:
    return actions.select(
        F.lit(run).alias("run_id"),
        F.col("relative_path").alias("original_path"),
        "content_hash",
        "action",
        "size_bytes",
    )


def occurrence_rows(inventory: DataFrame, backup: str) -> DataFrame:
    """Provenance rows of one backup, one per (hash, backup, path); the last time wins."""
    return inventory.groupBy(
        "content_hash", F.lit(backup).alias("backup_id"), F.col("relative_path").alias("original_path")
    ).agg(F.max(F.struct("absolute_path", F.col("modified_unix").alias("m"))).alias("_l")).select(
        "content_hash", "backup_id", "original_path", F.col("_l.m").alias("original_mtime")
    )


def upsert_occurrences(current: DataFrame, rows: DataFrame) -> DataFrame:
    return upsert(current, rows, ["content_hash", "backup_id", "original_path"])


def upsert_backups(current: DataFrame, rows: DataFrame) -> DataFrame:
    """Backups by id; the adapter of an existing backup is kept."""
    return upsert(current, rows, ["id"], keep=["adapter"])


def upsert_devices(current: DataFrame, rows: DataFrame) -> DataFrame:
    """Devices by id; only the label changes, and a missing one reads ``Unknown device``."""
    named = rows.withColumn("label", F.coalesce("label", F.lit("Unknown device")))
    return upsert(
        current, named, ["id"], keep=["manufacturer", "model", "android_version", "created_at"]
    )


def imported_index(inventory: DataFrame, contents: DataFrame, destination: str, label: str) -> DataFrame:
    """Index rows of imported contents at their canonical path, described by the last file processed.

    ``contents`` is the table after the run; a hash it lacks falls back to its computed location.
    """
    last = group_winner(
        inventory,
        ["content_hash"],
        [F.col(c) for c in RUN_ORDER],
        ["relative_path", "extension", "size_bytes", "modified_unix"],
        last=True,
    )
    canonical = contents.select(F.col("hash").alias("content_hash"), "storage_path")
    placed = last.join(canonical, "content_hash", "left").withColumn(
        "absolute_path",
        F.coalesce("storage_path", P.storage_path(F.lit(destination), "content_hash", "extension")),
    )
    return (
        describe(placed)
        .withColumn("source", F.lit(label))
        .withColumn("root_path", F.lit(destination))
        .select(
            "root_path", "absolute_path", "relative_path", "category", "source", "extension",
            "size_bytes", "modified_unix", "content_hash",
        )
    )


def backup_coverage(backups: DataFrame, occurrences: DataFrame, contents: DataFrame) -> DataFrame:
    """Coverage of every backup by the library; safe when all of at least one file is covered.

    Occurrences are first counted per (backup, hash), so a content seen a billion times meets the
    contents table once per backup.  Bytes sum the content side, as orphan hashes have none.
    """
    seen = occurrences.groupBy("backup_id", "content_hash").agg(F.count("*").alias("n"))
    stored = contents.select(
        F.col("hash").alias("content_hash"), F.col("size_bytes").alias("bytes"), "storage_path"
    ).withColumn("held", F.lit(True))
    held = F.when(F.col("held"), F.col("n"))
    per_backup = (
        seen.join(stored, "content_hash", "left")
        .groupBy("backup_id")
        .agg(
            F.sum("n").alias("total_files"),
            F.sum(held).alias("covered_files"),
            F.sum(held * F.col("bytes")).alias("total_bytes"),
            F.sum(F.when(F.col("storage_path").isNotNull(), F.col("n") * F.col("bytes"))).alias("covered_bytes"),
        )
    )
    counted = backups.join(
        per_backup.withColumnRenamed("backup_id", "id"), "id", "left"
    ).select(
        F.col("id").alias("backup_id"),
        "label",
        "source_path",
        "imported_at",
        *[
            F.coalesce(c, F.lit(0)).cast("long").alias(c)
            for c in ("total_files", "covered_files", "total_bytes", "covered_bytes")
        ],
    )
    safe = (F.col("total_files") > 0) & (F.col("total_files") == F.col("covered_files"))
    return (
        counted.withColumn("coverage_percent", X.coverage_percent("covered_files", "total_files"))
        .withColumn("reclaimable_bytes", F.when(safe, F.col("total_bytes")).otherwise(F.lit(0)))
        .withColumn("safe_to_delete", safe)
    )


def newest_first(coverage: DataFrame) -> DataFrame:
    return coverage.orderBy(F.col("imported_at").desc(), F.col("backup_id"))


def import_outcome(summary: DataFrame) -> DataFrame:
    """Files that already had a copy, never below zero."""
    return summary.withColumn(
        "already_had_copy",
        F.greatest(F.col("occurrences_recorded") - F.col("copied_files"), F.lit(0)),
    )
