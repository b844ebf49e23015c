"""Library tables as partitioned Parquet, and the jobs that keep them.

Every table has partition columns, and a write replaces just the partitions it has rows for (Spark's dynamic partition
overwrite).  Tables of runs are partitioned by run, so runs of several writers never touch each other's files and a
repeated run replaces its own rows.  The index is partitioned by category and a bucket of the path's hash: reading a
category skips the others, and an upsert rewrites the partitions that hold its paths.

Jobs that change the index read partitions before they replace them: run one of them at a time on a library.  Runs and
streams that only append (``streaming.ingest.dedup_ingest``) may run side by side.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, functions as F

from mementa import schemas
from mementa.functions import paths as P
from mementa.operators import consolidation as C
from mementa.operators import index as I
from mementa.operators.common import group_winner, number_rows, upsert
from mementa.session import reliable_checkpoint
from mementa.sources import objects as O


class Table(NamedTuple):
    schema: str
    partitions: list[str]


TABLES = {
    "files": Table(schemas.FILES + ", live BOOLEAN, bucket INT", ["category", "bucket"]),
    "scan_runs": Table(schemas.SCAN_RUNS + ", run_id STRING", ["run_id"]),
    "contents": Table(schemas.CONTENTS + ", run_id STRING", ["run_id"]),
    "backups": Table(schemas.BACKUPS, ["id"]),
    "occurrences": Table(schemas.OCCURRENCES, ["backup_id"]),
    "import_runs": Table(schemas.IMPORT_RUNS, ["id"]),
    "import_run_entries": Table(schemas.IMPORT_RUN_ENTRIES, ["run_id"]),
    "unread_files": Table(schemas.UNREAD_FILES, ["run_id"]),
    "devices": Table(schemas.DEVICES, ["id"]),
    "objects": Table(schemas.OBJECTS, ["run_id", "shard"]),
}
# Buckets of a category in the index; fixed for the life of a library.
BUCKETS = 64


class Library:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def stored(self, name: str) -> DataFrame:
        """The rows of a table as they are stored; none before the first write."""
        schema = TABLES[name].schema
        wanted = self.spark.createDataFrame([], schema)
        try:
            found = self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return wanted
        return found.select(*wanted.columns)

    def read(self, name: str) -> DataFrame:
        """The rows of a table: of the index those that are not removed, of the contents the first of each hash."""
        rows = self.stored(name)
        if name == "files":
            return rows.filter("live").drop("live", "bucket")
        return first_contents(rows) if name == "contents" else rows

    def replace(self, name: str, rows: DataFrame) -> None:
        """Replace the partitions that ``rows`` belong to; missing columns become NULL."""
        table = TABLES[name]
        fields = self.spark.createDataFrame([], table.schema).schema
        columns = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
        writer = rows.select(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*table.partitions).parquet(f"{self.root}/{name}")

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("absolute_path"), F.lit(self.buckets)).cast("int"))

    def _near(self, paths: DataFrame) -> DataFrame:
        """Live index rows in the buckets of ``paths``."""
        buckets = [r["bucket"] for r in paths.select("bucket").distinct().collect()]
        return self.stored("files").filter("live").filter(F.col("bucket").isin(buckets))

    def _replace_files(self, rows: DataFrame) -> None:
        # adaptive execution splits large partitions over several tasks and joins small ones
        self.replace("files", rows.hint("rebalance", "category", "bucket"))

    def upsert_index(self, changes: DataFrame) -> None:
        """Insert or update index rows by path (one row per path in ``changes``); new paths get the next ids.

        Only the partitions of changed paths are rewritten.  A path that moves to another category leaves a row
        marked as not live, as a partition without rows would keep its old file; the next rewrite drops it.
        """
        changes = reliable_checkpoint(self._bucketed(changes))
        near = self._near(changes)
        before = near.select("absolute_path", F.col("category").alias("_category"), "bucket")
        met = reliable_checkpoint(changes.select("absolute_path", "category", "bucket").join(before, ["absolute_path", "bucket"], "left"))
        touched = met.select("bucket", F.explode(F.array("category", "_category")).alias("category")).filter("category IS NOT NULL")
        current = near.filter(_within(touched))
        last = self.stored("files").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        ids = number_rows(met.filter("_category IS NULL").select("absolute_path"), ["absolute_path"], last + 1, "_id")
        changed = changes.join(ids, "absolute_path", "left").withColumn("id", F.col("_id")).drop("_id", "bucket")
        merged = upsert(current.drop("live", "bucket"), changed, ["absolute_path"], keep=["id"]).withColumn("live", F.lit(True))
        moved = met.filter("_category <> category").select("absolute_path", "_category")
        gone = current.join(moved, "absolute_path").filter("category = _category").drop("_category", "bucket").withColumn("live", F.lit(False))
        # a moved path is upserted from its old row, so its id and first columns go along
        self._replace_files(self._bucketed(merged.unionByName(gone)))

    def remove_index(self, paths: DataFrame) -> None:
        """Delete index rows by path, in the partitions that hold them."""
        paths = reliable_checkpoint(self._bucketed(paths.select("absolute_path").distinct()))
        near = self._near(paths)
        held = reliable_checkpoint(near.join(paths.select("absolute_path"), "absolute_path", "left_semi").select("absolute_path", "category", "bucket"))
        marked = near.filter(_within(held)).join(held.select("absolute_path", F.lit(True).alias("_gone")), "absolute_path", "left")
        self._replace_files(marked.withColumn("live", F.col("_gone").isNull()).drop("_gone"))


def _within(touched: DataFrame) -> Column:
    """Whether a row lies in one of the (category, bucket) partitions; categories times buckets bound their number."""
    found: dict[str, list[int]] = {}
    for row in touched.select("category", "bucket").distinct().collect():
        found.setdefault(row["category"], []).append(row["bucket"])
    tests = [(F.col("category") == c) & F.col("bucket").isin(b) for c, b in sorted(found.items())]
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def first_contents(contents: DataFrame) -> DataFrame:
    """Of contents that several runs stored at once, the first."""
    others = [c for c in contents.columns if c != "hash"]
    return group_winner(contents, ["hash"], [F.col("first_seen_at"), F.col("run_id")], others)


def run_index(library: Library, inventory: DataFrame, hasher: I.Reader, signer: I.Reader | None = None,
              outcomes: DataFrame | None = None, run: str | None = None) -> None:
    """Incremental index of a scan, upserted into ``files``, and a scan run per root.

    ``outcomes(root_path, outcome)`` from a walk gives empty roots their run; missing and failed ones get none.
    """
    scanned = I.incremental_index(inventory, library.read("files"), hasher, signer)
    library.upsert_index(scanned.withColumn("indexed_at", F.current_timestamp()))
    runs = I.scan_run_rows(inventory, outcomes)
    library.replace("scan_runs", runs.withColumns({"created_at": F.current_timestamp(), "run_id": F.lit(run or uuid.uuid4().hex)}))


Store = Callable[[DataFrame], DataFrame]


def record_run(library: Library, inventory: DataFrame, destination: str, run: str, store: Store | None) -> tuple[Row, DataFrame]:
    """What every import does: new contents get their objects and their row, all files their manifest entry.

    All rows belong to the run's own partitions, and contents of the run itself do not count as known, so repeating a
    run that died writes the same again.  Returns the counters, observed while the entries are written, and the
    copied files.
    """
    known = first_contents(library.stored("contents").filter(F.col("run_id") != run))
    outside = C.indexed_outside(library.read("files"), destination)
    # feeds objects, contents and entries
    copied = reliable_checkpoint(C.marked_outside(C.copied_files(inventory, known), outside))
    if store is not None:
        library.replace("objects", O.sharded(store(copied), run))
    now = F.current_timestamp()
    fresh = C.new_contents(inventory, known, destination, copied).withColumns({"first_seen_at": now, "run_id": F.lit(run)})
    library.replace("contents", fresh)
    counters = Observation()
    actions = C.run_actions(inventory, known, copied).observe(counters, *C.run_counters())
    library.replace("import_run_entries", C.manifest_entries(actions, run).withColumn("created_at", now))
    found = counters.get
    return Row(**{c: found.get(c) or 0 for c in C.RUN_COUNTERS}), copied


def mark_run(library: Library, run: str, source_path: str, destination: str, status: str) -> None:
    """Write the run's row: ``running`` at its start, ``completed`` in the place of that at its end."""
    earlier = {r["id"]: r["started_at"] for r in library.stored("import_runs").filter(F.col("id") == run).collect()}
    started = F.lit(earlier[run]) if status == "completed" and run in earlier else F.current_timestamp()
    library.replace("import_runs", library.spark.range(0, 1, 1, 1).select(
        F.lit(run).alias("id"), F.lit(source_path).alias("source_path"), F.lit(destination).alias("destination_path"),
        F.lit(status).alias("status"), started.alias("started_at"),
        (F.current_timestamp() if status == "completed" else F.lit(None)).alias("finished_at"),
    ))


def run_consolidation(library: Library, inventory: DataFrame, adapter: str, label: str, source_path: str,
                      destination: str, run_token: str, device_id: str | None = None,
                      device_label: str | None = None, store: Store | None = O.from_files) -> DataFrame:
    """Import a hashed inventory and return its summary.

    ``store`` reads the bytes of new contents (``sources.objects``); without one, only the catalogue is written.
    The run stands as ``running`` until all tables are written: one that dies can be seen, and repeating it with the
    same token mends it.
    """
    spark, now = library.spark, F.current_timestamp()
    row = spark.range(0, 1, 1, 1).select(P.backup_id(F.lit(adapter), F.lit(source_path)).alias("id")).withColumn(
        "run", P.run_id("id", F.lit(run_token))
    ).first()
    mark_run(library, row["run"], source_path, destination, "running")
    if device_id is not None:
        device = spark.range(0, 1, 1, 1).select(
            F.lit(device_id).alias("id"), F.lit(device_label).cast("string").alias("label"),
            F.lit(None).cast("string").alias("manufacturer"), F.lit(None).cast("string").alias("model"),
            F.lit(None).cast("string").alias("android_version"), now.alias("created_at"),
        )
        library.replace("devices", C.upsert_devices(library.read("devices").filter(F.col("id") == device_id), device))
    backup = spark.range(0, 1, 1, 1).select(
        F.lit(row["id"]).alias("id"), F.lit(adapter).alias("adapter"), F.lit(label).alias("label"),
        F.lit(source_path).alias("source_path"), F.lit(device_id).cast("string").alias("device_id"),
        now.alias("imported_at"),
    )
    library.replace("backups", C.upsert_backups(library.read("backups").filter(F.col("id") == row["id"]), backup))
    inventory = reliable_checkpoint(C.readable(inventory))  # hashed once, the same for all tables
    counters, _ = record_run(library, inventory, destination, row["run"], store)
    before = library.read("occurrences").filter(F.col("backup_id") == row["id"])
    library.replace("occurrences", C.upsert_occurrences(before, C.occurrence_rows(inventory, row["id"])))
    imported = C.imported_index(inventory, library.read("contents"), destination, label)
    library.upsert_index(imported.withColumn("indexed_at", now))
    mark_run(library, row["run"], source_path, destination, "completed")
    return C.summary_of(spark, counters)
