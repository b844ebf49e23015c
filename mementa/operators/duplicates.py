"""Exact duplicates: size collision, hash groups, keep rules and the purge guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mementa import constants as K
from mementa.functions import paths as P
from mementa.operators.common import HEAVY_KEY_ROWS, group_winner, lookup_join
from mementa.operators.index import category_filter

NULL_LAST = 2**63 - 1
# Protected roots are broadcast up to this number (some 10 MB), and salted beyond it.
BROADCAST_ROOTS = 100_000
ROOT_SALTS = 64


def keep_order() -> list[Column]:
    """Oldest first, files without a time last, then by id."""
    return [F.coalesce(F.col("modified_unix"), F.lit(NULL_LAST)), F.col("id")]


def duplicate_groups(files: DataFrame, category: str | None = None) -> DataFrame:
    """Groups of two or more files with one content hash, one row per group.

    Equal content implies equal size, so on hashed files the size-collision test adds nothing and one
    hash aggregation finds the groups; the test matters where bytes must still be read, and lives in
    ``index.backfill_hashes``.  Everything is a min/count, combined map-side: a content held by a
    third of all files sends one row per task.  No member list is ever collected.
    """
    ranked = [c.alias(n) for n, c in zip(("time", "id"), keep_order())]
    scoped = category_filter(files, category).filter(F.col("content_hash").isNotNull())
    return (
        scoped.groupBy("content_hash")
        .agg(
            F.count("*").alias("n_files"),
            F.min(F.struct(*ranked, "size_bytes")).alias("oldest"),
            F.min(F.struct(P.is_duplicate_named("relative_path").alias("named"), *ranked)).alias("preferred"),
        )
        .filter("n_files >= 2")
        .select(
            "content_hash",
            F.col("oldest.size_bytes").alias("size_bytes"),
            "n_files",
            (F.col("oldest.size_bytes") * (F.col("n_files") - 1)).alias("reclaimable_bytes"),
            F.col("oldest.id").alias("oldest_id"),
            F.col("preferred.id").alias("keep_id"),
        )
    )


def duplicate_members(files: DataFrame, groups: DataFrame, heavy_rows: int = HEAVY_KEY_ROWS) -> DataFrame:
    """One row per file of a duplicate group, with the file to keep and the pre-selected rest."""
    cols = groups.select(
        "content_hash", "n_files", "reclaimable_bytes", "oldest_id", "keep_id"
    )
    return (
        lookup_join(files, cols, "content_hash", "n_files", heavy_rows)
        .withColumn("is_oldest", F.col("id") == F.col("oldest_id"))
        .withColumn("preselected", F.col("id") != F.col("keep_id"))
        .drop("oldest_id", "keep_id")
    )


def scan_summary(groups: DataFrame, candidates: DataFrame) -> DataFrame:
    """Totals of a scan; ``candidates`` is a one-row table with ``scanned_candidates``."""
    totals = groups.agg(
        F.count("*").alias("total_groups"),
        F.coalesce(F.sum("reclaimable_bytes"), F.lit(0)).alias("reclaimable_bytes"),
    )
    return (
        totals.withColumn("_one", F.lit(1)).join(candidates.withColumn("_one", F.lit(1)), "_one").drop("_one")
    )


def candidate_count(files: DataFrame) -> DataFrame:
    """Number of files sharing their size with another file (unreadable ones included)."""
    sizes = files.groupBy("size_bytes").agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.when(F.col("n") >= 2, F.col("n"))), F.lit(0)).alias("scanned_candidates"))


def sort_groups(groups: DataFrame) -> DataFrame:
    """Most reclaimable bytes first; the hash makes ties definite."""
    return groups.orderBy(F.col("reclaimable_bytes").desc(), F.col("content_hash"))


def oldest_per_hash(files: DataFrame) -> DataFrame:
    """The kept file of every content."""
    return group_winner(files, ["content_hash"], keep_order(), ["id", "absolute_path"])


def first_tiles(members: DataFrame, group: str, order: list[Column], cap: int = K.GROUP_TILE_CAP) -> DataFrame:
    """At most ``cap`` members per group for display.

    The row_number filter becomes a partial limit before the shuffle (WindowGroupLimit), so a huge
    group sends ``cap`` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return members.withColumn("tile", rank).filter(F.col("tile") <= cap)


def hidden_members(groups: DataFrame, cap: int = K.GROUP_TILE_CAP) -> DataFrame:
    """How many members of each group the display leaves out."""
    return groups.withColumn("n_hidden", F.greatest(F.col("n_files") - cap, F.lit(0)))


def remove_selected(members: DataFrame, selected: DataFrame, group: str) -> DataFrame:
    """Drop chosen members by id; groups left with fewer than two members disappear."""
    left = members.join(selected.select("id"), "id", "left_anti")
    sizes = left.groupBy(group).agg(F.count("*").alias("n_left")).filter("n_left >= 2")
    return lookup_join(left, sizes, group, "n_left")


def deletable_selection(members: DataFrame, selected: DataFrame, group: str) -> DataFrame:
    """Groups whose selection may be deleted: some members chosen, but never all of them."""
    marked = members.join(selected.select("id", F.lit(1).alias("chosen")), "id", "left")
    return (
        marked.groupBy(group)
        .agg(F.count("*").alias("n_files"), F.count("chosen").alias("n_selected"))
        .withColumn("deletable", (F.col("n_selected") > 0) & (F.col("n_selected") < F.col("n_files")))
    )


def protected_roots(contents: DataFrame) -> DataFrame:
    """Distinct ``objects`` folders that hold library content."""
    return (
        contents.select(P.objects_root("storage_path").alias("root")).filter("root IS NOT NULL").distinct()
    )


def purge_verdict(requests: DataFrame, roots: DataFrame, existing: DataFrame,
                  broadcast_roots: int = BROADCAST_ROOTS) -> DataFrame:
    """Verdict per requested path: refused inside a protected root, else missing, else eligible.

    A path lies in a root exactly when one of its ancestors (or itself) is that root, so each path is
    expanded to its ancestors and the prefix test becomes an equi-join.  Few roots are broadcast (their
    number is checked); more are joined under a salt, because top folders are ancestors of every path.
    Paths are resolved first, so ``..`` does not lead around the guard; a relative path that climbs above its
    start is refused.
    """
    wanted = requests.select("absolute_path").distinct().withColumn("path", P.resolved("absolute_path"))
    parts = F.split(F.col("path"), "/")
    lineage = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )
    clean = roots.select(F.regexp_replace(P.resolved("root"), "/+$", "").alias("ancestor")).distinct().withColumn(
        "hit", F.lit(True)
    )
    expanded = wanted.select("absolute_path", "path", F.explode(lineage).alias("ancestor"))
    if clean.limit(broadcast_roots + 1).count() <= broadcast_roots:
        matched = expanded.join(F.broadcast(clean), "ancestor", "left")
    else:
        salted = clean.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(ROOT_SALTS - 1))))
        matched = expanded.withColumn(
            "salt", F.pmod(F.xxhash64("absolute_path"), F.lit(ROOT_SALTS)).cast("int")
        ).join(salted, ["ancestor", "salt"], "left")
    climbs = (F.col("path") == "..") | F.col("path").startswith("../")
    guarded = matched.groupBy("absolute_path", "path").agg(F.bool_or("hit").alias("hit")).withColumn(
        "guarded", F.coalesce("hit", F.lit(False)) | climbs
    )
    present = existing.select(P.resolved("absolute_path").alias("path")).distinct().withColumn("present", F.lit(True))
    verdict = (
        F.when(F.col("guarded"), "refused").when(F.col("present"), "eligible").otherwise("missing")
    )
    return (
        guarded.join(present, "path", "left")
        .withColumn("verdict", verdict)
        .withColumn(
            "error",
            F.when(
                F.col("verdict") == "refused",
                F.concat(F.lit("Refused to trash a file inside the library's own storage: "), "absolute_path"),
            ).when(F.col("verdict") == "missing", F.concat(F.lit("File no longer exists: "), "absolute_path")),
        )
        .select("absolute_path", "verdict", "error")
    )


def eligible_paths(verdicts: DataFrame) -> DataFrame:
    """Resolved paths that may go, each once."""
    return verdicts.filter("verdict = 'eligible'").select(P.resolved("absolute_path").alias("absolute_path")).distinct()


def purge_summary(verdicts: DataFrame, files: DataFrame) -> DataFrame:
    """Files that may go, index rows that go with them, and the number of refusals."""
    counts = verdicts.agg(
        F.count_if(F.col("verdict") == "eligible").alias("trashed"), F.count("error").alias("n_errors")
    )
    rows = files.join(eligible_paths(verdicts), "absolute_path", "left_semi").agg(F.count("*").alias("removed_from_index"))
    return counts.withColumn("_one", F.lit(1)).join(rows.withColumn("_one", F.lit(1)), "_one").drop("_one")
