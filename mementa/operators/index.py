"""File index: incremental indexing, snapshot upserts, metrics and paging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from mementa import constants as K
from mementa.functions import paths as P
from mementa.operators.common import dimension, lookup_join, upsert
from mementa.session import reliable_checkpoint

# Bits of the bitmap of paths to hash: 32 MB at most, at any number of paths.
FILTER_BITS = 1 << 28


def describe(inventory: DataFrame) -> DataFrame:
    """Add category and source to an inventory."""
    return inventory.withColumn("category", P.classify("relative_path", "extension")).withColumn(
        "source", P.source_of("relative_path")
    )


def with_previous(inventory: DataFrame, previous: DataFrame) -> DataFrame:
    """Left join the previous index on path and flag unchanged files (NULL mtimes are equal).

    Unchanged files carry over their hash and, where the index has signatures, those as well.
    """
    carried = {"content_hash": "reused_hash"}
    if "sig" in previous.columns:
        carried |= {"sig": "reused_sig", "aspect_q": "reused_aspect"}
    prev = previous.select(
        "absolute_path",
        F.col("size_bytes").alias("_size"),
        F.col("modified_unix").alias("_mtime"),
        *[F.col(old).alias(new) for old, new in carried.items()],
    )
    joined = inventory.join(prev, "absolute_path", "left")
    unchanged = F.coalesce(F.col("_size") == F.col("size_bytes"), F.lit(False)) & F.col(
        "_mtime"
    ).eqNullSafe(F.col("modified_unix"))
    flagged = joined.withColumn("unchanged", unchanged)
    for name in carried.values():
        flagged = flagged.withColumn(name, F.when(F.col("unchanged"), F.col(name)))
    return flagged.drop("_size", "_mtime")


def hash_from_table(contents: DataFrame, content: str = "content",
                    filter_bits: int = FILTER_BITS) -> Callable[[DataFrame], DataFrame]:
    """Hasher over a table (absolute_path, content) with the bytes inline.

    A bitmap of the wanted paths (at most ``filter_bits``, hence safe to broadcast) drops other rows before
    their bytes are hashed; what it lets through by chance is dropped by a join of paths and hashes.
    Bytes are never shuffled.  A path that the table holds several times gets one hash, the least.
    """

    def slot() -> Column:
        return F.pmod(F.xxhash64("absolute_path"), F.lit(filter_bits)) + 1

    def run(wanted: DataFrame) -> DataFrame:
        wanted = reliable_checkpoint(wanted)  # used twice: the index join behind it runs once
        marks = wanted.groupBy(F.bitmap_bucket_number(slot()).alias("_bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(slot())).alias("_bits")
        )
        position = F.bitmap_bit_position(slot())
        byte = F.conv(F.hex(F.substring("_bits", F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        marked = F.call_function("shiftright", byte, F.pmod(position, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1
        near = contents.withColumn("_bucket", F.bitmap_bucket_number(slot())).join(F.broadcast(marks), "_bucket")
        hashed = near.filter(marked).select("absolute_path", F.sha2(F.col(content), 256).alias("content_hash"))
        held = hashed.join(wanted, "absolute_path", "left_semi")
        return held.groupBy("absolute_path").agg(F.min("content_hash").alias("content_hash"))

    return run


Reader = Callable[[DataFrame], DataFrame]


def incremental_index(inventory: DataFrame, previous: DataFrame, hasher: Reader,
                      signer: Reader | None = None) -> DataFrame:
    """Index rows of one scan: unchanged files reuse hash and signature, all others are read.

    ``hasher`` maps wanted paths to (absolute_path, content_hash), ``signer`` the wanted photos to
    (absolute_path, aspect_q, sig).  A path they cannot read is missing and keeps NULL.
    """
    state = describe(with_previous(inventory, previous))
    wanted = state.filter(F.col("reused_hash").isNull()).select("absolute_path")
    fresh = hasher(wanted).withColumnRenamed("content_hash", "fresh_hash")
    indexed = (
        state.join(fresh, "absolute_path", "left")
        .withColumn("content_hash", F.coalesce("reused_hash", "fresh_hash"))
        .withColumn("rehashed", F.col("fresh_hash").isNotNull())
        .drop("reused_hash", "fresh_hash")
    )
    known = "reused_sig" in state.columns
    if signer is None:
        # a changed photo loses its signature rather than keep that of its old content
        return indexed.withColumnsRenamed({"reused_sig": "sig", "reused_aspect": "aspect_q"}) if known else indexed
    photo = F.col("category") == "photo"
    missing = F.col("reused_sig").isNull() if known else F.lit(True)
    unsigned = state.filter(photo & missing & P.ascii_lower("extension").isin(K.DECODABLE_EXTENSIONS))
    signed = signer(unsigned.select("absolute_path")).select(
        "absolute_path", F.col("aspect_q").alias("new_aspect"), F.col("sig").alias("new_sig")
    )
    both = indexed.join(signed, "absolute_path", "left")
    old_sig = F.col("reused_sig") if known else F.lit(None)
    old_aspect = F.col("reused_aspect") if known else F.lit(None)
    return (
        both.withColumn("aspect_q", F.when(photo, F.coalesce(old_aspect, F.col("new_aspect"))))
        .withColumn("sig", F.when(photo, F.coalesce(old_sig, F.col("new_sig"))))
        .drop("reused_sig", "reused_aspect", "new_sig", "new_aspect")
    )


def index_summary(scanned: DataFrame) -> DataFrame:
    """One row per scan: scanned, indexed and bytes."""
    return scanned.agg(
        F.count("*").alias("scanned_files"),
        F.count("*").alias("indexed_files"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"),
    )


def scan_run_rows(scanned: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """Rows to append to ``scan_runs``, one per root with files.

    With ``outcomes(root_path, outcome)`` of a walk, every listed root has one, also an empty one; missing and failed
    roots have none.
    """
    counted = scanned.groupBy("root_path").agg(
        F.count("*").alias("scanned_files"),
        F.count("*").alias("indexed_files"),
        F.sum("size_bytes").alias("total_bytes"),
    )
    if outcomes is None:
        return counted
    listed = outcomes.filter(F.col("outcome").isin("listed", "empty")).select("root_path").distinct()
    zero = F.lit(0).cast("long")
    numbers = [F.coalesce(c, zero).alias(c) for c in ("scanned_files", "indexed_files", "total_bytes")]
    return listed.join(counted, "root_path", "left").select("root_path", *numbers)


def root_summaries(scanned: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Scanned and indexed files and bytes of every root asked for; zero for missing and failed ones."""
    zero = F.lit(0).cast("long")
    numbers = [F.coalesce(c, zero).alias(c) for c in ("scanned_files", "indexed_files", "total_bytes")]
    return outcomes.join(scan_run_rows(scanned), "root_path", "left").select("root_path", "outcome", *numbers)


def upsert_files(current: DataFrame, scanned: DataFrame) -> DataFrame:
    """Snapshot keyed by path.  Vanished files stay; a NULL hash overwrites an older one."""
    return upsert(current, scanned, ["absolute_path"], keep=["id"])


def drop_missing(snapshot: DataFrame, inventory: DataFrame) -> DataFrame:
    """Optional: leave out index rows whose path is no longer in the inventory."""
    return snapshot.join(inventory.select("absolute_path"), "absolute_path", "left_semi")


def delete_paths(files: DataFrame, paths: DataFrame) -> DataFrame:
    return files.join(paths.select("absolute_path"), "absolute_path", "left_anti")


def recategorize(files: DataFrame) -> DataFrame:
    return files.withColumn("category", P.classify("relative_path", "extension"))


def backfill_hashes(files: DataFrame, hasher: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Fill missing hashes of files whose size collides with another file."""
    candidates = size_candidates(files)
    wanted = candidates.filter(F.col("content_hash").isNull()).select("absolute_path")
    fresh = hasher(wanted).withColumnRenamed("content_hash", "_fresh")
    return (
        files.join(fresh, "absolute_path", "left")
        .withColumn("content_hash", F.coalesce("content_hash", "_fresh"))
        .select(*files.columns)
    )


def backfill_signatures(files: DataFrame, signer: Reader) -> DataFrame:
    """Fill missing signatures of decodable photos."""
    photo = (F.col("category") == "photo") & P.ascii_lower("extension").isin(K.DECODABLE_EXTENSIONS)
    wanted = files.filter(photo & F.col("sig").isNull()).select("absolute_path")
    fresh = signer(wanted).select(
        "absolute_path", F.col("aspect_q").alias("_aspect"), F.col("sig").alias("_sig")
    )
    return (
        files.join(fresh, "absolute_path", "left")
        .withColumn("aspect_q", F.coalesce("aspect_q", "_aspect"))
        .withColumn("sig", F.coalesce("sig", "_sig"))
        .select(*files.columns)
    )


def size_groups(files: DataFrame) -> DataFrame:
    """Sizes held by two or more files, with their number of files."""
    return files.groupBy("size_bytes").agg(F.count("*").alias("n_files")).filter("n_files >= 2")


def size_candidates(files: DataFrame) -> DataFrame:
    """Files whose size collides with another file (skew-safe for popular sizes)."""
    return lookup_join(files, size_groups(files), "size_bytes", "n_files").drop("n_files")


def category_filter(files: DataFrame, category: str | None) -> DataFrame:
    return files if category is None else files.filter(F.col("category") == category)


def category_metrics(files: DataFrame) -> DataFrame:
    """Count and bytes of the four media categories, always four rows, in their fixed order."""
    spark = files.sparkSession
    order = dimension(spark, ["position", "category"], list(enumerate(K.CATEGORIES)))
    sums = files.groupBy("category").agg(
        F.count("*").alias("n_files"), F.sum("size_bytes").alias("n_bytes")
    )
    return (
        order.join(sums, "category", "left")
        .select(
            "position",
            "category",
            F.coalesce("n_files", F.lit(0)).alias("n_files"),
            F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"),
        )
        .orderBy("position")
    )


def library_totals(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Library files and bytes, with the number of sources, phones and backups."""
    metrics = category_metrics(files).agg(
        F.sum("n_files").alias("n_files"), F.sum("n_bytes").alias("n_bytes")
    )
    counts = sources.agg(
        F.count("*").alias("n_sources"),
        F.count_if(F.col("adapter") == "adb-generic").alias("n_phones"),
        F.count_if(F.coalesce(F.col("path"), F.lit("")) != "").alias("n_backups"),
    )
    # both sides are single-row aggregates
    return metrics.withColumn("_one", F.lit(1)).join(counts.withColumn("_one", F.lit(1)), "_one").drop("_one")


def listing_order() -> list[Column]:
    """Newest first, then largest; the id makes ties definite."""
    return [
        F.coalesce(F.col("modified_unix"), F.lit(0)).desc(),
        F.col("size_bytes").desc(),
        F.col("id").asc(),
    ]


def page_files(files: DataFrame, category: str | None = None, limit: int = K.PAGE_DEFAULT,
               offset: int = 0) -> DataFrame:
    """One listing page; the limit is clamped."""
    size = max(K.PAGE_MIN, min(limit, K.PAGE_MAX))
    return category_filter(files, category).orderBy(*listing_order()).offset(max(offset, 0)).limit(size)


def page_after(files: DataFrame, modified_unix: int | None, size_bytes: int, file_id: int,
               category: str | None = None, limit: int = K.PAGE_DEFAULT) -> DataFrame:
    """The page after a given last row: a filter instead of an offset, so deep pages cost the same."""
    mtime = F.coalesce(F.col("modified_unix"), F.lit(0))
    last = modified_unix or 0
    beyond = (mtime < last) | (
        (mtime == last)
        & ((F.col("size_bytes") < size_bytes) | ((F.col("size_bytes") == size_bytes) & (F.col("id") > file_id)))
    )
    return page_files(category_filter(files, category).filter(beyond), None, limit)


def page_has_more(files: DataFrame, category: str | None = None, limit: int = K.PAGE_DEFAULT,
                  offset: int = 0) -> DataFrame:
    """Rows of a page and whether it is full (then another page may follow)."""
    size = max(K.PAGE_MIN, min(limit, K.PAGE_MAX))
    return page_files(files, category, limit, offset).agg(
        F.count("*").alias("n_rows"), (F.count("*") == size).alias("has_more")
    )
