"""Category sync: scan of media folders and never-overwriting copy decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mementa import constants as K
from mementa.operators.common import dimension, is_folder


def with_folder(inventory: DataFrame) -> DataFrame:
    """Split a relative path into its media folder and the path below it; a media folder itself has none below."""
    return inventory.withColumn("folder", F.substring_index("relative_path", "/", 1)).withColumn(
        "inner_path", F.regexp_extract("relative_path", "(?s)^[^/]*/(.*)$", 1)
    ).filter(F.col("relative_path").contains("/") | is_folder(inventory))


def _sub_source(media: DataFrame) -> Column:
    """First-level folder below the media folder, of what lies in it and of the folder's own row."""
    inner = F.col("inner_path")
    own = is_folder(media) & (F.length(inner) > 0)
    return F.when(F.contains(inner, F.lit("/")) | own, F.substring_index(inner, "/", 1))


def category_scan(inventory: DataFrame) -> DataFrame:
    """Files, bytes and number of first-level sub-folders per backup and media folder that exists."""
    media = with_folder(inventory).filter(F.col("folder").isin(K.SYNC_CATEGORIES))
    file = ~is_folder(media)
    # count per sub-folder first: the distinct names then need no second pass over the files
    fine = media.groupBy("backup_id", "folder", _sub_source(media).alias("sub_source")).agg(
        F.count_if(file).alias("n"), F.sum(F.when(file, F.col("size_bytes"))).alias("b")
    )
    return fine.groupBy("backup_id", F.col("folder").alias("name")).agg(
        F.sum("n").alias("file_count"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("total_bytes"),
        F.count("sub_source").alias("n_sub_sources"),
    )


def sub_sources(inventory: DataFrame) -> DataFrame:
    """Distinct first-level sub-folders, one row each (a folder may have any number of them)."""
    media = with_folder(inventory).filter(F.col("folder").isin(K.SYNC_CATEGORIES))
    named = media.select("backup_id", F.col("folder").alias("name"), _sub_source(media).alias("sub_source"))
    return named.filter("sub_source IS NOT NULL").distinct()


def top_sub_sources(names: DataFrame, shown: int = K.SUB_SOURCES_SHOWN) -> DataFrame:
    """The first names in order, joined with commas; at most ``shown`` are ever collected."""
    window = Window.partitionBy("backup_id", "name").orderBy("sub_source")
    first = names.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= shown)
    return first.groupBy("backup_id", "name").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "sub_source"))), lambda x: x["sub_source"]),
            ", ",
        ).alias("sub_source_label")
    )


def media_mapping(df: DataFrame, folder: str) -> DataFrame:
    """Destination category of a folder: messenger folders map to media, others stay."""
    mapping = dimension(df.sparkSession, ["_folder", "_target"], K.MESSENGER_MEDIA_MAPPING)
    return (
        df.join(F.broadcast(mapping), F.col(folder) == F.col("_folder"), "left")
        .withColumn("destination", F.coalesce("_target", F.col(folder)))
        .drop("_folder", "_target")
    )


def requested_verdicts(requested: DataFrame, inventory: DataFrame, source_root: str) -> DataFrame:
    """Verdict per requested category: unsupported, missing folder, or ok."""
    present = with_folder(inventory).select("folder").distinct().withColumn("_there", F.lit(True))
    verdict = (
        F.when(~F.col("category").isin(K.SYNC_CATEGORIES), "unsupported")
        .when(F.col("_there"), "ok")
        .otherwise("missing")
    )
    error = F.when(
        F.col("verdict") == "unsupported", F.concat(F.lit("Unsupported category: "), "category")
    ).when(
        F.col("verdict") == "missing",
        F.concat(F.lit(f"Missing category folder: {source_root}/"), "category"),
    )
    return (
        requested.join(present, F.col("category") == F.col("folder"), "left")
        .withColumn("verdict", verdict)
        .withColumn("error", error)
        .select("category", "verdict", "error")
    )


def sync_actions(inventory: DataFrame, target: DataFrame, verdicts: DataFrame, destination_root: str) -> DataFrame:
    """Copy or skip per source file of an accepted category; a size difference adds an error."""
    accepted = (
        verdicts.filter(F.col("verdict") == "ok").select(F.col("category").alias("folder")).distinct()
    )
    files = media_mapping(
        with_folder(inventory.filter(~is_folder(inventory))).join(F.broadcast(accepted), "folder", "left_semi"), "folder"
    )
    there = with_folder(target.filter(~is_folder(target))).select(
        F.col("folder").alias("destination"), "inner_path", F.col("size_bytes").alias("target_size")
    )
    joined = files.join(there, ["destination", "inner_path"], "left")
    exists = F.col("target_size").isNotNull()
    return (
        joined.withColumn("action", F.when(exists, "skipped").otherwise("copied"))
        .withColumn(
            "error",
            F.when(
                exists & (F.col("target_size") != F.col("size_bytes")),
                F.concat(
                    F.lit(f"Skipped existing file with different size: {destination_root}/"),
                    "destination", F.lit("/"), "inner_path",
                ),
            ),
        )
        .select("absolute_path", "folder", "destination", "inner_path", "size_bytes", "action", "error")
    )


def sync_summary(actions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Copied and skipped files and bytes, with the number of errors of both kinds."""
    copied, skipped = F.col("action") == "copied", F.col("action") == "skipped"
    files = actions.agg(
        F.count_if(copied).alias("copied_files"),
        F.count_if(skipped).alias("skipped_files"),
        F.coalesce(F.sum(F.when(copied, F.col("size_bytes"))), F.lit(0)).alias("copied_bytes"),
        F.coalesce(F.sum(F.when(skipped, F.col("size_bytes"))), F.lit(0)).alias("skipped_bytes"),
        F.count("error").alias("file_errors"),
    )
    refused = verdicts.agg(F.count("error").alias("category_errors"))
    return files.withColumn("_one", F.lit(1)).join(refused.withColumn("_one", F.lit(1)), "_one").drop("_one")


def sync_errors(actions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """All error texts, one row each."""
    return verdicts.filter("error IS NOT NULL").select("error").unionByName(
        actions.filter("error IS NOT NULL").select("error")
    )
