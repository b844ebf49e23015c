"""Collected device listings: media previews, denied paths, device status, message databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from mementa import constants as K
from mementa.functions import paths as P
from mementa.functions import text as X
from mementa.operators.common import dimension


def listing_files(lines: DataFrame) -> DataFrame:
    """Non-blank lines of file listings, trimmed, flagged when access was denied."""
    return (
        lines.withColumn("line", X.trim_unicode("line"))
        .filter(F.length("line") > 0)
        .withColumn("denied", F.col("line").contains("Permission denied"))
    )


def listing_counts(lines: DataFrame) -> DataFrame:
    """Files and denied lines per device and folder."""
    return listing_files(lines).groupBy("device", "folder").agg(
        F.count_if(~F.col("denied")).alias("file_count"),
        F.count_if(F.col("denied")).alias("permission_denied"),
    )


def listing_preview(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """Six rows per device: files, bytes and availability of each media folder.

    ``sizes`` holds the size listing (device, folder, size_text in KiB).
    """
    spark = lines.sparkSession
    known = F.array(
        *[F.struct(F.lit(k).alias("folder"), F.lit(p).alias("remote_path")) for k, p in K.DEVICE_MEDIA_FOLDERS]
    )
    devices = lines.select("device").distinct().select("device", F.inline(known))
    measured = sizes.groupBy("device", "folder").agg(
        F.max(X.kib_to_bytes("size_text")).alias("total_bytes")
    )
    count = F.coalesce("file_count", F.lit(0))
    return (
        devices.join(listing_counts(lines), ["device", "folder"], "left")
        .join(measured, ["device", "folder"], "left")
        .select(
            "device",
            F.col("folder").alias("key"),
            F.col("folder").alias("label"),
            "remote_path",
            count.alias("file_count"),
            F.coalesce("total_bytes", F.lit(0)).alias("total_bytes"),
            (count > 0).alias("available"),
        )
    )


def selected_folders(df: DataFrame, keys: list[str] | None, column: str = "key") -> DataFrame:
    """Only the chosen folders; all of them when no choice is given."""
    return df if keys is None else df.filter(F.col(column).isin(keys))


def device_rows(lines: DataFrame) -> DataFrame:
    """Serial and status per device line, without the header and incomplete lines."""
    words = F.split(X.trim_unicode("line"), r"(?U)\s+")
    return (
        lines.filter(F.col("line_no") > 1)
        .withColumn("_w", words)
        .filter((F.size("_w") >= 2))
        .select("host", "line_no", F.get("_w", F.lit(0)).alias("serial"), F.get("_w", F.lit(1)).alias("status"))
        .withColumn("source_id", P.uuid5("serial"))
        .withColumn("redacted_id", P.redact("serial"))
    )


def device_status(lines: DataFrame) -> DataFrame:
    """Devices by status."""
    return device_rows(lines).groupBy("status").agg(F.count("*").alias("n_devices"))


def message_db_choice(lines: DataFrame) -> DataFrame:
    """The message database to fetch per device.

    First folder with a candidate; in it the current file by format, else the greatest name.  The
    row_number filter limits each task to one row per device before the shuffle.
    """
    order = dimension(
        lines.sparkSession, ["folder", "folder_rank"], [(f, i) for i, f in enumerate(K.MESSAGE_DB_FOLDERS)]
    )
    name = F.col("name")
    preference = (
        F.when(name == K.PREFERRED_MESSAGE_DBS[0], 0).when(name == K.PREFERRED_MESSAGE_DBS[1], 1).otherwise(2)
    )
    candidates = (
        lines.withColumn("name", X.trim_unicode("line"))
        .filter(name.endswith(".crypt15") | name.endswith(".crypt14"))
        .join(F.broadcast(order), "folder")
        .withColumn("preference", preference)
    )
    best = Window.partitionBy("device").orderBy("folder_rank", "preference", F.col("name").desc())
    return (
        candidates.withColumn("_rank", F.row_number().over(best))
        .filter(F.col("_rank") == 1)
        .select(
            "device",
            F.concat_ws("/", "folder", "name").alias("remote_path"),
            P.message_db_format("name").alias("format"),
        )
    )
