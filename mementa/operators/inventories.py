"""Inventories of backup payloads: item metrics, archives and folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mementa import constants as K
from mementa.operators.common import is_folder
from mementa.schemas import ITEM_METRICS_JSON


def item_metrics(documents: DataFrame) -> DataFrame:
    """One row per listed item of (backup_id, backup_label, text); missing counts become 0."""
    items = documents.select(
        "backup_id", "backup_label", F.inline(F.from_json("text", ITEM_METRICS_JSON)["ListItems"])
    )
    return items.filter("Type IS NOT NULL").select(
        "backup_id",
        "backup_label",
        F.col("Type").alias("item_type"),
        F.coalesce("ViewCount", F.lit(0)).alias("view_count"),
        F.coalesce("ContentCount", F.lit(0)).alias("content_count"),
        F.coalesce("Size", F.lit(0)).alias("size_bytes"),
    )


def top_item_metrics(metrics: DataFrame, shown: int = K.ITEM_METRICS_SHOWN) -> DataFrame:
    return metrics.orderBy("backup_id", "item_type", "size_bytes").limit(shown)


def readable_xml(head: Column | str) -> Column:
    """Whether the first bytes look like text XML: an XML start, or nothing but ASCII."""
    digits = F.hex(F.substring(head, 1, 128))
    return digits.startswith("3C3F786D6C") | ~digits.rlike("^(?:[0-9A-F]{2})*?[89A-F]")


def archive_inventory(entries: DataFrame) -> DataFrame:
    """Per archive: entry counts by type and a status from its last call-log entry.

    A row without an entry name stands for an archive without entries.
    """
    name = F.col("entry_name")
    call_log = (F.col("item_type") == "CALLLOG") & name.endswith("call_log.exml")
    keys = ["backup_id", "backup_label", "item_type", "archive_path"]
    # the last call-log entry decides; a boolean keeps the aggregation buffer fixed-width (hash based)
    readable = F.when(call_log, readable_xml("head"))
    counted = entries.withColumn("_readable", readable).groupBy(*keys).agg(
        F.count("entry_name").alias("entry_count"),
        F.count_if(name.endswith(".enc")).alias("encrypted_entries"),
        F.count_if(name.contains("/image/") | name.endswith(".jpg") | name.endswith(".png")).alias(
            "image_entries"
        ),
        F.count_if(name.contains("/blob/")).alias("blob_entries"),
        F.max_by("_readable", F.when(F.col("_readable").isNotNull(), F.col("entry_index"))).alias("_readable"),
    )
    encrypted = (F.col("item_type") == "CONTACT") & (F.col("encrypted_entries") > 0)
    return counted.withColumn(
        "parse_status",
        F.when(encrypted, "encrypted_contact_payload").otherwise(
            F.when(F.col("_readable"), "xml_readable")
            .when(~F.col("_readable"), "binary_or_encrypted_exml")
            .otherwise("inventory_only")
        ),
    ).drop("_readable")


def with_unlisted(inventory: DataFrame, archives: DataFrame, status: DataFrame) -> DataFrame:
    """``archive_inventory`` of ``archives(backup_id, backup_label, item_type, archive_path)``, also of those that
    ``status(archive_path, status)`` calls empty (no entries) or unreadable (status ``unreadable``)."""
    zero = F.lit(0).cast("long")
    told = archives.join(status, "archive_path").filter(F.col("status") != "listed")
    others = told.select(
        "backup_id", "backup_label", "item_type", "archive_path",
        *[zero.alias(c) for c in ("entry_count", "encrypted_entries", "image_entries", "blob_entries")],
        F.when(F.col("status") == "empty", "inventory_only").otherwise(F.col("status")).alias("parse_status"),
    )
    bad = told.filter("status = 'unreadable'").select("archive_path")
    return inventory.join(bad, "archive_path", "left_anti").select(*others.columns).unionByName(others)


def folder_inventory(inventory: DataFrame, folder_names: list[str]) -> DataFrame:
    """Number of files under each named top folder of a backup, as archive inventory rows; empty folders count zero."""
    top = F.substring_index("relative_path", "/", 1)
    zero = F.lit(0).cast("long")
    counted = (
        inventory.withColumn("item_type", top)
        .filter(F.col("item_type").isin(folder_names) & (F.col("relative_path").contains("/") | is_folder(inventory)))
        .groupBy(
            "backup_id", "backup_label", "item_type",
            F.concat_ws("/", "root_path", "item_type").alias("archive_path"),
        )
    )
    return counted.agg(F.count_if(~is_folder(inventory)).alias("entry_count")).select(
        "backup_id", "backup_label", "item_type", "archive_path", "entry_count",
        zero.alias("encrypted_entries"), zero.alias("image_entries"), zero.alias("blob_entries"),
        F.lit("inventory_only").alias("parse_status"),
    )


def takeout_roots(inventory: DataFrame) -> DataFrame:
    """Roots that look like an account export."""
    top = F.substring_index("relative_path", "/", 1)
    folder = top.isin("Takeout", "Google Photos") & (F.col("relative_path").contains("/") | is_folder(inventory))
    marker = folder | (F.col("relative_path") == "Archive Browser.html")
    return inventory.groupBy("root_path").agg(F.bool_or(marker).alias("is_export"))
