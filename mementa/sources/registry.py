"""Adapter registry and backup source lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from mementa import constants as K
from mementa.operators.common import dimension


def registry(spark: SparkSession) -> DataFrame:
    return dimension(spark, ["adapter", "adapter_label", "description"], K.ADAPTERS)


def all_sources(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_adapter_label(sources: DataFrame) -> DataFrame:
    """Adapter label of each source; an unknown adapter shows its id."""
    labels = registry(sources.sparkSession).select("adapter", "adapter_label")
    return sources.join(F.broadcast(labels), "adapter", "left").withColumn(
        "adapter_label", F.coalesce("adapter_label", "adapter")
    )


def latest_sources(sources: DataFrame) -> DataFrame:
    """Newest entry per id (``seq`` counts upwards), newest first."""
    newest = Window.partitionBy("id").orderBy(F.col("seq").desc())
    return (
        sources.withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
        .orderBy(F.col("seq").desc())
    )


def by_adapter(sources: DataFrame, adapter: str) -> DataFrame:
    return sources.filter(F.col("adapter") == adapter)


def with_path(sources: DataFrame) -> DataFrame:
    return sources.filter(F.coalesce(F.col("path"), F.lit("")) != "")
