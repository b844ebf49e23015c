"""Photo sources: decode with Spark's image source, reduce to a luma grid on the executors."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mementa.functions import paths as P
from mementa.functions import signature as S
from mementa.session import reliable_checkpoint

# Formats without a decoder in the image source.
UNSUPPORTED = ["webp"]
GRID_SCHEMA = "absolute_path string, width int, height int, luma array<int>"


def decoded(spark: SparkSession, path: str, only: Column | None = None) -> DataFrame:
    """Decodable images below ``path``, or those whose file metadata pass ``only``; others are dropped."""
    raw = (
        spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    )
    return (raw if only is None else raw.filter(only)).select(
        _path_of(F.col("image.origin")).alias("absolute_path"),
        F.col("image.width").alias("width"),
        F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
    )


def triangle_weights(source: int, target: int) -> np.ndarray:
    """Rows of normalised triangle-filter weights that resample ``source`` samples to ``target``."""
    ratio = source / target
    support = max(ratio, 1.0)
    centers = (np.arange(target) + 0.5) * ratio
    offsets = (np.arange(source) + 0.5)[None, :] - centers[:, None]
    weights = np.clip(1.0 - np.abs(offsets) / support, 0.0, None)
    return weights / weights.sum(axis=1, keepdims=True)


def luma_grid(pixels: np.ndarray) -> np.ndarray:
    """17x16 luma values of an image in blue-green-red order (or one grey channel)."""
    down = triangle_weights(pixels.shape[0], S.GRID_HEIGHT)
    across = triangle_weights(pixels.shape[1], S.GRID_WIDTH)
    small = np.einsum("ij,jkc,lk->ilc", down, pixels.astype(np.float64), across)
    small = np.clip(np.rint(small), 0, 255)
    if small.shape[2] == 1:
        return small[:, :, 0].astype(int).ravel()
    blue, green, red = small[:, :, 0], small[:, :, 1], small[:, :, 2]
    return ((2126 * red + 7152 * green + 722 * blue) // 10000).astype(int).ravel()


def _reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        grids = []
        for width, height, channels, data in zip(
            batch["width"], batch["height"], batch["channels"], batch["data"]
        ):
            pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
            grids.append(luma_grid(pixels))
        yield pd.DataFrame(
            {"absolute_path": batch["absolute_path"], "width": batch["width"],
             "height": batch["height"], "luma": grids}
        )


def luma_grids(images: DataFrame) -> DataFrame:
    return images.mapInPandas(_reduce, GRID_SCHEMA)


def with_signature(grids: DataFrame) -> DataFrame:
    """Add aspect_q and the 256-bit signature (NULL for flat images) to a grid table."""
    return grids.withColumn("aspect_q", S.aspect_q("width", "height")).withColumn("sig", S.dhash256("luma"))


# Bits of the map of wanted photos: 4 MB at most, at any number of photos.
WANTED_BITS = 1 << 25


def _path_of(origin: Column) -> Column:
    return F.url_decode(F.replace(F.regexp_replace(origin, "^file:/+", "/"), F.lit("+"), F.lit("%2B")))


def decoded_only(wanted: DataFrame, folder: str, bits: int = WANTED_BITS) -> DataFrame:
    """Decodable images among ``wanted(absolute_path)`` below ``folder``.

    A map of ``bits`` bits of the wanted paths becomes a filter on the file's path in the scan: files outside it are
    dropped from the listing and neither read nor decoded.  What it lets through by chance falls to the join.
    """
    spark = wanted.sparkSession
    slot = F.pmod(F.xxhash64("absolute_path"), F.lit(bits)) + 1
    # rows of at most 4 KB, bits / 32768 of them
    marks = wanted.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("m")).collect()
    parts = {r["b"]: bytes(r["m"]) for r in marks}
    if not parts:
        return decoded_schema(spark)
    held = sorted(parts)
    here = F.pmod(F.xxhash64(_path_of(F.col("_metadata.file_path"))), F.lit(bits)) + 1
    bucket, position = F.bitmap_bucket_number(here), F.bitmap_bit_position(here)
    row = F.element_at(F.array(*[F.lit(parts[b]) for b in held]), F.array_position(F.array(*[F.lit(b) for b in held]), bucket).cast("int"))
    byte = F.conv(F.hex(F.substring(row, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.call_function("shiftright", byte, F.pmod(position, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1
    known = F.array_contains(F.array(*[F.lit(b) for b in held]), bucket)
    try:
        found = decoded(spark, folder, F.when(known, marked).otherwise(F.lit(False)))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return decoded_schema(spark)
    return found.join(wanted.select("absolute_path").distinct(), "absolute_path", "left_semi")


def decoded_schema(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "absolute_path string, width int, height int, channels int, data binary")


def common_folder(wanted: DataFrame) -> str | None:
    """The deepest folder that holds all wanted paths."""
    least, greatest = wanted.agg(F.min("absolute_path"), F.max("absolute_path")).first()
    return None if least is None else os.path.dirname(os.path.commonprefix([least, greatest])) or "/"


def photo_status(wanted: DataFrame, folder: str | None = None) -> DataFrame:
    """(absolute_path, status, aspect_q, sig) per wanted photo: ``signed``, ``flat`` (no signature), ``unsupported``
    (no decoder for its format) or ``unreadable`` (missing, hidden from Spark's sources, or broken)."""
    wanted = reliable_checkpoint(wanted.select("absolute_path").distinct())
    folder = folder or common_folder(wanted)
    unsupported = P.extension("absolute_path").isin(UNSUPPORTED)
    images = decoded_schema(wanted.sparkSession) if folder is None else decoded_only(wanted.filter(~F.coalesce(unsupported, F.lit(False))), folder)
    signed = with_signature(luma_grids(images)).select("absolute_path", "aspect_q", "sig", F.lit(True).alias("read"))
    status = F.when(unsupported, "unsupported").when(F.col("read").isNull(), "unreadable").when(F.col("sig").isNull(), "flat").otherwise("signed")
    return wanted.join(signed, "absolute_path", "left").select("absolute_path", status.alias("status"), "aspect_q", "sig")


def sign_files(wanted: DataFrame, folder: str | None = None) -> DataFrame:
    """Signatures of wanted photos: (absolute_path, aspect_q, sig); others are left out.  Only wanted photos are read."""
    return photo_status(wanted, folder).filter(F.col("status").isin("signed", "flat")).select("absolute_path", "aspect_q", "sig")


def signer(spark: SparkSession, folder: str) -> Callable[[DataFrame], DataFrame]:
    """``sign_files`` for photos below a known folder."""
    return lambda wanted: sign_files(wanted, folder)
