"""Perceptual signature expressions on a 17x16 luma grid (row-major, 272 values)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mementa import constants as K
from mementa.functions.paths import _col, let

GRID_WIDTH, GRID_HEIGHT = 17, 16


def aspect_q(width: Column | str, height: Column | str) -> Column:
    """log2 aspect ratio on 0..254 in 32-bit floats; 127 when a side is zero."""
    w, h = _col(width), _col(height)
    ratio = (w.cast("float") / h.cast("float")).cast("float")
    bounded = F.greatest(F.least(F.log2(ratio).cast("float"), F.lit(2.0)), F.lit(-2.0)).cast("float")
    scaled = (((bounded + F.lit(2.0)).cast("float") / F.lit(4.0)).cast("float") * F.lit(254.0)).cast("float")
    return F.when((w == 0) | (h == 0), F.lit(127)).otherwise(F.round(scaled.cast("double"), 0).cast("int"))


def dhash256(luma: Column | str) -> Column:
    """256 difference bits as four longs (bit = left darker than right); NULL when flat.

    Neighbours are compared along the whole grid; dropping every 17th comparison leaves 16 per row.
    """

    def words(grid: Column) -> Column:
        cells = GRID_WIDTH * GRID_HEIGHT
        steps = F.zip_with(
            F.slice(grid, 1, cells - 1), F.slice(grid, 2, cells - 1),
            lambda a, b: F.when(a < b, F.lit("1")).otherwise(F.lit("0")),
        )
        bits = F.regexp_replace(F.array_join(steps, ""), "(.{16}).", "$1")
        detail = F.array_max(grid) - F.array_min(grid)
        usable = (F.size(grid) == cells) & (detail >= K.LUMA_RANGE_MIN)
        return F.when(usable, let(bits, pack))

    def pack(bits: Column) -> Column:
        # the first bit is the lowest one; base -10 reads the 64 bits as a signed number
        parts = [F.conv(F.reverse(F.substring(bits, 64 * w + 1, 64)), 2, -10).cast("long") for w in range(4)]
        return F.array(*parts)

    return let(_col(luma), words)


def bits_text(words: Column | str) -> Column:
    """The 256 bits as text, first bit first (for reports and comparisons)."""
    return F.array_join(F.transform(_col(words), lambda w: F.reverse(F.lpad(F.bin(w), 64, "0"))), "")


def hamming(a: list[Column], b: list[Column]) -> Column:
    """Differing bits between two signatures given as word columns."""
    total = F.bit_count(a[0].bitwiseXOR(b[0]))
    for x, y in zip(a[1:], b[1:]):
        total = total + F.bit_count(x.bitwiseXOR(y))
    return total


def similar(a: list[Column], aspect_a: Column, b: list[Column], aspect_b: Column) -> Column:
    """Look-alike test, the cheap aspect comparison first."""
    return (F.abs(aspect_a - aspect_b) <= K.ASPECT_TOLERANCE) & (hamming(a, b) <= K.HAMMING_LIMIT)
