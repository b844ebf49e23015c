"""Shared building blocks: constant dimensions, group winners, skew-safe lookups, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from mementa.session import reliable_checkpoint

# A key with at least this many rows is broadcast by ``lookup_join``: at most rows/HEAVY_KEY_ROWS keys,
# 100,000 (about 15 MB) for 10^11 rows.  Its members are spread over SALTS values.
HEAVY_KEY_ROWS = 1_000_000
SALTS = 4096


def dimension(spark: SparkSession, names: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    """A small constant table, planned as a literal (no Python worker, no RDD)."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))


def is_folder(inventory: DataFrame) -> Column:
    """Whether a row is a folder; inventories without ``is_dir`` hold files only."""
    return F.coalesce("is_dir", F.lit(False)) if "is_dir" in inventory.columns else F.lit(False)


def group_winner(df: DataFrame, group: Sequence[str], order: Sequence[Column], columns: Sequence[str],
                 last: bool = False) -> DataFrame:
    """One row per group: ``columns`` of the first (or last) row in ``order``.

    A min/max over a struct combines map-side, so a group holding a third of all rows sends one row
    per task instead of its members.  Descending order is expressed by negating the order column.
    """
    ordering = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    packed = F.struct(*ordering, *[F.col(c) for c in columns])
    chosen = (F.max if last else F.min)(packed).alias("_w")
    return df.groupBy(*group).agg(chosen).select(*group, *[F.col(f"_w.{c}").alias(c) for c in columns])


def _spread(df: DataFrame) -> Column:
    """A deterministic salt from the plain columns of a row."""
    plain = [f"`{n}`" for n, t in df.dtypes if t in ("string", "bigint", "int", "boolean", "double")]
    return F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int")


def lookup_join(big: DataFrame, small: DataFrame, key: str, rows: str,
                heavy_rows: int = HEAVY_KEY_ROWS, total: int | None = None) -> DataFrame:
    """``big`` inner join ``small`` (one row per key, ``rows`` = rows of ``big`` with that key).

    Keys with ``heavy_rows`` or more rows are few by construction (at most rows/heavy_rows), so their
    values are broadcast and their members take a salt, which spreads them over the one shuffle that
    joins all other keys.  ``big`` is read once, and both uses of ``small`` share one exchange.  When
    the caller knows ``total``, the rows of ``big``, to be below the limit, no key can be heavy.
    """
    if total is not None and total < heavy_rows:
        return big.join(small, key)
    values = [c for c in small.columns if c != key]
    packed = F.struct(*values)

    def route(salt: Column) -> Column:
        # one struct key: with two keys the optimizer would fold the constant salt of the light side
        # out of the join, and heavy members would meet in one task after all
        return F.struct(F.col(key).alias("key"), salt.cast("int").alias("salt"))

    heavy = small.filter(F.col(rows) >= heavy_rows).select(key, packed.alias("_heavy"))
    light = small.filter(F.col(rows) < heavy_rows).select(route(F.lit(0)).alias("_route"), packed.alias("_light"))
    tagged = big.withColumn("_spread", _spread(big)).join(F.broadcast(heavy), key, "left")
    salt = F.when(F.col("_heavy").isNotNull(), F.col("_spread") + 1).otherwise(F.lit(0))
    joined = tagged.withColumn("_route", route(salt)).join(light, "_route", "left")
    return joined.filter("_heavy IS NOT NULL OR _light IS NOT NULL").select(
        *big.columns, *[F.coalesce(F.col(f"_heavy.{c}"), F.col(f"_light.{c}")).alias(c) for c in values]
    )


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str],
           keep: Sequence[str] = ()) -> DataFrame:
    """New snapshot: rows of ``changes`` replace rows of ``current`` with the same keys.

    Columns in ``keep`` retain the current value.  ``changes`` must hold one row per key.  A changed
    value wins even when it is NULL, so the side is chosen by a marker, not by ``coalesce``.
    """
    columns = current.columns
    left = current.withColumn("_old", F.lit(True)).alias("o")
    right = changes.withColumn("_new", F.lit(True)).alias("n")
    joined = left.join(right, list(keys), "full_outer")

    def pick(name: str) -> Column:
        if name in keys:
            return F.col(name)
        if name not in changes.columns:
            return F.col(f"o.{name}").alias(name)
        if name in keep:
            return F.when(F.col("_old"), F.col(f"o.{name}")).otherwise(F.col(f"n.{name}")).alias(name)
        return F.when(F.col("_new"), F.col(f"n.{name}")).otherwise(F.col(f"o.{name}")).alias(name)

    return joined.select(*[pick(c) for c in columns])


def number_rows(rows: DataFrame, order: Sequence[str], start: int, name: str) -> DataFrame:
    """``rows`` with consecutive numbers from ``start`` in the given order, without gaps.

    Rows are range-partitioned and sorted; a row's number is its place in its range plus the rows of the ranges before.
    There is one count per range, which bounds the window over them and the broadcast.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = reliable_checkpoint(ranged.withColumn("_place", F.monotonically_increasing_id()))
    part = F.call_function("shiftright", F.col("_place"), F.lit(33))
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_begin"))
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.withColumn("_part", part).join(F.broadcast(begins), "_part")
    return numbered.select(*rows.columns, (F.col("_begin") + within + start).alias(name))


def prefix_sum(df: DataFrame, group: Sequence[str], position: str, value: str, out: str,
               block: int = 100_000) -> DataFrame:
    """Sum of ``value`` over the earlier positions of the group.

    Positions are cut into blocks: one window inside each block, one over the block totals.  A huge
    group is therefore spread over many tasks instead of being sorted by a single one.
    """
    cut = df.withColumn("_block", F.floor(F.col(position) / block))
    inner = Window.partitionBy(*group, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*group, "_block").agg(F.sum(value).alias("_total"))
    starts = totals.withColumn("_start", F.coalesce(F.sum("_total").over(outer), F.lit(0))).drop("_total")
    return (
        cut.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(starts, [*group, "_block"])
        .withColumn(out, F.col("_start") + F.col("_inner"))
        .drop("_block", "_start", "_inner")
    )
