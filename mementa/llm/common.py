"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from mementa.session import scratch_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: evaluated once, safe against lost executors."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def gather(pool: np.ndarray, offsets: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """The slices ``pool[offsets[k]:offsets[k + 1]]`` for every k of ``picks``, one after the other."""
    lengths = offsets[picks + 1] - offsets[picks]
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return pool[:0]
    return pool[np.repeat(offsets[picks] - ends + lengths, lengths) + np.arange(ends[-1])]


def int_lists(chunks: Iterable[bytes]):
    """An Arrow list<int32> array from one little-endian buffer per row."""
    import pyarrow as pa

    chunks = list(chunks)
    offsets = np.zeros(len(chunks) + 1, np.int32)
    np.cumsum([len(c) // 4 for c in chunks], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(chunks), "<i4")))


def by_bytes(batches: Iterable, column: int, limit: int) -> Iterator:
    """The rows of Arrow batches in order, in batches of at most ``limit`` bytes of a text column, or one longer row.

    A row counts 16 bytes more, so that empty texts are bounded, too.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy().astype(np.int64) + 16)
        start, begin = 0, 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, begin + limit - size, "right"))
            if stop <= start and held:
                yield pa.concat_batches(held)
                held, size = [], 0
                continue
            stop = max(stop, start + 1)
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1]) - begin
            start, begin = stop, int(ends[stop - 1])
    if held:
        yield pa.concat_batches(held)


def int_rows(array) -> Iterator[np.ndarray]:
    """The rows of an Arrow list<int32> array as numpy views."""
    values = array.values.to_numpy(zero_copy_only=False)
    offsets = array.offsets.to_numpy()
    for i in range(len(array)):
        yield values[offsets[i] : offsets[i + 1]]


def placed(rows: DataFrame, group: str, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``position`` (long, from 0) among the rows of their ``group`` by ``order``, and (group, n) per group.

    ``group`` is a column without nulls; rows that agree in all of ``order`` get consecutive positions in no defined
    order, nulls come first.  Rows are range-partitioned by group and order, so a group with most of the rows is spread.
    Each range counts for itself; only its first group can go on from earlier ranges, which makes one row per range to
    broadcast.  ``rows`` must not have columns named position, part, ordinal or leading.
    """
    at = rows.columns.index(group)

    def number(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, first, last, count = TaskContext.get().partitionId(), None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(at).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(groups[1:] != groups[:-1]) + 1])
            lengths = np.diff(np.append(starts, len(groups)))
            ordinal = np.arange(len(groups)) - np.repeat(starts, lengths)
            first = groups[0] if first is None else first
            if groups[0] == last:
                ordinal[: lengths[0]] += count
            last, count = groups[-1], int(ordinal[-1]) + 1
            new = [pa.array(np.full(len(groups), part, np.int32)), pa.array(ordinal), pa.array((groups == first).astype(bool))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "part", "ordinal", "leading"])

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    numbered = stored(ranged.mapInArrow(number, f"{fields}, part int, ordinal long, leading boolean"), name)
    counts = numbered.groupBy(group, "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.withColumn("before", F.sum("n").over(earlier)).filter("before > 0").select("part", "before")
    position = F.col("ordinal") + F.when(F.col("leading"), F.coalesce("before", F.lit(0))).otherwise(0)
    positions = numbered.join(F.broadcast(carried), "part", "left").select(*rows.columns, position.alias("position"))
    return positions, counts.groupBy(group).agg(F.sum("n").alias("n"))
