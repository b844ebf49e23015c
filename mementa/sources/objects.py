"""Stored contents in chunks: (hash, chunk, data), partitioned by run and the first two characters of the hash.

A file is cut by its size before a byte is read, so its chunks are read by different tasks and no cell, batch or task
ever holds a whole file, whatever its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, functions as F

from mementa.session import reliable_checkpoint

CHUNK_BYTES = 4 << 20
# Names of objects with several chunks are broadcast up to this number and joined by key beyond it.
BROADCAST_NAMES = 100_000


def chunks(wanted: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(absolute_path, hash, chunk, size_bytes) per chunk of ``wanted(absolute_path, content_hash, size_bytes)``; an
    empty file has one."""
    last = F.greatest(F.ceil(F.col("size_bytes") / chunk_bytes) - 1, F.lit(0)).cast("long")
    return wanted.select("absolute_path", F.col("content_hash").alias("hash"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"), "size_bytes")


def from_files(wanted: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(hash, chunk, data) of files on a shared file system; a missing or changed length is an error."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, name, chunk, size in zip(*(c.to_pylist() for c in batch.columns)):
                begin = chunk * chunk_bytes
                with open(path, "rb") as file:
                    file.seek(begin)
                    data = file.read(chunk_bytes)
                if len(data) != min(chunk_bytes, size - begin):
                    raise OSError(f"{path} changed while it was stored")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([chunk], pa.int64()), pa.array([data], pa.binary())], ["hash", "chunk", "data"])

    width = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = chunks(wanted, chunk_bytes).repartition(width, "hash", "chunk").sortWithinPartitions("hash", "chunk")
    return spread.mapInArrow(run, "hash string, chunk long, data binary")


def from_table(contents: DataFrame, content: str = "content", chunk_bytes: int = CHUNK_BYTES) -> Callable[[DataFrame], DataFrame]:
    """The same over a table (absolute_path, content) with the bytes inline."""

    def run(wanted: DataFrame) -> DataFrame:
        held = contents.select("absolute_path", F.col(content).cast("binary").alias("_data"))
        # the narrow side is hashed, so the bytes are not sorted
        found = held.join(wanted.select("absolute_path", "content_hash", "size_bytes").hint("shuffle_hash"), "absolute_path")
        each = found.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size_bytes") / chunk_bytes) - 1, F.lit(0)).cast("long"))))
        piece = F.substring("_data", (F.col("chunk") * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes))
        return each.select(F.col("content_hash").alias("hash"), "chunk", piece.alias("data"))

    return run


def sharded(stored: DataFrame, run: str) -> DataFrame:
    return stored.select("hash", "chunk", "data", F.lit(run).alias("run_id"), F.substring("hash", 1, 2).alias("shard"))


def read_back(objects: DataFrame) -> DataFrame:
    """(hash, n_bytes, intact) per stored object.

    An object of one chunk, as most are, is hashed where it is read.  Only those of several chunks are shuffled: their
    chunks are streamed in order through SHA-256.  Chunks that two runs stored at once count once.
    """
    first = F.when(F.col("chunk") == 0, F.struct((F.sha2("data", 256) == F.col("hash")).alias("intact"), F.octet_length("data").cast("long").alias("n_bytes")))
    held = objects.select("hash", "chunk", first.alias("first")).groupBy("hash").agg(F.max("chunk").alias("last"), F.min("first").alias("first"))
    single = held.filter("last = 0").select("hash", "first.n_bytes", "first.intact")
    several = reliable_checkpoint(objects.filter("chunk > 0").select("hash").distinct())
    n = several.count()
    if not n:
        return single
    rows = objects.select("hash", "chunk", "data").join(F.broadcast(several) if n <= BROADCAST_NAMES else several, "hash", "left_semi")
    return single.unionByName(_streamed(rows))


def _streamed(objects: DataFrame) -> DataFrame:
    """``read_back`` of objects of any number of chunks."""

    def run(batches):
        import pyarrow as pa

        for name, size, digest in _objects(batches):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([digest == name])], ["hash", "n_bytes", "intact"])

    ordered = objects.select("hash", "chunk", "data").repartition("hash").sortWithinPartitions("hash", "chunk")
    return ordered.mapInArrow(run, "hash string, n_bytes long, intact boolean")


def _objects(batches) -> Iterator[tuple[str, int, str]]:
    name, following, size, digest = None, 0, 0, None
    for batch in batches:
        for key, chunk, data in zip(*(c.to_pylist() for c in batch.columns)):
            if key != name:
                if name is not None:
                    yield name, size, digest.hexdigest()
                name, following, size, digest = key, 0, 0, hashlib.sha256()
            if chunk == following:
                following, size = following + 1, size + len(data)
                digest.update(data)
            elif chunk > following:
                digest.update(b"missing")  # a gap can never give the object's own hash
                following = chunk + 1
    if name is not None:
        yield name, size, digest.hexdigest()
