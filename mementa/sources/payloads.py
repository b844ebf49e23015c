"""Payload sources: whole text files, JSON documents, archive entries and message tables."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from mementa.session import reliable_checkpoint

HEAD_BYTES = 128
ENTRY_SCHEMA = "archive_path string, entry_index int, entry_name string, head binary, content binary"


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: (source_path, text)."""
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return raw.select(
        F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("source_path"),
        F.col("value").alias("text"),
    )


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbered lines per file, in file order."""
    return whole_text(spark, path).select(
        "source_path", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line")
    )


FRAME_ROWS, FRAME_BYTES, READ_BYTES = 1000, 32 << 20, 1 << 20
STATUS_SCHEMA = "archive_path string, status string, error string"
# fixed values of the zip format: signatures and sizes of its records
END_RECORD, END64_LOCATOR, END64_RECORD, DIRECTORY_ENTRY, LOCAL_ENTRY = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, LOCATOR_SIZE, DIRECTORY_SIZE, LOCAL_SIZE, MAX_COMMENT = 22, 20, 46, 30, 0xFFFF


def _directory(file: BinaryIO) -> tuple[int, int]:
    """(offset, number of entries) of the central directory, from the end of the file."""
    size = file.seek(0, os.SEEK_END)
    tail_at = max(0, size - END_SIZE - MAX_COMMENT)
    file.seek(tail_at)
    tail = file.read()
    at = tail.rfind(END_RECORD)
    if at < 0 or len(tail) - at < END_SIZE:
        raise ValueError("no end record")
    count, offset = struct.unpack_from("<10xHxxxxI", tail, at)
    locator = tail_at + at - LOCATOR_SIZE
    if locator >= 0 and (count == 0xFFFF or offset == 0xFFFFFFFF):
        file.seek(locator)
        found = file.read(LOCATOR_SIZE)
        if found.startswith(END64_LOCATOR):
            file.seek(struct.unpack_from("<8xQ", found)[0])
            record = file.read(56)
            if not record.startswith(END64_RECORD):
                raise ValueError("no 64-bit end record")
            count, offset = struct.unpack_from("<32xQ8xQ", record)
    return offset, count


def _entry_infos(file: BinaryIO) -> Iterator[tuple[str, int, int, int, int]]:
    """(name, method, flags, compressed size, offset of the local header), read from the directory bit by bit."""
    offset, count = _directory(file)
    for _ in range(count):
        file.seek(offset)
        fixed = file.read(DIRECTORY_SIZE)
        if len(fixed) < DIRECTORY_SIZE or not fixed.startswith(DIRECTORY_ENTRY):
            raise ValueError("broken directory")
        flags, method, packed, plain, names, extras, comment, local = struct.unpack_from("<8xHH8xIIHHH8xI", fixed)
        name, extra = file.read(names), file.read(extras)
        offset += DIRECTORY_SIZE + names + extras + comment
        while len(extra) >= 4:  # 64-bit values stand where the 32-bit ones are full
            kind, length = struct.unpack_from("<HH", extra)
            if kind == 1:
                values = iter(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                plain = next(values, plain) if plain == 0xFFFFFFFF else plain
                packed = next(values, packed) if packed == 0xFFFFFFFF else packed
                local = next(values, local) if local == 0xFFFFFFFF else local
            extra = extra[4 + length :]
        yield name.decode("utf-8" if flags & 0x800 else "cp437", "replace"), method, flags, packed, local


def _first_bytes(file: BinaryIO, method: int, flags: int, packed: int, local: int, wanted: int | None) -> bytes | None:
    """The first ``wanted`` bytes of an entry, or all; NULL where it is encrypted or packed in an unknown way."""
    if flags & 1 or method not in (0, 8):
        return None
    file.seek(local)
    header = file.read(LOCAL_SIZE)
    if not header.startswith(LOCAL_ENTRY):
        raise ValueError("broken entry")
    file.seek(sum(struct.unpack_from("<26xHH", header)), os.SEEK_CUR)
    unpack = zlib.decompressobj(-15) if method == 8 else None
    out, left = bytearray(), packed
    while left > 0 and (wanted is None or len(out) < wanted):
        piece = file.read(min(left, READ_BYTES if wanted is None else 4096))
        if not piece:
            raise ValueError("truncated entry")
        left -= len(piece)
        room = 0 if wanted is None else wanted - len(out)
        out += unpack.decompress(piece, room) if unpack else piece
    return bytes(out if wanted is None else out[:wanted])


def _scan(path: str, with_content: bool) -> Iterator[tuple]:
    """Rows of an archive's entries, then one row with its status in the place of an entry."""
    count = 0
    try:
        with open(path, "rb") as file:
            for name, *where in _entry_infos(file):
                head = _first_bytes(file, *where, HEAD_BYTES)
                body = _first_bytes(file, *where, None) if with_content else None
                yield path, count, name, head, body, None, None
                count += 1
    except (OSError, ValueError, struct.error, zlib.error) as error:
        yield path, None, None, None, None, "unreadable", str(error)
        return
    yield path, None, None, None, None, "listed" if count else "empty", None


class Archives(NamedTuple):
    """``entries``: one row per entry with its first bytes; ``status``: (archive_path, status, error) per archive, which
    is listed, empty or unreadable.  Of an unreadable one, the entries before the fault are listed."""

    entries: DataFrame
    status: DataFrame


def scan_archives(paths: DataFrame, with_content: bool = False) -> Archives:
    """Zip archives on a shared file system by ``archive_path``.

    An archive is read in ranges: its end record, its directory entry by entry, and the first bytes of each entry, so its
    size does not matter.  Entries are spread one archive a task; with ``with_content``, each entry must fit in memory.
    """
    spark = paths.sparkSession
    columns = ["archive_path", "entry_index", "entry_name", "head", "content", "status", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=columns).astype({"entry_index": "Int64"})

        rows, size = [], 0
        for batch in batches:
            for path in batch["archive_path"]:
                for row in _scan(path, with_content):
                    rows.append(row)
                    size += len(row[4] or row[3] or b"")
                    if len(rows) >= FRAME_ROWS or size >= FRAME_BYTES:
                        yield frame(rows)
                        rows, size = [], 0
        yield frame(rows)

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = paths.select("archive_path").distinct().repartition(width, "archive_path")
    found = reliable_checkpoint(spread.mapInPandas(run, f"{ENTRY_SCHEMA}, status string, error string"))
    entries = found.filter("status IS NULL").drop("status", "error")
    return Archives(entries, found.filter("status IS NOT NULL").select("archive_path", "status", "error"))


def archive_paths(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path``, without reading them."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.select(F.regexp_replace("path", "^file:/+", "/").alias("archive_path"))


def archive_entries(spark: SparkSession, path: str, with_content: bool = False) -> DataFrame:
    """The entries of all archives below ``path``."""
    return scan_archives(archive_paths(spark, path), with_content).entries


def messages(spark: SparkSession, table: str = "messages") -> DataFrame:
    """Message table (key_remote_jid, data, timestamp); empty when the table is absent."""
    if not spark.catalog.tableExists(table):
        return spark.createDataFrame([], "key_remote_jid string, data string, timestamp long")
    return spark.table(table).select("key_remote_jid", "data", "timestamp")


def optional_table(spark: SparkSession, table: str) -> DataFrame | None:
    return spark.table(table) if spark.catalog.tableExists(table) else None


def listing_logs(spark: SparkSession, path: str) -> DataFrame:
    """Collected listing logs laid out as <device>/<folder>.txt: (device, folder, line_no, line)."""
    lines = text_lines(spark, path)
    parts = F.split("source_path", "/")
    return lines.select(
        F.element_at(parts, -2).alias("device"),
        F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("folder"),
        "line_no",
        "line",
    )
