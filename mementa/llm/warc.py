"""WARC archives in Zstandard with an embedded dictionary.

An archive starts with a skippable frame that holds a Zstandard dictionary; every record after it is a frame of its
own, compressed with that dictionary.  Writers train the dictionary from the first records of the archive (at most
``SAMPLE_BYTES``) and hold no more than these; an archive ends after ``ARCHIVE_BYTES`` of payload.

Tasks write into a shared folder.  A file name is new for every attempt, and only archives that a successful task
reports exist for a reader, so lost executors and repeated tasks leave unread files at worst.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from mementa.llm.common import stored

#: The frame magic of the dictionary (WARC in Zstandard) and of Zstandard dictionaries.
DICTIONARY_FRAME = 0x184D2A5D
LEAST_REVISIT_BYTES = 1000
SAMPLE_BYTES = 2 << 20
SAMPLE_RECORD_BYTES = 64 << 10
DICTIONARY_BYTES = 64 << 10
ARCHIVE_BYTES = 256 << 20
LEVEL = 3
READ_BYTES = 1 << 20
READ_TASKS = 20_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ODD = re.compile(r"[^!-~]")


def _uri(url: str) -> str:
    """A header-safe form: what is not printable ASCII is percent-encoded."""
    return _ODD.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit of ``refers_to`` without."""
    revisit = refers_to is not None
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        body += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def dictionary(samples: list[bytes]):
    """A dictionary from some records; where they are too few or too small to train, their own bytes."""
    import zstandard

    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
        except zstandard.ZstdError:
            pass
    raw = b"".join(samples)[-DICTIONARY_BYTES:]
    return zstandard.ZstdCompressionDict(raw or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(out, records: Iterable[bytes]) -> int:
    """Write dictionary and records to a binary stream; the number of records."""
    import zstandard

    records, samples, held = iter(records), [], 0
    first = []
    for data in records:
        first.append(data)
        samples.append(data[:SAMPLE_RECORD_BYTES])
        held += len(data)
        if held >= SAMPLE_BYTES:
            break
    trained = dictionary(samples)
    content = trained.as_bytes()
    out.write(struct.pack("<II", DICTIONARY_FRAME, len(content)) + content)
    compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained).compress
    count = 0
    for some in (first, records):
        for data in some:
            out.write(compress(data))
            count += 1
    return count


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a binary stream; one record is held at a time."""
    import zstandard

    magic, size = struct.unpack("<II", _exactly(source, 8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    known = zstandard.ZstdCompressionDict(_exactly(source, size))
    context = zstandard.ZstdDecompressor(dict_data=known)
    rest = b""
    while rest or (rest := source.read(READ_BYTES)):
        frame, parts = context.decompressobj(), []
        while not frame.eof:
            rest = rest or source.read(READ_BYTES)
            if not rest:
                raise EOFError("a record's frame ends early")
            parts.append(frame.decompress(rest))
            rest = frame.unused_data
        head, _, tail = b"".join(parts).partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield headers, tail[: int(headers["Content-Length"])]


def _exactly(source, size: int) -> bytes:
    data = b""
    while len(data) < size:
        more = source.read(size - len(data))
        if not more:
            raise EOFError("the archive ends early")
        data += more
    return data


def _filesystem(folder: str):
    """The file system and path of a shared folder, for use inside tasks."""
    from pyarrow import fs

    if folder.startswith("file:") or "://" not in folder:
        return fs.LocalFileSystem(), urlparse(folder).path
    return fs.FileSystem.from_uri(folder)


def _payload_key():
    """Payloads are equal when both digests and the length are."""
    return F.concat_ws(":", F.sha1("payload"), F.sha2("payload", 256), F.octet_length("payload").cast("string"))


def write(pages: DataFrame, folder: str, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Write a record per row of ``pages(page_id, url, html)`` below ``folder``; (archive, records) per archive.

    Of records with equal payloads of ``least`` bytes or more the one with the largest page_id is the response (rows
    that share that page_id all are), the others revisit it.  Null html is an empty payload, a null url gives no
    target header, rows without page_id are responses unless a page with the same payload has one.  Other columns
    are not read.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("same", F.when(F.octet_length("payload") >= least, _payload_key()))
    newest = rows.filter("same IS NOT NULL").groupBy("same").agg(F.max("page_id").alias("newest"), F.count("*").alias("n"))
    newest = newest.filter("n > 1").select("same", "newest")
    # small payloads share no key: they would meet in one task
    rows = rows.withColumn("same", F.coalesce("same", F.concat_ws(":", F.lit("small"), F.col("page_id").cast("string"))))
    joined = rows.join(newest, "same", "left")
    revisit = F.when(F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest")), F.col("newest"))
    planned = joined.select("page_id", "url", "payload", revisit.alias("refers_to"))

    def run(batches):
        import pyarrow as pa

        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        more = True

        def limited():
            """Records up to the size of an archive."""
            nonlocal more
            size = 0
            for page_id, url, payload, refers_to in rows:
                yield record(page_id, url, payload, refers_to)
                size += len(payload)
                if size >= ARCHIVE_BYTES:
                    return
            more = False

        while more:
            name = f"{root}/{uuid.uuid4().hex}.warc.zst"
            with files.open_output_stream(name, compression=None) as out:
                count = write_archive(out, limited())
            if count:
                yield pa.RecordBatch.from_pydict({"archive": [name], "records": [count]})
            else:
                files.delete_file(name)

    written = planned.mapInArrow(run, "archive string, records long")
    return stored(written, "warc-archives")


def read(spark: SparkSession, archives: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload) per record of the listed archives.

    Every archive is a task of its own, up to ``READ_TASKS``: their list is too short for adaptive execution to see how
    much lies behind it.  A response whose payload does not have the recorded digest is an error.  ``payload`` is null
    for revisits.
    """
    tasks = max(1, min(archives.count(), READ_TASKS))

    def run(batches):
        import pyarrow as pa

        files, _ = _filesystem(folder)
        kinds = {
            "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(),
            "payload_digest": pa.string(), "payload_bytes": pa.int64(), "payload": pa.binary(),
        }

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))

        for batch in batches:
            for name in batch.column(0).to_pylist():
                some, held = [], 0
                with files.open_input_stream(name, compression=None) as source:
                    for headers, block in read_archive(source):
                        some.append(_row(headers, block))
                        held += len(block) + 200
                        if held > 8 << 20:
                            yield out(some)
                            some, held = [], 0
                if some:
                    yield out(some)

    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
    return archives.select("archive").repartition(tasks).mapInArrow(run, schema)


def _page(uri: str | None) -> int | None:
    name = None if uri is None else uri[len("<urn:x-page:") : -1]
    return None if name in (None, "none") else int(name)


def _row(headers: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = headers["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    return (
        _page(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), kind, _page(headers.get("WARC-Refers-To")),
        digest, size, payload if kind == "response" else None,
    )
