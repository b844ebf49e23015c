"""Exact deduplication by Grace hashing.

1. In each input partition equal texts collapse in a table of bounded size (a full table is sent on and started
   anew), so a text with a third of all rows leaves a partition as one row.
2. The surviving texts are shuffled by a 64-bit hash of their content.
3. A task whose bucket does not fit its table cuts it into spill files by another hash and handles each of them the
   same way, until a bucket fits.

The table is Python's dict: open addressing, with a comparison of the complete content on every hit.  Step 3 gives one
row per distinct content: its SHA-256, its least document id and its size.  Documents find their group by SHA-256 in
a join of narrow rows, where adaptive execution splits a hot group.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterable, Iterator
from contextlib import ExitStack

from pyspark.sql import Column, DataFrame, functions as F

from mementa.llm.common import text_of

TABLE_BYTES = 64 << 20
FAN_OUT = 16
ROW_BYTES = 200
BATCH_BYTES = 8 << 20


def normalised(text: str = "text") -> Column:
    """Every run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(text_of(text), r"[\x20\x09-\x0D]+", " ")


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def grace(rows: Iterable[tuple], limit: int, fan_out: int = FAN_OUT, depth: int = 1) -> Iterator[tuple]:
    """(content, least id, count) per distinct content of ``rows``, which have the same form.

    At most ``limit`` bytes of content are held (one content at least).
    """
    import xxhash

    held, known, rows = 0, {}, iter(rows)
    for content, least, count in rows:
        entry = known.get(content)
        if entry is not None:
            entry[0], entry[1] = _least(entry[0], least), entry[1] + count
            continue
        held += len(content) + ROW_BYTES
        known[content] = [least, count]
        if held > limit and len(known) > 1:
            break
    else:
        for content, (least, count) in known.items():
            yield content, least, count
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        names = [f"{folder}/{k}" for k in range(fan_out)]
        with ExitStack() as stack:
            files = [stack.enter_context(open(name, "wb")) for name in names]

            def spill(content, least, count):
                bucket = xxhash.xxh64_intdigest(content, depth) % fan_out
                pickle.dump((content, least, count), files[bucket], pickle.HIGHEST_PROTOCOL)

            for content, (least, count) in known.items():
                spill(content, least, count)
            known.clear()
            for row in rows:
                spill(*row)
        for name in names:
            yield from grace(_spilled(name), limit, fan_out, depth + 1)


def _spilled(name: str) -> Iterator[tuple]:
    with open(name, "rb") as file:
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return


def _collapse(rows: Iterable[tuple], limit: int) -> Iterator[tuple]:
    """Equal contents as one row, as far as a table of ``limit`` bytes reaches."""
    held, known = 0, {}
    for content, least, count in rows:
        entry = known.get(content)
        if entry is not None:
            entry[0], entry[1] = _least(entry[0], least), entry[1] + count
            continue
        if held > limit:
            yield from ((c, *e) for c, e in known.items())
            held, known = 0, {}
        held += len(content) + ROW_BYTES
        known[content] = [least, count]
    yield from ((c, *e) for c, e in known.items())


def _batches(rows: Iterable[tuple], kinds: dict, size) -> Iterator:
    """Rows as Arrow batches of bounded bytes."""
    import pyarrow as pa

    held, some = 0, []
    for row in rows:
        some.append(row)
        held += size(row)
        if held > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds.values())], list(kinds))
            held, some = 0, []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds.values())], list(kinds))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = TABLE_BYTES, fan_out: int = FAN_OUT) -> DataFrame:
    """(text_sha256, keep_id, group_size) per distinct normalised text."""

    def collapse(batches):
        import pyarrow as pa
        import xxhash

        rows = ((c, i, 1) for b in batches for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        out = ((xxhash.xxh64_intdigest(c) - (1 << 63), c, i, n) for c, i, n in _collapse(rows, limit))
        kinds = {"bucket": pa.int64(), "content": pa.string(), "least": pa.int64(), "n": pa.int64()}
        yield from _batches(out, kinds, lambda r: len(r[1]) + 50)

    def dedup(batches):
        import hashlib

        import pyarrow as pa

        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))))
        out = ((hashlib.sha256(c.encode()).hexdigest(), i, n) for c, i, n in grace(rows, limit, fan_out))
        yield from _batches(out, {"text_sha256": pa.string(), "keep_id": pa.int64(), "group_size": pa.int64()}, lambda r: 100)

    rows = docs.select(F.col(key).cast("long").alias("id"), normalised(text).alias("content"))
    dealt = rows.mapInArrow(collapse, "bucket long, content string, least long, n long").repartition("bucket")
    return dealt.mapInArrow(dedup, "text_sha256 string, keep_id long, group_size long")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = TABLE_BYTES) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) per row of ``docs``, dropped rows too.

    Null texts are empty texts.  Of equal texts the row with the least key stays; null keys stay only where a group
    has no other, and rows that share the least key and the text are all marked as kept, being one document listed
    twice.  Other columns are not read.
    """
    named = docs.select(F.col(key).cast("long").alias("id"), F.sha2(normalised(text), 256).alias("text_sha256"))
    found = named.join(groups(docs, key, text, limit), "text_sha256")
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    return found.select(F.col("id").alias(key), "keep_id", "group_size", kept.alias("kept"), "text_sha256")
