"""Secret scans with multipart credential linking.

A scan of each text finds base secrets, which are always reported, and weak candidates: user names, key-like tokens
and endpoints, which mean little alone.  An interval join within a document brings the parts together: a weak
candidate is reported only where the parts that complete it lie within ``REACH`` code points.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, functions as F

from mementa.llm.common import stored, text_of

REACH = 200
#: Base patterns and least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ASSIGN_LEAST = 12
# runs are maximal, so a least length inside the pattern drops just the short ones
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
# weak candidates
NAME = re.compile(r"""(?:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", re.ASCII | re.IGNORECASE)
KEY = re.compile(r"[A-Za-z0-9+/_=-]{32,}")
ENDPOINT = re.compile(r"""(?:https?|jdbc|postgres|mysql|mongodb|redis|s3):[^\s"'<>]{6,}""", re.ASCII)
KINDS = ("assign", "access", "hex", "name", "key", "endpoint")
# what a part is: 1 identifier, 2 secret, 4 endpoint
ROLES = (2, 1, 2, 1, 2, 4)
# the roles that must lie near a weak candidate
NEEDS = {3: 2, 4: 1, 5: 3}
_WORDS = ("passw", "secret", "token", "api")
_NAMES = ("user", "login", "client", "account")
_SCHEMES = ("http:", "https:", "jdbc:", "postgres:", "mysql:", "mongodb:", "redis:", "s3:")


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the base secrets and of the weak candidates, in code points."""
    folded = text.lower()  # the words save pattern runs
    base = []
    if any(w in folded for w in _WORDS):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    weak = []
    if any(w in folded for w in _NAMES):
        weak += [(m.start(), 3, m.end()) for m in NAME.finditer(text)]
    weak += [(m.start(), 4, m.end()) for m in KEY.finditer(text) if _mixed(m[0])]
    if any(w in text for w in _SCHEMES):
        weak += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    return sorted(base), sorted(weak)


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.isupper() for c in token) and any(c.islower() for c in token)


def _found(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, key, base, weak) per row of ``docs``; ``row`` tells repeated keys apart."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        names, row = ("start", "kind", "end"), TaskContext.get().partitionId() << 33
        for batch in batches:
            found = [scan(t) for t in batch.column(1).to_pylist()]
            spans = [pa.array([[dict(zip(names, s)) for s in f[k]] for f in found], span) for k in (0, 1)]
            rows = pa.array(range(row, row + len(found)), pa.int64())
            row += len(found)
            yield pa.RecordBatch.from_arrays([rows, batch.column(0), *spans], ["row", "key", "base", "weak"])

    span = "array<struct<start:int,kind:int,end:int>>"
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    return rows.mapInArrow(run, f"row long, key {kind}, base {span}, weak {span}")


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """(row, start, kind, end) of the weak candidates whose complementary parts lie within ``reach``.

    Texts are cut into cells of ``reach`` code points.  A candidate looks from every cell it touches, a part is seen
    from every cell within reach of it, so a cell holds few of either.  Roles are gathered per candidate by a bitwise
    or, which combines before its shuffle.
    """
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.col("p.kind") + 1)
    need = F.create_map(*[F.lit(x) for pair in NEEDS.items() for x in pair])[F.col("w.kind")]

    def cell(position):
        return F.floor(position / reach).cast("int")

    parts = found.filter(F.size("weak") > 0).select("row", F.explode(F.concat("base", "weak")).alias("p"))
    parts = parts.select("row", "p", role.alias("role")).withColumn(
        "cell", F.explode(F.sequence(cell(F.col("p.start") - reach), cell(F.col("p.end") + reach)))
    )
    weak = found.select("row", F.explode("weak").alias("w")).withColumn(
        "cell", F.explode(F.sequence(cell(F.col("w.start")), cell(F.col("w.end"))))
    )
    near = (F.col("p.start") <= F.col("w.end") + reach) & (F.col("w.start") <= F.col("p.end") + reach) & (F.col("p") != F.col("w"))
    roles = weak.join(parts, ["row", "cell"]).filter(near).groupBy("row", "w").agg(F.bit_or("role").alias("roles"))
    return roles.filter(F.col("roles").bitwiseAND(need) == need).select("row", "w.start", "w.kind", "w.end")


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """(key, base, spans) per row of ``docs``: base secrets, and all reported spans, both sorted arrays of
    (start, kind, end) with kinds numbered as in ``KINDS``.

    Null and empty texts have none; repeated rows and null keys are scanned like others; other columns are not read.
    """
    found = stored(_found(docs, key, text), "secret-spans")
    more = linked(found, reach).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return found.join(more, "row", "left").select(F.col("key").alias(key), "base", spans.alias("spans"))


def joined(spans):
    """``kind:start:end`` by start, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans) per row of ``find_secrets``'s result."""
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)) for k in range(3)]
    counts = [(F.size("base") - rest).cast("long").alias(f"n_{KINDS[k]}") for k, rest in enumerate(counts)]
    return found.select(key, *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def digest_of(spans: list[tuple[int, int, int]]) -> str:
    """The same digest in plain Python, for single texts."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
