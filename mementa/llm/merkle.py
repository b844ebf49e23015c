"""Merkle dataset manifest in a van Emde Boas layout.

Records are leaves of one 8-ary hash tree per ``tree`` (a language), in the order of their keys; the roots of these
trees are the leaves of one more tree, whose root names the dataset.

A tree of height H is split at half height, and its halves again, until a piece is at most ``BLOCK_HEIGHT`` high.
Such a piece is an aligned subtree, stored as one row with its nodes in van Emde Boas order, so where a node lies
follows from its depth and number alone (``address``), and so does the row's place in the whole layout
(``block_address``), by which rows are sorted.  A block's root is also a leaf of the block above: the siblings of
any node lie in one row.

Construction goes up: the leaves are dealt to blocks by position, each block is hashed by itself, and the block
roots are the leaves of the next layer.  Retrieval goes down: each block hands its leaves the siblings from them to the
root.  Blocks hold at most 8**BLOCK_HEIGHT leaves, so neither a language with most of the records nor a
huge number of languages gathers in one task, and there are at most eight layers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from mementa.llm.common import placed, stored
from mementa.operators.common import lookup_join

BITS = 3  # eight children
FAN = 1 << BITS
BLOCK_HEIGHT = 4
MAX_HEIGHT = 20
DIGEST = 32
RECORD = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def slots(levels: int) -> int:
    """Nodes of a complete tree with so many levels."""
    return ((1 << BITS * levels) - 1) // (FAN - 1)


def address(levels: int, depth: int, index):
    """The slot of node ``index`` (a number or an array) at ``depth`` in the layout of a tree with ``levels`` levels.

    The upper half of the levels comes first, then the subtrees below it one after the other, each laid out likewise.
    """
    base = index * 0
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        below, levels = BITS * (depth - top), levels - top
        subtree = index >> below
        base = base + slots(top) + subtree * slots(levels)
        index, depth = index - (subtree << below), depth - top
    return base


def layers(height: int) -> list[int]:
    """Heights of the stored pieces from the leaves up."""
    if height <= BLOCK_HEIGHT:
        return [height]
    return layers(height - height // 2) + layers(height // 2)


@lru_cache(maxsize=None)
def extent(height: int) -> int:
    """Slots of a whole stored tree; block roots count twice."""
    if height <= BLOCK_HEIGHT:
        return slots(height + 1)
    return extent(height // 2) + (1 << BITS * (height // 2)) * extent(height - height // 2)


def block_address(height: int, depth: int, index: int) -> int:
    """The first slot of the block whose root is node ``index`` at ``depth`` of a tree of that height."""
    base = 0
    while height > BLOCK_HEIGHT:
        top = height // 2
        if depth < top:
            height = top
            continue
        below, height = BITS * (depth - top), height - top
        subtree = index >> below
        base += extent(top) + subtree * extent(height)
        index, depth = index - (subtree << below), depth - top
    return base


@lru_cache(maxsize=None)
def _addresses(height: int) -> list[np.ndarray]:
    """Slots of all nodes of a block, by depth."""
    return [address(height + 1, depth, np.arange(1 << BITS * depth)) for depth in range(height + 1)]


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def block(height: int, leaves: bytes) -> bytes:
    """The nodes of a block over its leaf digests; slots of missing nodes stay zero."""
    nodes = np.zeros((slots(height + 1), DIGEST), np.uint8)
    level = leaves
    for depth in range(height, -1, -1):
        count = len(level) // DIGEST
        nodes[_addresses(height)[depth][:count]] = np.frombuffer(level, np.uint8).reshape(count, DIGEST)
        text = level.hex().encode()
        step = 2 * DIGEST * FAN
        level = b"".join(hashlib.sha256(text[i : i + step]).digest() for i in range(0, len(text), step))
    return nodes.tobytes()


def siblings(height: int, count: int, nodes: bytes) -> Iterator[list[tuple[str, str]]]:
    """For each leaf of a block in order: what stands before and after its node in its run, level by level upwards."""
    table = np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST)
    width, texts = count, []
    for depth in range(height, 0, -1):
        texts.append((width, table[_addresses(height)[depth][:width]].tobytes().hex()))
        width = -(-width // FAN)
    size = 2 * DIGEST
    for leaf in range(count):
        path, i = [], leaf
        for width, text in texts:
            first = i & -FAN
            path.append((text[size * first : size * i], text[size * (i + 1) : size * min(first + FAN, width)]))
            i >>= BITS
        yield path


def fold(digest: str, path: Sequence[tuple[str, str]]) -> str:
    """The root that a node and its siblings give."""
    for before, after in path:
        digest = _digest(before + digest + after)
    return digest


def leaf(text: Column, columns: Sequence[str] = RECORD) -> Column:
    """The leaf digest (binary) of a record with this ``text`` in place of its text column."""

    def field(value: Column) -> Column:
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    fields = [field(text if c == "text" else F.col(c).cast("string")) for c in columns]
    return F.unhex(F.sha2(F.concat(*fields), 256))


@dataclass
class Tree:
    """``leaves``: tree, height, position and the caller's columns; ``blocks``: the stored layers;
    ``roots``: tree, height, root."""

    leaves: DataFrame
    blocks: list[DataFrame]
    roots: DataFrame


def _heights(layer: int) -> Column:
    """The height of a tree's pieces in this layer; null above its top."""
    known = [layers(h) for h in range(MAX_HEIGHT + 1)]
    return F.element_at(F.array(*[F.lit(k[layer] if layer < len(k) else None).cast("int") for k in known]), F.col("height") + 1)


def _layer_count() -> Column:
    return F.element_at(F.array(*[F.lit(len(layers(h))) for h in range(MAX_HEIGHT + 1)]), F.col("height") + 1)


def _dealt(rows: DataFrame, layer: int) -> DataFrame:
    """Nodes with the block they are leaves of."""
    cut = rows.withColumn("high", _heights(layer))
    return cut.withColumn("block", F.call_function("shiftright", F.col("position"), BITS * F.col("high")))


def build(leaves: DataFrame, order: list[str], name: str) -> Tree:
    """The trees over ``leaves(tree, leaf binary, ...)``; positions follow ``order`` within a tree, nulls first.

    Every layer is written, sorted by (tree, address), and read again.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            trees, heights, numbers, highs = (batch.column(i).to_pylist() for i in range(4))
            depths = batch.column(4).to_pylist()
            lists = batch.column(5)
            some, offsets = lists.values.field("leaf"), lists.offsets.to_pylist()
            out = []
            for k, (height, number, high, depth) in enumerate(zip(heights, numbers, highs, depths)):
                digests = b"".join(some.slice(offsets[k], offsets[k + 1] - offsets[k]).to_pylist())
                nodes = block(high, digests)
                out.append((block_address(height, depth, number), len(digests) // DIGEST, nodes, nodes[:DIGEST]))
            at, counts, nodes, roots = zip(*out) if out else ([],) * 4
            columns = [batch.column(0), batch.column(1), batch.column(2), batch.column(3)]
            new = [pa.array(at, pa.int64()), pa.array(counts, pa.int32()), pa.array(nodes, pa.binary()), pa.array(roots, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *new], ["tree", "height", "block", "high", "address", "count", "nodes", "root"])

    positions, sizes = placed(leaves, "tree", order, f"{name}-leaves")
    height = sum((F.when(F.col("n") > (1 << BITS * k), 1).otherwise(0) for k in range(MAX_HEIGHT)), F.lit(0)).cast("int")
    rows = lookup_join(positions, sizes, "tree", "n").withColumn("height", height).drop("n")
    tallest = sizes.select(F.max(height)).first()[0]
    depth = F.col("height") - F.aggregate(
        F.slice(F.element_at(F.array(*[F.array(*map(F.lit, layers(h))) for h in range(MAX_HEIGHT + 1)]), F.col("height") + 1), 1, F.col("layer") + 1),
        F.lit(0), lambda a, b: a + b,
    )
    current, blocks = rows.select("tree", "height", "position", "leaf"), []
    for layer in range(max(len(layers(h)) for h in range((tallest or 0) + 1))):
        grouped = _dealt(current, layer).groupBy("tree", "height", "block", "high").agg(
            F.sort_array(F.collect_list(F.struct("position", "leaf"))).alias("leaves")
        )
        shaped = grouped.withColumn("layer", F.lit(layer)).select("tree", "height", "block", "high", depth.cast("int").alias("depth"), "leaves")
        schema = "tree string, height int, block long, high int, address long, count int, nodes binary, root binary"
        hashed = shaped.mapInArrow(run, schema).repartitionByRange("tree", "address").sortWithinPartitions("tree", "address")
        blocks.append(stored(hashed, f"{name}-layer-{layer}"))
        current = blocks[-1].filter(_layer_count() > layer + 1).select("tree", "height", F.col("block").alias("position"), F.col("root").alias("leaf"))
    roots = [b.filter(_layer_count() == i + 1).select("tree", "height", "root") for i, b in enumerate(blocks)]
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return Tree(rows, blocks, out)


PATH = "array<struct<before:string,after:string>>"


def paths(tree: Tree, above: DataFrame) -> DataFrame:
    """(tree, block, above) for every block of the lowest layer of ``tree``.

    ``above(tree, above)`` says what lies over each root: a struct with the field ``path``, to which the siblings
    from a block's root to the tree's root are put in front; other fields are handed on.
    """

    schema = f"tree string, block long, path {PATH}, rest string"
    names = ["tree", "block", "path", "rest"]

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        for batch in batches:
            for tree_id, number, high, count, nodes, upper, rest in zip(*(c.to_pylist() for c in batch.columns)):
                upper = [(p["before"], p["after"]) for p in upper]
                for start, some in _some(siblings(high, count, nodes), 500):
                    first = (number << BITS * high) + start
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([tree_id] * len(some)), pa.array(range(first, first + len(some)), pa.int64()),
                         pa.array([[{"before": b, "after": a} for b, a in p + upper] for p in some], kind), pa.array([rest] * len(some))],
                        names,
                    )

    tops = tree.roots.join(above, "tree").select("tree", _layer_count().alias("layers"), F.lit(0).cast("long").alias("block"), "path", "rest")
    found = tops.filter(F.col("layers") == len(tree.blocks)).select(*names)
    for layer in range(len(tree.blocks) - 1, 0, -1):
        rows = tree.blocks[layer].join(found, ["tree", "block"]).select("tree", "block", "high", "count", "nodes", "path", "rest")
        found = rows.mapInArrow(run, schema).unionByName(tops.filter(F.col("layers") == layer).select(*names))
    return found


def _some(rows: Iterator, size: int) -> Iterator[tuple[int, list]]:
    start, held = 0, []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield start, held
            start, held = start + size, []
    if held:
        yield start, held


def verify(leaves: DataFrame, name: str = "merkle", key: str = "doc_id") -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) per row of ``leaves(key, tree, leaf, claimed)``.

    The manifest is built from ``leaf``; then each record's ``claimed`` digest is folded with the siblings read from
    the manifest and compared with the root.  Rows with equal tree and key follow each other by leaf; no rows, no result.
    """
    docs = build(leaves.select("tree", F.col(key).cast("long").alias("id"), "leaf", "claimed"), ["id", "leaf", "claimed"], name)
    subroots = docs.roots.select(F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("root").alias("leaf"))
    top = build(subroots, ["id"], f"{name}-top")
    root = top.roots.select(F.lower(F.hex("root")).alias("rest"), F.array().cast(PATH).alias("path"), "tree")
    outer = _listed(top, paths(top, root), ["id"])
    schema = f"id string, path {PATH}, rest string"

    def hand_down(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        for high, count, nodes, upper, rest, records in _rows(batches):
            upper = [(p["before"], p["after"]) for p in upper]
            for (_, some), record in zip(_some(siblings(high, count, nodes), 1), records):
                path = [{"before": b, "after": a} for b, a in some[0] + upper]
                yield pa.RecordBatch.from_arrays([pa.array([record["id"]]), pa.array([path], kind), pa.array([rest])], ["id", "path", "rest"])

    above = outer.mapInArrow(hand_down, schema).withColumnRenamed("id", "tree")
    above = stored(above.join(docs.roots.select("tree", F.lower(F.hex("root")).alias("subroot")), "tree").select(
        "tree", "path", F.concat("subroot", F.lit(" "), "rest").alias("rest")), f"{name}-above")
    result = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"

    def check(batches):
        import pyarrow as pa

        names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
        for high, count, nodes, upper, rest, records in _rows(batches):
            upper = [(p["before"], p["after"]) for p in upper]
            subroot, root = rest.split(" ")
            shared, known, out = "".join(b + a for b, a in upper), {}, []
            for path, record in zip(siblings(high, count, nodes), records):
                proof = _digest("".join(b + a for b, a in path) + shared)
                inner = fold(record["claimed"].hex(), path)
                if inner not in known:
                    known[inner] = fold(inner, upper)
                out.append((record["id"], record["leaf"].hex(), subroot, root, proof, known[inner]))
            kinds = [pa.int64(), *[pa.string()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    checked = _listed(docs, paths(docs, above), ["id", "leaf", "claimed"]).mapInArrow(check, result)
    return checked.select(F.col("id").alias(key), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _listed(tree: Tree, above: DataFrame, columns: list[str]) -> DataFrame:
    """(high, count, nodes, path, rest, records) per block of the lowest layer; records by position."""
    records = _dealt(tree.leaves, 0).groupBy("tree", "block").agg(F.sort_array(F.collect_list(F.struct("position", *columns))).alias("records"))
    joined = tree.blocks[0].join(above, ["tree", "block"]).join(records, ["tree", "block"])
    return joined.select("high", "count", "nodes", "path", "rest", "records")


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def documents(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Leaves of ``docs``, a tree per language: null first, then by UTF-8 bytes.  ``claimed`` is the leaf that a
    tampered copy would have: where 3 divides the CRC-32 of the decimal key, the text's A-Z are lower-cased."""
    tampered = F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 0
    claimed = F.when(tampered, leaf(F.translate("text", UPPER, LOWER))).otherwise(leaf(F.col("text")))
    tree = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang")))
    return docs.select(key, tree.alias("tree"), leaf(F.col("text")).alias("leaf"), claimed.alias("claimed"))


def audit(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``verify`` over ``docs``, whose leaves are hashed once and stored.

    Null columns count as such, null keys come first, repeated rows are leaves of their own, columns outside
    ``RECORD`` are not read.
    """
    return verify(stored(documents(docs, key), "merkle-records"), "merkle", key)
