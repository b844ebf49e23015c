"""SimHash near-duplicates by a trie self-join.

Documents become 64-bit fingerprints; equal fingerprints collapse first.  Of five blocks of bits, two fingerprints
within three bits agree in two at least, so ten tries are built, each with another pair of blocks at its top.  Spark
deals out the subtrees below the top levels; in a subtree pairs of trie nodes are traversed together, differing bits
add up, and a pair is pruned when they exceed the budget.

A subtree gives the links of a spanning forest, never all pairs.  Subtrees above ``SUBTREE_ROWS`` fingerprints are cut
into a grid of cells, so that no task depends on the size of one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from mementa.llm.common import stored, text_of
from mementa.operators.components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 3
# (lowest bit, bits) of the blocks; two of them are the top of a trie
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
SUBTREE_ROWS = 4096
# Node pairs below this many comparisons are compared at once.
LEAF_PAIRS = 1 << 14
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """The SimHash of a text: bits set in more than half of its shingles' XXH64 hashes, as a signed long."""
    import xxhash

    parts = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    spans = list(zip(starts, ends[words - 1 :])) or [(0, len(joined))]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(spans), SHINGLES_AT_ONCE):
        hashes = np.array([digest(joined[a:b], 42) for a, b in spans[at : at + SHINGLES_AT_ONCE]], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(spans), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(key, fp long) per row; null and empty texts have fingerprint zero."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [fingerprint(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["key", "fp"])

    rows = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"))
    return rows.mapInArrow(run, "key long, fp long").withColumnRenamed("key", key)


def _top(fp: Column) -> Column:
    """The keys of the ten subtrees of a fingerprint."""
    blocks = [F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1)) for low, bits in BLOCKS]
    pairs = [(a, b) for a in range(len(BLOCKS)) for b in range(a)]
    return F.array(*[
        F.lit(k << 32).bitwiseOR(F.shiftleft(blocks[a], 16)).bitwiseOR(blocks[b]) for k, (a, b) in enumerate(pairs)
    ])


class _Trie:
    """Sorted fingerprints; a node is a depth and a range of them, its children split at the next bit."""

    def __init__(self, values: np.ndarray, max_bits: int):
        self.values, self.max_bits = values, max_bits
        self.label = np.arange(len(values))
        self.links: list[tuple[int, int]] = []

    def _shared(self, node: tuple[int, int]) -> int:
        """Leading bits that all members of a node share."""
        return 64 - int(self.values[node[0]] ^ self.values[node[1] - 1]).bit_length()

    def _children(self, node: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        """The two nodes below, split at the first bit in which members differ."""
        low, high = node
        rest = 64 - self._shared(node)
        first = (int(self.values[low]) >> rest << rest) | 1 << (rest - 1)
        border = low + int(np.searchsorted(self.values[low:high], np.uint64(first)))
        return (low, border), (border, high)

    def _one(self, a: tuple[int, int], b: tuple[int, int]) -> bool:
        """Whether both nodes lie in one component already."""
        first = self.label[a[0]]
        return bool((self.label[a[0] : a[1]] == first).all() and (self.label[b[0] : b[1]] == first).all())

    def _compare(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        for i in range(*a):
            near = b[0] + np.flatnonzero(np.bitwise_count(self.values[b[0] : b[1]] ^ self.values[i]) <= self.max_bits)
            others = near[self.label[near] != self.label[i]]
            for other, at in zip(*np.unique(self.label[others], return_index=True)):
                self.links.append((i, int(others[at])))
                self.label[self.label == other] = self.label[i]

    def pairs(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        """Link what lies within the budget between node ``a`` and node ``b`` (which may be the same)."""
        waiting = [(a, b)]
        while waiting:
            a, b = waiting.pop()
            if self._one(a, b):
                continue
            small = (a[1] - a[0]) * (b[1] - b[0]) <= LEAF_PAIRS
            if a == b:
                if small:
                    self._compare(a, b)
                else:
                    left, right = self._children(a)
                    waiting += [(left, right), (right, right), (left, left)]
                continue
            shared_a, shared_b = self._shared(a), self._shared(b)
            # the bits that are fixed in both nodes tell how many differ so far
            fixed = min(shared_a, shared_b)
            if (int(self.values[a[0]] ^ self.values[b[0]]) >> (64 - fixed)).bit_count() > self.max_bits:
                continue
            if small:
                self._compare(a, b)
            elif shared_a <= shared_b:
                waiting += [(child, b) for child in self._children(a)]
            else:
                waiting += [(a, child) for child in self._children(b)]


def trie_links(sides: dict[int, np.ndarray], max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links of a spanning forest: within the one side, or between two sides only.

    Fingerprints are unsigned and distinct within a side.
    """
    parts = [np.sort(v.astype(np.uint64)) for v in sides.values()]
    if len(parts) == 1:
        trie = _Trie(parts[0], max_bits)
        trie.pairs((0, len(parts[0])), (0, len(parts[0])))
    else:
        # two tries behind each other in one array; nodes never span both
        trie = _Trie(np.concatenate(parts), max_bits)
        cut = len(parts[0])
        trie.pairs((0, cut), (cut, len(trie.values)))
    signed = trie.values.view(np.int64)
    return [(int(signed[i]), int(signed[j])) for i, j in trie.links]


def links(distinct: DataFrame, max_bits: int = MAX_BITS, subtree_rows: int = SUBTREE_ROWS) -> DataFrame:
    """(a, b) links between distinct fingerprints ``fp`` whose components are those of all pairs within the budget."""
    if not 0 <= max_bits <= 3:
        raise ValueError("five blocks, of which two agree, find pairs within three bits")
    keyed = distinct.select("fp", F.explode(_top(F.col("fp"))).alias("tree"))
    busy = keyed.groupBy("tree").agg(F.count("*").alias("n")).filter("n > 1")
    cells = F.ceil(F.col("n") / subtree_rows).cast("int")
    own = F.pmod(F.xxhash64("fp", "tree"), F.col("cells")).cast("int")
    grid = keyed.join(busy, "tree").withColumn("cells", cells).withColumn("own", own)
    # each pair of cells is one task's work: a cell meets itself and every other cell once
    met = F.transform(F.sequence(F.lit(0), F.col("cells") - 1), lambda c: F.struct(F.least("own", c).alias("x"), F.greatest("own", c).alias("y")))
    dealt = (
        grid.select("tree", "fp", "own", F.explode(met).alias("cell"))
        .select("tree", "cell.x", "cell.y", "own", "fp")
        .repartition("tree", "x", "y")
        .sortWithinPartitions("tree", "x", "y")
    )

    def run(batches):
        import pyarrow as pa

        def found(group):
            own, fp = (np.concatenate(c) for c in zip(*group))
            return trie_links({k: fp[own == k].view(np.uint64) for k in np.unique(own)}, max_bits)

        for group in _groups(batches):
            if pairs := found(group):
                a, b = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _groups(batches) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """Runs of rows with equal (tree, x, y), as pieces of (own, fp)."""
    last, pieces = None, []
    for batch in batches:
        tree, x, y, own, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(tree):
            continue
        new = np.flatnonzero((np.diff(tree) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1
        for low, high in zip([0, *new], [*new, len(tree)]):
            name = (tree[low], x[low], y[low])
            if name != last and pieces:
                yield pieces
                pieces = []
            last = name
            pieces.append((own[low:high], fp[low:high].astype(np.int64)))
    if pieces:
        yield pieces


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS,
                    max_bits: int = MAX_BITS, subtree_rows: int = SUBTREE_ROWS) -> DataFrame:
    """(key, fingerprint, component_id) per row of ``docs``.

    Null and empty texts have fingerprint zero, which links like any other.  The component is the least key that can
    be reached; null keys get the least key of their group, or null where it has none.  Repeated rows stay.  Other
    columns are not read.
    """
    marked = stored(fingerprints(docs, key, text, words), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min(key).alias("least"))
    roots = connected_components(links(distinct.select("fp"), max_bits, subtree_rows))
    named = distinct.join(roots.withColumnRenamed("vertex", "fp"), "fp", "left")
    named = named.select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(least, "root").select("fp", "component_id")
    return marked.join(by_print, "fp").select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each component those with the least key.

    Rows without a key cannot be named by another and stay.  Rows that share key and text are one document and stay
    together.
    """
    kept = near_duplicates(docs, key, text).filter(F.col(key) == F.col("component_id")).select(F.col(key).alias("_kept_key")).distinct()
    return docs.join(kept.hint("shuffle_hash"), docs[key] == kept["_kept_key"], "left_semi").unionByName(docs.filter(F.col(key).isNull()))
