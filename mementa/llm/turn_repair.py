"""Conversation structure repair by prefix-doubling path ranking.

The rows of a conversation are to spell role initials ``(s?(ua)+)?``.  Edits go over them in order: K keeps a row, R
gives it the role user or assistant, D deletes it, I inserts a row with an empty text.  Of the cheapest edit
sequences the one whose initials, the audit, come first in ASCII order is applied.

Nodes of the search are (row, state), with the states start, after system, after user, after assistant.

1. Rows get their positions by range partitioning and are cut into blocks of ``BLOCK_ROWS``; a row is one letter then.
2. Each block after the first gives the cheapest costs between its entry and exit states, a 4 x 4 matrix.  A conversation's
   matrices are multiplied (min, +) from its end, which gives each block the costs behind it.
3. With them, a cost DP goes back through each block.  Its optimal arcs are ranked by their least audits of 1,
   2, 4, ... letters: the rank of twice the length is that of the pair (rank, rank behind the doubled pointer).
   The least-ranked arc of an entry starts the block's least path, and the pointers, from the longest
   to the shortest, fill it in.  From a node each initial leads on by one arc at most, so audits and paths correspond.
4. Blocks are chained by their exit states, and the chosen pieces of the audit meet the rows in one ordered pass.

Texts are shuffled once, for step 4.  There, one task reads a conversation's rows in order, as their SHA-256 demands,
and holds no more than one of them and a piece of the audit.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from mementa.llm.common import placed, stored

BLOCK_ROWS = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that the next user or assistant row leads to, by state.
NEXT = [USER, USER, ASSISTANT, USER]
#: What is left to insert behind the last row, by state.
REST = ["", "II", "I", ""]
FINAL = [INSERT * len(r) for r in REST]
INITIALS = "sua"
SPACE = " \t\n\x0b\x0c\r"
FAR = 1 << 60
# A row's letter tells its initial (four kinds) and its first fault: none, truncated, blank, duplicate.
LETTERS = "abcdefghijklmnop"
WHOLE, CUT, BLANK, DUPLICATE = range(4)
_LEGAL = {(0, 1), (1, 2), (2, 1)}
# Arcs of so many entries times rows are ranked together.
RANKED = 1 << 18


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` with faults planted by the CRC-32 of ``conv_id:turn`` modulo 20:
    0 drops the row, 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4 makes its role user.

    Null roles and texts become one space, and null numbers count as one space in the checksum.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"),
                                (F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.filter("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def _conversation() -> Column:
    """The key of a conversation; null is a conversation of its own."""
    return F.coalesce(F.col("conv_id").cast("string"), F.lit(""))


def rows_by_turn(turns: DataFrame) -> DataFrame:
    """(conv, position, turn, role, digest, letter) per row, without its text.

    Rows go by turn, nulls first; rows of one turn by role and the SHA-256 of the text.  Nulls count as one space.
    """
    spaced = lambda c: F.coalesce(F.col(c), F.lit(" "))
    trimmed = F.rtrim(spaced("text"), F.lit(SPACE))
    fault = F.when(trimmed == "", BLANK).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(WHOLE)
    initial = F.substring(spaced("role"), 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    narrow = turns.select(_conversation().alias("conv"), "turn", spaced("role").alias("role"), F.sha2(spaced("text"), 256).alias("digest"),
                          fault.cast("int").alias("fault"), kind.cast("int").alias("kind"))
    rows, _ = placed(narrow, "conv", ["turn", "role", "digest"], "turns")
    # the first of equal rows: one per (conversation, position), so equal texts do not gather in the join
    firsts = rows.groupBy("conv", "role", "digest").agg(F.min("position").alias("position")).select("conv", "position", F.lit(True).alias("first"))
    marked = rows.join(firsts, ["conv", "position"], "left")
    known = F.when((F.col("fault") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    letter = F.substring(F.lit(LETTERS), 4 * F.col("kind") + known + 1, F.lit(1))
    return marked.select("conv", "position", "turn", "role", "digest", letter.alias("letter"))


def transfer(letters: str) -> list[int]:
    """Least costs from each state in front of the rows to each state behind them, row by row."""
    out = []
    for entry in range(4):
        cost = [FAR] * 4
        cost[entry] = 0
        for letter in letters:
            kind, fault = divmod(ord(letter) - 97, 4)
            start, system, user, assistant = cost
            user = min(user, start + INSERT, system + INSERT, assistant + INSERT)
            assistant = min(assistant, user + INSERT)
            cost = [start + DELETE, system + DELETE, user + DELETE, assistant + DELETE]
            if fault < BLANK:
                more = TRUNCATED if fault == CUT else 0
                before = min(start, system, assistant) + more
                if kind == 0:
                    cost[SYSTEM] = min(cost[SYSTEM], start + KEEP + more)
                cost[USER] = min(cost[USER], before + (KEEP if kind == 1 else REROLE))
                cost[ASSISTANT] = min(cost[ASSISTANT], user + more + (KEEP if kind == 2 else REROLE))
        out += cost
    return out


class Arcs:
    """The optimal arcs of some blocks: letter, head node, and where each node's arcs begin."""

    def __init__(self) -> None:
        self.letters: list[int] = []
        self.heads: list[int] = []
        self.begins: list[int] = []

    def add(self, letters: str, ends: list[int]) -> tuple[int, int]:
        """Append a block whose exits cost ``ends``; (its first node, its cost from the start state)."""
        values, size = [ends], len(letters)
        for letter in reversed(letters):
            kind, fault = divmod(ord(letter) - 97, 4)
            after = values[-1]
            cost = [v + DELETE for v in after]
            if fault < BLANK:
                more = TRUNCATED if fault == CUT else 0
                user = after[USER] + more + (KEEP if kind == 1 else REROLE)
                cost = [min(cost[0], user), min(cost[1], user), min(cost[2], after[ASSISTANT] + more + (KEEP if kind == 2 else REROLE)), min(cost[3], user)]
                if kind == 0:
                    cost[START] = min(cost[START], after[SYSTEM] + more + KEEP)
            user, assistant = min(cost[USER], cost[ASSISTANT] + INSERT), min(cost[ASSISTANT], cost[USER] + INSERT)
            values.append([min(cost[0], user + INSERT), min(cost[1], user + INSERT), user, assistant])
        values.reverse()
        base, node = len(self.begins), len(self.begins)
        for i, letter in enumerate(letters):
            kind, fault = divmod(ord(letter) - 97, 4)
            here, after = values[i], values[i + 1]
            more = TRUNCATED if fault == CUT else 0
            for state in range(4):
                self.begins.append(len(self.heads))
                best, follow = here[state], NEXT[state]
                if after[state] + DELETE == best:
                    self._arc("D", node + 4 + state)
                if here[follow] + INSERT == best:
                    self._arc("I", node + follow)
                if fault < BLANK:
                    kept = SYSTEM if kind == 0 and state == START else follow if kind == follow - 1 else None
                    if kept is not None and after[kept] + more + KEEP == best:
                        self._arc("K", node + 4 + kept)
                    if after[follow] + more + REROLE == best:
                        self._arc("R", node + 4 + follow)
            node += 4
        for state in range(4):
            self.begins.append(len(self.heads))
            self._arc("\0", base + 4 * size + state)
        return base, values[0][START]

    def _arc(self, letter: str, head: int) -> None:
        self.letters.append(ord(letter))
        self.heads.append(head)

    def least(self, entries: list[int]) -> list[tuple[bytes, int]]:
        """(audit, exit node) of the least path from each entry node to its block's exits."""
        letters, heads, begins = np.array(self.letters, np.uint8), np.array(self.heads), np.array(self.begins)
        number = np.arange(len(heads))

        def first(rank: np.ndarray) -> np.ndarray:
            """The least-ranked arc of every node."""
            return np.minimum.reduceat(rank * len(heads) + number, begins) % len(heads)

        rank = letters.astype(np.int64)
        pointer = first(rank)[heads]
        pointers = []
        while True:
            rank = np.unique(rank * (len(heads) + 256) + rank[pointer], return_inverse=True)[1]
            pointers.append(pointer)
            if not letters[pointer].any():
                break
            pointer = pointer[pointer]
        path = first(rank)[np.array(entries)][:, None]
        for pointer in reversed(pointers):
            path = np.stack([path, pointer[path]], axis=2).reshape(len(path), -1)
        return [(bytes(row).rstrip(b"\0"), end) for row, end in zip(letters[path], heads[pointers[-1][path[:, -1]]].tolist())]


def least_pieces(blocks: list[tuple[str, list[int], bool]]) -> Iterator[tuple[int, list[int], list[str]]]:
    """(cost from the start, exit states, pieces) per block ``(letters, costs behind it, whether it is the last)``, by entry
    state."""
    arcs, nodes = Arcs(), []
    for letters, ends, _ in blocks:
        nodes.append(arcs.add(letters, ends))
    found = arcs.least([base + state for base, _ in nodes for state in range(4)])
    for k, ((base, cost), (letters, _, last)) in enumerate(zip(nodes, blocks)):
        some = found[4 * k : 4 * k + 4]
        exits = [end - base - 4 * len(letters) for _, end in some]
        yield cost, exits, [piece.decode() + (REST[e] if last else "") for (piece, _), e in zip(some, exits)]


def _ends(blocks: list[dict]) -> list[list[int]]:
    """The costs behind each block, from the matrices of those after it."""
    out = [FINAL]
    for block in reversed(blocks[1:]):
        costs, matrix = out[-1], block["matrix"]
        out.append([min(matrix[4 * a + b] + costs[b] for b in range(4)) for a in range(4)])
    return out[::-1]


def audits(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """From ``rows_by_turn``: (conv, blank, duplicate, truncated, illegal, cost, audit) per conversation, and the audit in
    pieces (conv, block, piece, turn, role, digest) with the order of the row each starts at."""

    def measure(batches):
        import pyarrow as pa

        names = ["conv", "block", "letters", "first", "matrix", "pairs", "head", "tail"]
        for batch in batches:
            matrices, pairs, heads, tails = [], [], [], []
            for number, letters in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                matrices.append(transfer(letters) if number else [])
                kinds = [(ord(c) - 97) // 4 for c in letters]
                pairs.append(sum(p not in _LEGAL for p in zip(kinds, kinds[1:])))
                heads.append(kinds[0])
                tails.append(kinds[-1])
            new = [pa.array(matrices, pa.list_(pa.int64())), *[pa.array(v, pa.int64()) for v in (pairs, heads, tails)]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names)

    def chain(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(1).to_pylist()
            illegal = [sum(b["pairs"] for b in some) + sum((a["tail"], b["head"]) not in _LEGAL for a, b in zip(some, some[1:])) for some in lists]
            new = [pa.array(illegal, pa.int64()), pa.array([_ends(some) for some in lists], pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *new], ["conv", "illegal", "ends"])

    def rank(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())]
        for batch in batches:
            waiting = sorted(zip(*(c.to_pylist() for c in batch.columns)), key=lambda r: len(r[2]))
            while waiting:
                count = 1
                while count < len(waiting) and (count + 1) * 4 * len(waiting[count][2]) <= RANKED:
                    count += 1
                some, waiting = waiting[:count], waiting[count:]
                found = least_pieces([(letters, ends, last) for _, _, letters, ends, last in some])
                out = [(conv, number, *f) for (conv, number, *_), f in zip(some, found)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["conv", "block", "cost", "exits", "pieces"])

    number = F.floor(F.col("position") / block_rows).cast("long")
    inner = F.array_sort(F.collect_list(F.struct("position", "letter")))
    grouped = rows.groupBy("conv", number.alias("block")).agg(
        F.array_join(F.transform(inner, lambda r: r["letter"]), "").alias("letters"), F.min(F.struct("turn", "role", "digest")).alias("first")
    )
    kind = f"struct<turn:{rows.schema['turn'].dataType.simpleString()},role:string,digest:string>"
    schema = f"conv string, block long, letters string, first {kind}, matrix array<long>, pairs long, head long, tail long"
    blocks = stored(grouped.mapInArrow(measure, schema), "turn-blocks")
    of_fault = lambda f: F.sum(F.length(F.regexp_replace("letters", f"[^{LETTERS[f]}{LETTERS[f + 4]}{LETTERS[f + 8]}{LETTERS[f + 12]}]", "")))
    faults = blocks.groupBy("conv").agg(of_fault(BLANK).alias("blank"), of_fault(DUPLICATE).alias("duplicate"), of_fault(CUT).alias("truncated"))
    listed = blocks.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "matrix", "pairs", "head", "tail"))).alias("blocks"))
    chained = stored(listed.mapInArrow(chain, "conv string, illegal long, ends array<array<long>>"), "turn-chains")
    behind = chained.select("conv", F.size("ends").alias("n"), F.posexplode("ends").alias("block", "ends"))
    joined = blocks.join(behind.withColumn("block", F.col("block").cast("long")), ["conv", "block"])
    shaped = joined.select("conv", "block", "letters", "ends", (F.col("block") == F.col("n") - 1).alias("last"))
    ranked = stored(shaped.mapInArrow(rank, "conv string, block long, cost long, exits array<int>, pieces array<string>"), "turn-pieces")
    exits = F.transform(F.array_sort(F.collect_list(F.struct("block", "exits"))), lambda b: b["exits"])
    entries = ranked.groupBy("conv").agg(exits.alias("exits")).select(
        "conv",
        F.posexplode(F.aggregate("exits", F.array(F.lit(START)), lambda a, e: F.concat(a, F.array(F.element_at(e, F.element_at(a, -1) + 1))))).alias("block", "entry"),
    )
    chosen = ranked.join(entries.withColumn("block", F.col("block").cast("long")), ["conv", "block"]).select(
        "conv", "block", "cost", F.element_at("pieces", F.col("entry") + 1).alias("piece")
    )
    pieces = stored(chosen.join(blocks.select("conv", "block", "first.*"), ["conv", "block"]), "turn-audits")
    whole = pieces.groupBy("conv").agg(
        F.min(F.when(F.col("block") == 0, F.col("cost"))).alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda b: b["piece"]), "").alias("audit"),
    )
    return faults.join(chained.select("conv", "illegal"), "conv").join(whole, "conv"), pieces.drop("cost")


def apply_audit(letters: Iterator[str], rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired rows."""
    state = START
    for letter in letters:
        if letter == "I":
            state = NEXT[state]
            yield ("user" if state == USER else "assistant"), ""
            continue
        role, text = next(rows)
        if letter == "R":
            state = NEXT[state]
            yield ("user" if state == USER else "assistant"), text
        elif letter == "K":
            state = INITIALS.index(role[0]) + 1
            yield role, text


def repaired(turns: DataFrame, pieces: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) per conversation with rows: the SHA-256 of its repaired ``role:text``, joined by line feeds."""

    def run(batches):
        import pyarrow as pa

        out = []
        for conv, sha in _hashes(batches):
            out.append((conv, sha))
            if len(out) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], ["conv", "repaired_sha256"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], ["conv", "repaired_sha256"])

    spaced = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = turns.select(_conversation().alias("conv"), "turn", spaced("role").alias("role"), F.sha2(spaced("text"), 256).alias("digest"),
                        F.lit(None).cast("long").alias("block"), spaced("text").alias("text"), F.lit(False).alias("is_piece"))
    parts = pieces.select("conv", "turn", "role", "digest", "block", F.col("piece").alias("text"), F.lit(True).alias("is_piece"))
    ordered = rows.unionByName(parts).repartition("conv").sortWithinPartitions("conv", "turn", "role", "digest", F.asc_nulls_last("block"))
    return ordered.select("conv", "is_piece", "role", "text").mapInArrow(run, "conv string, repaired_sha256 string")


def _hashes(batches) -> Iterator[tuple[str, str]]:
    """One SHA-256 per run of rows; a piece of the audit comes before the row that it starts at, or earlier."""
    from itertools import groupby

    stream = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    for conv, members in groupby(stream, key=lambda r: r[0]):
        pieces: deque[str] = deque()
        audit = (letter for piece in iter(pieces.popleft, None) for letter in piece)
        held: deque[tuple[str, str]] = deque()

        def letters():
            for _, is_piece, role, text in members:
                if is_piece:
                    pieces.append(text)
                    continue
                held.append((role, text))
                for letter in audit:
                    yield letter
                    if letter != "I":
                        break
            pieces.append(None)
            yield from audit  # insertions behind the last row

        sha, first = hashlib.sha256(), True
        for role, text in apply_audit(letters(), iter(held.popleft, None)):
            sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
        yield conv, sha.hexdigest()


def repair(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation of
    ``turns(conv_id, turn, role, text)``.

    A row's first fault counts: blank, a duplicate of an earlier role and text, truncated.  ``gaps`` are the missing
    numbers between the least and the greatest turn, ``illegal`` the neighbours whose initials are not su, ua or au.
    Keeping costs 0, a new role 2, an insertion 2, a deletion 3, and a truncated row that stays 1 more; blank and
    duplicate rows are always deleted, rows with other initials are deleted or get a role.  Nulls count as one space, null
    turns come first, a null conv_id is a conversation; other columns are not read.
    """
    rows = rows_by_turn(turns)
    results, pieces = audits(rows, block_rows)
    seen = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = turns.groupBy("conv_id").agg(F.coalesce(seen, F.lit(0)).cast("long").alias("gaps")).withColumn("conv", _conversation())
    joined = gaps.join(results, "conv").join(repaired(turns, pieces), "conv")
    return joined.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair_damaged(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``repair`` after ``damage``, for every conversation; one that lost all rows gets zeros and empty results."""
    found = repair(damage(conversations), block_rows).withColumnRenamed("conv_id", "_conv_id")
    every = conversations.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv_id")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
