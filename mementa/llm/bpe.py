"""Byte-level BPE by corpus-level merge replay.

A block of documents is cut into pre-tokens.  The distinct new pre-tokens of the block are laid out behind each
other as byte tokens, with an inverted index from token pair to positions.  Merges are replayed in rank order over
the whole block: a merge visits just the positions of its pair and updates only their two neighbours.

Blocks are independent, so there is no shuffle and a lost task is simply repeated.  Each worker keeps the ids of
pre-tokens it has met, in tables of bounded size.
"""

from __future__ import annotations

import base64
import re
from functools import cached_property, lru_cache
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame, functions as F

from mementa.llm.common import gather, int_lists, int_rows, text_of

# Known words of one worker, in two generations of this size at most: words met again survive.
KNOWN_WORDS = 220_000
# Known pieces of one worker, in two generations of this size at most, too.
KNOWN_PIECES = 130_000
# Code points of the documents that are replayed together.
BLOCK_CHARS = 3 << 20
# A merge with so many positions is applied to all of them at once.
TOGETHER = 150
# Spaces beside other white space: such a text is cut by the pattern alone.
_UNEVEN = re.compile(r" \s|\s ")


class Merges:
    """A rank file: ids by token bytes, merges by pair, bytes by id."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = dict(zip(self.ranks.values(), self.ranks))
        size = max(self.tokens) + 1
        self.pool, self.offsets = _flat(self.tokens.get(i, b"") for i in range(size))
        self.decimals, self.decimal_offsets = _flat(b"%d," % i for i in range(size))

    @cached_property
    def pairs(self) -> dict[int, int]:
        """The id that two neighbours merge into, by ``left << 32 | right``."""
        found = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        return found

    @cached_property
    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array(sorted(self.pairs))
        return keys, np.array([self.pairs[k] for k in keys.tolist()], np.int32)

    @cached_property
    def _bytes(self) -> np.ndarray:
        return np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)

    @cached_property
    def _byte_pairs(self) -> np.ndarray:
        """The merges of two bytes, by 256 times the first plus the second; -1 where there is none."""
        return np.array([self.ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int32)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids that neighbours merge into, or -1; marks below zero merge with nothing."""
        keys, ids = self._table
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where((keys[at] == wanted) & (left >= 0) & (right >= 0), ids[at], -1)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Little-endian ids of every word.  A word that is a token as a whole is that token."""
        whole = [self.ranks.get(w) for w in words]
        rest = [w for w, known in zip(words, whole) if known is None]
        ends = np.concatenate([[0], np.cumsum([len(w) + 1 for w in rest], dtype=np.int64)])
        replayed = iter(_Replay(self, np.frombuffer(b"".join(rest), np.uint8), ends).run())
        return [next(replayed) if known is None else known.to_bytes(4, "little") for known in whole]


class _Replay:
    """Words laid out behind each other as byte tokens; position 0 and the end of each word hold a mark of -1, over
    which nothing merges, and the second token of a merge leaves a mark of -2.

    ``pair`` holds the id that a position's token and the next one merge into, ``index`` the positions of each such
    id.  Merges with many positions are applied together, the others one by one on the same memory.
    """

    def __init__(self, merges: Merges, data: np.ndarray, ends: np.ndarray):
        size = int(ends[-1]) + 1
        inside = np.ones(size, bool)
        inside[ends] = False
        self.merges, self.ends = merges, ends
        self.token = np.full(size, -1, np.int32)
        self.token[inside] = merges._bytes[data]
        self.after = np.arange(1, size + 1, dtype=np.int32)
        self.before = np.arange(-1, size - 1, dtype=np.int32)
        plain = np.zeros(size, np.int32)
        plain[inside] = data
        self.pair = np.full(size, -1, np.int32)
        both = np.flatnonzero(inside[:-1] & inside[1:])
        self.pair[both] = merges._byte_pairs[256 * plain[both] + plain[both + 1]]
        self.index: dict[int, list[int]] = {}
        self.queue: list[int] = []
        known = np.flatnonzero(self.pair >= 0)
        self._add(self.pair[known], known)

    def _add(self, ranks: np.ndarray, places: np.ndarray) -> None:
        """Put the places of many pairs into the index."""
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        starts = np.flatnonzero(np.diff(ranks, prepend=-1))
        stops = np.append(starts[1:], len(ranks)).tolist()
        places = places.tolist()
        for rank, start, stop in zip(ranks[starts].tolist(), starts.tolist(), stops):
            if rank in self.index:
                self.index[rank] += places[start:stop]
            else:
                self.index[rank] = places[start:stop]
                heappush(self.queue, rank)

    def run(self) -> list[bytes]:
        while self.queue:
            rank = heappop(self.queue)
            places = self.index.pop(rank)
            if len(places) < TOGETHER or not self._together(rank, np.array(places)):
                self._one_by_one(rank, sorted(places))
        tokens = self.token >= 0
        data = self.token[tokens].astype("<u4").tobytes()
        begins = (4 * np.cumsum(tokens)[self.ends]).tolist()
        return [data[a:b] for a, b in zip(begins, begins[1:])]

    def _together(self, rank: int, places: np.ndarray) -> bool:
        """Apply a merge everywhere, unless places overlap or a pair comes up that is due before the others."""
        token, after, before, pair = self.token, self.after, self.before, self.pair
        places = np.sort(places[pair[places] == rank])  # a neighbour of the others has merged meanwhile
        places = places[np.diff(places, prepend=-1) > 0]
        second = after[places]
        following, left = after[second], before[places]
        behind = self.merges.merged(np.full(len(places), rank), token[following])
        front = self.merges.merged(token[left], np.full(len(places), rank))
        side_by_side = following[:-1] == places[1:]
        doubled = self.merges.pairs.get(rank << 32 | rank, -1)
        early = ((behind >= 0) & (behind <= rank)).any() or ((front >= 0) & (front <= rank)).any()
        if early or (second[:-1] == places[1:]).any() or (side_by_side.any() and 0 <= doubled <= rank):
            return False
        token[places], token[second], pair[second] = rank, -2, -1
        after[places], before[following] = following, places
        behind[:-1][side_by_side], front[1:][side_by_side] = doubled, doubled
        left = before[places]
        pair[left], pair[places] = front, behind
        front[1:][side_by_side] = -1  # the same pair as the one behind its neighbour
        self._add(np.concatenate([behind[behind >= 0], front[front >= 0]]), np.concatenate([places[behind >= 0], left[front >= 0]]))
        return True

    def _one_by_one(self, rank: int, places: list[int]) -> None:
        token, after, before, pair = map(memoryview, (self.token, self.after, self.before, self.pair))
        pairs, index, queue = self.merges.pairs, self.index, self.queue
        for k, i in enumerate(places):
            if pair[i] != rank:
                continue
            j = after[i]
            following, left = after[j], before[i]
            token[i], token[j], pair[j], after[i], before[following] = rank, -2, -1, following, i
            front = behind = -1
            if token[left] >= 0:
                front = pair[left] = pairs.get(token[left] << 32 | rank, -1)
            if token[following] >= 0:
                behind = pairs.get(rank << 32 | token[following], -1)
            pair[i] = behind
            for new, place in ((front, left), (behind, i)):
                if new >= 0:
                    if new in index:
                        index[new].append(place)
                    else:
                        index[new] = [place]
                        heappush(queue, new)
            if 0 <= front <= rank or 0 <= behind <= rank:  # the new pair comes before the rest of this one
                if rank not in index:
                    index[rank] = []
                    heappush(queue, rank)
                index[rank] += places[k + 1 :]
                break


def _flat(pieces) -> tuple[np.ndarray, np.ndarray]:
    pieces = list(pieces)
    offsets = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum([len(p) for p in pieces], out=offsets[1:])
    return np.frombuffer(b"".join(pieces), np.uint8), offsets


class Encoder:
    """Texts to little-endian 32-bit ids.  Known strings are looked up, new ones are replayed block by block.

    Between single spaces the pattern never joins two pieces, so ids are kept by piece, apart for pieces with and
    without a space in front; texts with other spacing are cut by the pattern as a whole.
    """

    def __init__(self, path: str, pattern: str):
        import regex

        self.merges, self.find = Merges(path), regex.compile(pattern).findall
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.older_spaced: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}

    def block(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > KNOWN_WORDS:
            self.words, self.older = {}, self.words
        if len(self.spaced) > KNOWN_PIECES:
            self.spaced, self.older_spaced = {}, self.spaced
        if len(self.plain) > KNOWN_PIECES:
            self.plain = {}
        cut = []
        for text in texts:
            even = text and text[0] != " " and text[-1] != " " and not _UNEVEN.search(text)
            cut.append(text.split(" ") if even else None)
        firsts = {(p[0] if p else t) for p, t in zip(cut, texts)} - self.plain.keys()
        others = set().union(*(p[1:] for p in cut if p)) - self.spaced.keys()
        seen = others & self.older_spaced.keys()
        self.spaced.update(zip(seen, map(self.older_spaced.__getitem__, seen)))
        others -= seen
        # printable pieces hold no white space, so each of their first words in a row of them begins with its space
        simple = [t for t in others if t.isprintable()]
        row = self.find(" " + " ".join(simple)) if simple else []
        begins = [i for i, t in enumerate(row) if t[0] == " "]
        if len(begins) != len(simple):
            simple, row, begins = [], [], []
        new_plain = {t: self.find(t) for t in firsts}
        new_spaced = {t: self.find(" " + t) for t in (others.difference(simple) if simple else others)}
        missing = set(row).union(*new_plain.values(), *new_spaced.values()) - self.words.keys()
        met = missing & self.older.keys()
        self.words.update(zip(met, map(self.older.__getitem__, met)))
        new = list(missing - met)
        self.words.update(zip(new, self.merges.replay([w.encode() for w in new])))
        word = self.words.__getitem__
        self.plain.update((t, b"".join(map(word, w))) for t, w in new_plain.items())
        self.spaced.update((t, b"".join(map(word, w))) for t, w in new_spaced.items())
        ids = list(map(word, row))
        ends = [*begins[1:], len(row)]
        self.spaced.update((t, ids[a] if b - a == 1 else b"".join(ids[a:b])) for t, a, b in zip(simple, begins, ends))
        spaced = self.spaced.__getitem__
        out = [
            self.plain[p[0]] + b"".join(map(spaced, p[1:])) if p else self.plain[t] for p, t in zip(cut, texts)
        ]
        for text, pieces in zip(texts, cut):
            if not pieces:
                self.plain.pop(text, None)  # whole texts are no vocabulary
        return out


@lru_cache(maxsize=2)
def _merges(path: str) -> Merges:
    return Merges(path)


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) per row of ``docs``, in any order; no special tokens.

    ``ranks`` is a tiktoken rank file that every executor has, ``pattern`` cuts the pre-tokens.  Null and empty
    texts have no ids, repeated rows and null keys stay, other columns are not read.
    """

    def run(batches):
        import pyarrow as pa

        encoder = _encoder(ranks, pattern)
        for batch in batches:
            texts, chunks, start = batch.column(1).to_pylist(), [], 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop]) <= BLOCK_CHARS):
                    size += len(texts[stop])
                    stop += 1
                chunks += encoder.block(texts[start:stop])
                start = stop
            yield pa.RecordBatch.from_arrays([batch.column(0), int_lists(chunks)], ["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(encoded: DataFrame, ranks: str, key: str = "doc_id") -> DataFrame:
    """(key, data binary) per row: the bytes behind ``ids``.  Null ids give no bytes, an unknown id is an error."""

    def run(batches):
        import pyarrow as pa

        merges = _merges(ranks)
        for batch in batches:
            data = [gather(merges.pool, merges.offsets, ids).tobytes() for ids in int_rows(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["key", "data"])

    kind = encoded.schema[key].dataType.simpleString()
    rows = encoded.select(F.col(key).alias("key"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, f"key {kind}, data binary").withColumnRenamed("key", key)


def digests(encoded: DataFrame, ranks: str, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) per row of ``encode``'s result, decoding as ``decode`` does."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        merges = _merges(ranks)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for ids in int_rows(batch.column(1)):
                counts.append(len(ids))
                ids_sha.append(sha(gather(merges.decimals, merges.decimal_offsets, ids)[:-1].tobytes()))
                decoded_sha.append(sha(gather(merges.pool, merges.offsets, ids).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = encoded.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return encoded.withColumnRenamed(key, "key").mapInArrow(run, schema).withColumnRenamed("key", key)
