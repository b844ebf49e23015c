"""Benchmark decontamination with a BM25 index and block-max WAND.

The test items are indexed: per term and item the BM25 weight, divided by the item's own full score.  Items fall into
classes by length, each with passages of its own: a passage has twice as many words as the stride, and no item of the
class is longer than the stride by more than a word, so wherever an item stands some passage holds all of it and one
threshold fits items of any length.  Items form blocks, and every term keeps its maximum per block.  Every passage of
every training document is a query: the sum of its terms' list maxima, then of their block maxima, bounds what any
item can score; only blocks that may reach the threshold are scored.  Every item above the threshold is retrieved (no
top-k) and verified by five-word shingles of its question and of its answer.

The index is bounded: benchmarks above ``SHARD_CHARS`` are worked off in shards, each a stated query set against all
rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, functions as F

from mementa.llm.common import stored, text_of

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.8
SHINGLE_WORDS = 5
# of the shortest items; each class of longer ones has twice as many
STRIDE_WORDS = 32
BLOCK_ITEMS = 8
ANSWER_WORDS = 8
SHARD_CHARS = 1 << 20
_WORD = re.compile(r"\w+").findall
_SENTENCE = re.compile(r"[.!?:\n]+\s*")


def words_of(text: str) -> list[str]:
    return _WORD(text.lower())


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    """Runs of five words; fewer words are one run."""
    return {tuple(words[i : i + SHINGLE_WORDS]) for i in range(max(1, len(words) - SHINGLE_WORDS + 1))} if words else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words before and from the last sentence on; an answer has ``ANSWER_WORDS`` words at least.

    Items of fewer than twice as many words are question and answer in one.
    """
    words = words_of(text)
    if len(words) < 2 * ANSWER_WORDS:
        return words, words
    sentences = [s for s in _SENTENCE.split(text) if _WORD(s)]
    last = max(ANSWER_WORDS, len(words_of(sentences[-1])))
    last = last if last <= len(words) - ANSWER_WORDS else ANSWER_WORDS
    return words[:-last], words[-last:]


class Index:
    """Inverted index of test items ``(id, text)``."""

    def __init__(self, items: list[tuple], statistics: tuple[int, int, dict[str, int]] | None = None):
        """``statistics`` are the number of items with words, their words, and the items that hold each term, over the
        whole benchmark; without them ``items`` are the whole."""
        items = [(i, w, t) for i, t in items if (w := words_of(t or ""))]
        # rows of a block are alike in length, which keeps block maxima close to the scores
        items.sort(key=lambda x: (len(x[1]), x[1], x[0] is None, x[0]))
        self.ids = [i for i, _, _ in items]
        self.parts = [tuple(map(shingles, question_and_answer(t))) for _, _, t in items]
        self.words = [tuple(map(set, question_and_answer(t))) for _, _, t in items]
        self.whole = [shingles(w) for _, w, _ in items]
        self.longest = max((len(w) for _, w, _ in items), default=0)
        # (stride, first item, end, longest item) of the classes, shortest items first
        self.classes: list[tuple[int, int, int, int]] = []
        for k, (_, w, _) in enumerate(items):
            stride = self.stride(len(w))
            first = self.classes.pop()[1] if self.classes and self.classes[-1][0] == stride else k
            self.classes.append((stride, first, k + 1, len(w)))
        n, total, holding = statistics or (len(items), sum(len(w) for _, w, _ in items), Counter(t for _, w, _ in items for t in set(w)))
        mean = total / max(1, n)
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, (_, words, _) in enumerate(items):
            weights = {}
            for term, tf in Counter(words).items():
                idf = math.log(1 + (n - holding[term] + 0.5) / (holding[term] + 0.5))
                weights[term] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
            full = sum(weights.values())
            for term, weight in weights.items():
                postings[term].append((k, weight / full))
        self.term = {t: i for i, t in enumerate(sorted(postings))}
        lists = [postings[t] for t in sorted(postings)]
        blocks = -(-len(items) // BLOCK_ITEMS)
        self.block_maxima = np.zeros((len(lists), blocks), np.float32)
        for i, entries in enumerate(lists):
            for k, weight in entries:
                at = i, k // BLOCK_ITEMS
                self.block_maxima[at] = max(self.block_maxima[at], weight)
        self.lists = [dict(entries) for entries in lists]
        # per class, the largest weight of each term
        self.maxima = [[max((w for k, w in entries if first <= k < end), default=0.0) for entries in lists] for _, first, end, _ in self.classes]

    @staticmethod
    def stride(words: int) -> int:
        """Words from passage to passage for items of so many words."""
        stride = STRIDE_WORDS
        while words > stride + 1:
            stride *= 2
        return stride

    def retrieve(self, terms: set[int], threshold: float, of: int) -> list[tuple[int, float]]:
        """(item, score) of every item of class ``of`` that scores ``threshold`` or more for the query ``terms``."""
        slack = 1e-5
        if sum(map(self.maxima[of].__getitem__, terms)) < threshold - slack:
            return []
        picks = list(terms)
        _, first, end, _ = self.classes[of]
        blocks = first // BLOCK_ITEMS, -(-end // BLOCK_ITEMS)
        bounds = np.zeros(self.block_maxima.shape[1], np.float32)
        bounds[slice(*blocks)] = self.block_maxima[picks, slice(*blocks)].sum(axis=0)
        found = []
        for block in np.flatnonzero(bounds >= threshold - slack).tolist():
            scores: dict[int, float] = defaultdict(float)
            rest = float(bounds[block])
            ranked = sorted(picks, key=lambda t: -self.block_maxima[t, block])
            low, high = max(first, block * BLOCK_ITEMS), min(end, (block + 1) * BLOCK_ITEMS)
            for t in ranked:
                bound = float(self.block_maxima[t, block])
                if not bound or (max(scores.values(), default=0.0) + rest < threshold - slack):
                    break
                rest -= bound
                entries = self.lists[t]
                for k in range(low, high):
                    if k in entries:
                        scores[k] += entries[k]
            else:
                bound = 0.0
            if not bound:
                found += [(k, s) for k, s in scores.items() if s >= threshold]
        return found

    def matches(self, text: str, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple]:
        """(item, score, question_overlap, answer_overlap, first_word), one per item that a text contains: its best passage."""
        words = words_of(text)
        terms = list(map(self.term.get, words))
        best: dict[int, tuple] = {}
        for of, (stride, _, _, longest) in enumerate(self.classes):
            passage = 2 * stride
            for start in range(0, max(1, len(words) - passage + stride), stride):
                query = set(terms[start : start + passage])
                query.discard(None)
                found = self.retrieve(query, threshold, of)
                if not found:
                    continue
                # an edited item may begin before the passage or end behind it
                around = words[max(0, start - longest) : start + passage + longest]
                here = shingles(around) if len(around) >= SHINGLE_WORDS else set()
                for k, score in found:
                    question, answer = (self._overlap(p, here, around) for p in self.parts[k])
                    contained = (question >= overlap and answer >= overlap) or self._edited(k, here, around, overlap)
                    if contained and (k not in best or (score, -start) > (best[k][0], -best[k][3])):
                        best[k] = (score, question, answer, start)
        return [(self.ids[k], *v) for k, v in sorted(best.items())]

    def _edited(self, k: int, here: set, around: list[str], overlap: float) -> bool:
        """Whether an item with an edited word is there: one word can cost a short answer all of its shingles, so the
        whole item must share the shingles, and question and answer half of their words."""
        there = set(around)
        if any(2 * len(part & there) < len(part) for part in self.words[k]):
            return False
        return self._overlap(self.whole[k], here, around) >= overlap

    @staticmethod
    def _overlap(part: set, here: set, around: list[str]) -> float:
        short = {s for s in part if len(s) < SHINGLE_WORDS}
        if short:
            here = {tuple(around[i : i + len(s)]) for s in short for i in range(len(around) - len(s) + 1)}
        return len(part & here) / len(part)


def term_counts(items: DataFrame, text: str = "text") -> DataFrame:
    """(term, items, words): the items that hold each term; the empty term stands for all items and their words."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            holding, n, total = Counter(), 0, 0
            for t in batch.column(0).to_pylist():
                words = words_of(t)
                holding.update(set(words))
                n, total = n + bool(words), total + len(words)
            terms = ["", *holding]
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array([n, *holding.values()], pa.int64()), pa.array([total] + [0] * len(holding), pa.int64())], ["term", "items", "words"])

    counted = items.select(text_of(text)).mapInArrow(run, "term string, items long, words long")
    return counted.groupBy("term").agg(F.sum("items").alias("items"), F.sum("words").alias("words"))


def shards(items: DataFrame, key: str = "item_id", text: str = "text", chars: int = SHARD_CHARS):
    """Indexes over parts of ``items`` of about ``chars`` code points each, one at a time.

    Term counts, number of items and mean length are those of all items, so scores do not depend on the parts; a part
    collects the counts of its own terms only.
    """
    total = items.agg(F.sum(F.length(text))).first()[0] or 0
    n = total // chars + 1
    if n == 1:
        yield Index([(r[0], r[1]) for r in items.select(key, text).collect()])
        return
    counts = stored(term_counts(items, text), "benchmark-terms")
    for shard in range(n):
        some = items.filter(F.pmod(F.xxhash64(key, text), F.lit(n)) == shard)
        mine = counts.join(term_counts(some, text).select("term"), "term", "left_semi").collect()
        whole = counts.filter("term = ''").first()
        statistics = whole["items"], whole["words"], {r["term"]: r["items"] for r in mine}
        yield Index([(r[0], r[1]) for r in some.select(key, text).collect()], statistics)


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
               item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(key, item_id, score, question_overlap, answer_overlap, first_word) per document and test item it contains.

    Null and empty texts, of documents or of items, match nothing; repeated documents and items are reported each;
    null keys stay; other columns are not read.
    """
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"key {kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double, first_word long"
    rows, out = docs.select(F.col(key).alias("key"), text_of(text).alias("text")), None

    def finder(held):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                at, found = [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    more = held.value.matches(t, threshold, overlap)
                    at += [i] * len(more)
                    found += more
                if found:
                    names = ["item_id", "score", "question_overlap", "answer_overlap", "first_word"]
                    columns = [pa.array(c) for c in zip(*found)]
                    columns[4] = columns[4].cast(pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], ["key", *names])

        return run

    for index, more in _with_more(shards(items, item_key, item_text)):
        held = docs.sparkSession.sparkContext.broadcast(index)
        part = rows.mapInArrow(finder(held), schema)
        if more or out is not None:  # several indexes: each is done with before the next one is sent
            part = stored(part, "leaks")
            held.destroy()
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("key", key)


def _with_more(values):
    """Each value with whether another one follows."""
    values = iter(values)
    value = next(values)
    for following in values:
        yield value, True
        value = following
    yield value, False


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
               threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs`` that contain no test item, all columns as they are."""
    at = docs.columns.index(text)

    def filtering(held):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                clean = [not held.value.matches(t or "", threshold, overlap) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    several = False
    for index, more in _with_more(shards(items, item_key, item_text)):
        held, several = docs.sparkSession.sparkContext.broadcast(index), several or more
        docs = docs.mapInArrow(filtering(held), docs.schema)
        if several:
            docs = stored(docs, "clean")
            held.destroy()
    return docs
