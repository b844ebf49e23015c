"""Token ids in ORC.

Spark's ORC writer does what the format offers: integer run-length encoding, stripes, row indexes every
``ROW_INDEX_STRIDE`` rows and Bloom filters on the document ids.  Rows are range-partitioned and sorted by document
id, so files and stripes cover disjoint ranges: readers take stripes in parallel, and a look-up by document id skips
files, stripes and row groups by their minimum, maximum and Bloom filter.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from mementa.llm.common import by_bytes, gather, int_rows, text_of

STRIPE_BYTES = 32 << 20
ROW_INDEX_STRIDE = 1000
BLOOM_FPP = 0.01
# Known words of one worker, in two generations of this size at most: words met again survive.
KNOWN_WORDS = 330_000
# Bytes of the texts that are encoded together, and chunks whose ids are laid out together.
TEXT_BYTES = 8 << 20
CHUNKS_AT_ONCE = 500_000
# White space that the tokenizer drops; Python also splits at separators that are words to the tokenizer.
_SPLIT = re.compile(r"[ \t\n\r]+").split
_SEPARATORS = re.compile(r"[\x1c-\x1f]").search
# White space beyond that of ASCII, for Arrow.
_OTHER_SPACE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# A chunk of Latin letters, then marks, is two words to the tokenizer at most; any other chunk gives two empty parts.
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_PARTS = re.compile(rf"^(?:([{_LATIN}]*)([!-&(-/:-@\[-`{{-~]*)|.*)$", re.MULTILINE).findall
_WORDS_AT_ONCE = 500
# Bytes: ASCII letters, capitals and marks, and the second bytes of the letters À to ÿ, whose first byte is 0xC3.
_CODES = np.arange(256)
_LETTER = np.isin(_CODES, np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))
_CAPITAL = (_CODES >= 65) & (_CODES <= 90)
_MARK = (_CODES > 32) & (_CODES < 127) & ~_LETTER & ~((_CODES >= 48) & (_CODES <= 57))
_ACCENTED = (_CODES >= 0x80) & (_CODES < 0xC0) & (_CODES != 0x97) & (_CODES != 0xB7)


class ChunkEncoder:
    """The library's ids of whole texts, with ids of words kept in bounded tables.

    The tokenizer drops white space before its merges, so a text's ids are those of its chunks.  Chunks of letters and
    marks are cut into their words here, and the library's model gets the words that are new; the library as a whole,
    with its costly normalisation, gets only the chunks of another form.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = Tokenizer(self.library.model)
        accented = map(chr, range(0xC0, 0x100))
        self.letters = str.maketrans({c: self.library.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in accented})
        # the last id of a word is told by the model's suffix; without one, the library gets every word by itself
        suffix, vocabulary = self.library.model.end_of_word_suffix, self.library.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.special = [token.content for token in self.library.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _words(self, words: list[str]) -> None:
        """Add the model's ids of lower-case words to the known ones."""
        for start in range(0, len(words), _WORDS_AT_ONCE):
            some = words[start : start + _WORDS_AT_ONCE]
            names = [w if w.isascii() else w.translate(self.letters) for w in some]
            ids = np.array(self.model.encode_batch_fast([names], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):
                self._others(some)
                continue
            data, begin = ids.tobytes(), 0
            for word, end in zip(some, (4 * ends).tolist()):
                self.known[word] = data[begin:end]
                begin = end

    def _others(self, chunks: list[str]) -> None:
        for chunk in chunks:
            ids = self.library.encode(chunk, add_special_tokens=False).ids
            self.known[chunk] = np.array(ids, "<u4").tobytes()

    def _pieces(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks; they are looked up, and the words of new ones learnt."""
        if len(self.known) > KNOWN_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        known[""] = b""
        missing = [c for c in chunks if c not in known]
        known.update([(c, older[c]) for c in missing if c in older])
        missing = [c for c in missing if c not in known]
        # a chunk of another form has two empty parts; an empty part has no ids
        heads, tails = map(list, zip(*_PARTS("\n".join(missing)))) if missing else ([], [])
        heads = "\n".join(heads).lower().split("\n")
        words = set(heads).union(tails) - known.keys()
        met = words & older.keys()
        known.update(zip(met, map(older.__getitem__, met)))
        self._words(list(words - met))
        self._others([c for c, a, b in zip(missing, heads, tails) if not a and not b])
        known.update([(c, known[a] + known[b]) for c, a, b in zip(missing, heads, tails) if c != a and c != b and (a or b)])
        return list(map(known.__getitem__, chunks))

    def _parted(self, texts):
        """The texts with fewer distinct chunks and the same ids: small letters, and a space between a letter and a mark.

        The tokenizer lower-cases, and cuts between a letter and a following mark, anyway.  Left as they are: texts that
        hold a special token in any case, and capitals before other than ASCII, which may be a combining accent.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        raw = texts.cast(pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if len(data) < 3:
            return texts
        free = np.ones(len(raw), bool)
        for token in self.special:
            free &= ~pc.match_substring(texts, token, ignore_case=True).to_numpy(zero_copy_only=False)
        capital = _CAPITAL[data]
        capital[:-1] &= data[1:] < 0x80
        before = _LETTER[data]
        before[1:] |= _ACCENTED[data[1:]] & (data[:-1] == 0xC3)
        cut = _MARK[data]
        cut[0] = False
        cut[1:] &= before[:-1]
        if not free.all():
            inside = np.repeat(free, np.diff(offsets))
            capital &= inside
            cut &= inside
        at = np.flatnonzero(cut)
        spaced = np.insert(data + 32 * capital.view(np.uint8), at, 32)
        moved = offsets + np.searchsorted(at, offsets)
        return pa.LargeStringArray.from_buffers(len(raw), pa.py_buffer(moved), pa.py_buffer(spaced))

    def encode(self, texts, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of an Arrow array of texts, each followed by the id ``end``.

        Arrow cuts the texts and numbers the distinct chunks, Python learns the new ones, and numpy lays their ids out.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        odd = pc.match_substring_regex(texts, _OTHER_SPACE)
        if pc.any(odd).as_py():
            plain = [" ".join(_SPLIT(t) if _SEPARATORS(t) else t.split()) if o else t for t, o in zip(texts.to_pylist(), odd.to_pylist())]
            texts = pa.array(plain, pa.string())
        lists = pc.ascii_split_whitespace(self._parted(texts))
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        numbered = lists.flatten().dictionary_encode()
        pieces = self._pieces(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
        starts = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4, out=starts[1:])
        picks = numbered.indices.to_numpy()
        pool = np.frombuffer(b"".join(pieces), "<i4")
        parts = [gather(pool, starts, picks[k : k + CHUNKS_AT_ONCE]) for k in range(0, len(picks), CHUNKS_AT_ONCE)]
        ids = np.concatenate([pool[:0], *parts])
        offsets = np.concatenate([[0], np.cumsum(np.diff(starts)[picks])])[bounds]
        if end is not None:
            ids = np.insert(ids, offsets[1:], end)
            offsets = offsets + np.arange(len(offsets))
        return offsets, ids

    def batch(self, texts: list[str]) -> list[bytes]:
        import pyarrow as pa

        offsets, ids = self.encode(pa.array(texts, pa.string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(offsets, offsets[1:])]


@lru_cache(maxsize=1)
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encode every text, append ``end_id`` and write ORC in ascending ``key`` order.

    Columns: key, part (number of the range), skipped (ids before the row in its range), n_ids, ids array<int>.  Null and
    empty texts consist of the end id, null keys come first, rows with equal keys lie next to each other in no
    defined order, other columns are not read.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, part, skipped = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        # many texts together hold a word once, so the session's bound of batches does not count here
        for some in by_bytes(batches, 1, TEXT_BYTES):
            offsets, ids = encoder.encode(some.column(1), end_id)
            counts = np.diff(offsets)
            before = skipped + offsets[:-1]
            skipped += int(offsets[-1])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [some.column(0), pa.array([part] * some.num_rows, pa.int32()), pa.array(before, pa.int64()), pa.array(counts, pa.int64()), lists],
                ["key", "part", "skipped", "n_ids", "ids"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key")
    encoded = ordered.mapInArrow(run, f"key {kind}, part int, skipped long, n_ids long, ids array<int>")
    (
        encoded.withColumnRenamed("key", key).write.format("orc")
        .option("compression", "zstd")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", ROW_INDEX_STRIDE)
        .option("orc.bloom.filter.columns", key)
        .option("orc.bloom.filter.fpp", BLOOM_FPP)
        .save(folder)
    )


def read(spark: SparkSession, folder: str, wanted: list[int] | None = None, key: str = "doc_id") -> DataFrame:
    """The stored rows; with ``wanted``, those documents only, pruned by the files' metadata."""
    rows = spark.read.orc(folder)
    return rows if wanted is None else rows.filter(F.col(key).isin(wanted))


def positions(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) from stored rows: where a document's ids lie in the whole sequence.

    One row per range is summed up first; there are as many ranges as shuffle partitions, which bounds the broadcast.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = list(int_rows(batch.column(3)))
            crc = [zlib.crc32(np.ascontiguousarray(r, "<u4")) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([len(r) for r in rows], pa.int64()), pa.array(crc, pa.int64())],
                ["key", "part", "skipped", "n_tokens", "ids_crc32"],
            )

    kind = stored.schema[key].dataType.simpleString()
    ends = stored.groupBy("part").agg(F.max(F.col("skipped") + F.col("n_ids")).alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("first"))
    rows = stored.select(F.col(key).alias("key"), "part", "skipped", "ids")
    counted = rows.mapInArrow(run, f"key {kind}, part int, skipped long, n_tokens long, ids_crc32 long")
    return counted.join(F.broadcast(starts), "part").select(
        F.col("key").alias(key), (F.col("first") + F.col("skipped")).alias("start"), "n_tokens", "ids_crc32"
    )
