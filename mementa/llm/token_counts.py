"""Token counts through a digest cache.

The cache holds (version, digest, n_tokens).  ``version`` is a digest of the tokenizer file, its library and the
options; ``digest`` is the SHA-256 of a text's normalised content, where null is empty: the tokenizer sees every other
difference, so nothing more may be folded.

1. Documents are reduced to (key, digest, bytes), their digests to one row each, all in narrow rows.
2. Digests without a stored count under this version are the misses.  Each brings one document that has its text;
   texts meet the misses by key *and* digest, so the copies of a hot text spread over all tasks, and when the misses
   are few they are broadcast and no text is shuffled.
3. The texts found are encoded and their counts appended to the cache.
4. Documents get their counts from the cache in a join that salts hot digests.

Appends go through Spark's committer, so a lost task or job leaves no half rows.  Two writers may store the same
digest twice; readers take one.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mementa.llm.common import stored, text_of
from mementa.operators.common import lookup_join

CACHE = "digest binary, n_tokens long, version string"
# Up to so many misses (about 50 bytes each) are broadcast; more meet the texts in a shuffle.
BROADCAST_MISSES = 5_000
# Known pieces of one worker, in two generations of this size at most; longer pieces are not kept.
KNOWN_PIECES = 400_000
PIECE_CHARS = 64
# Code points of the texts that are cut and counted together.
BLOCK_CHARS = 1 << 20
# A single space between other characters.  Python's white space holds that of every tokenizer pattern.
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
_UNEVEN = re.compile(r"\s | \s|^ | $")


def version(tokenizer: str) -> str:
    """What a stored count depends on beside the text."""
    import sentencepiece
    import tokenizers

    with open(tokenizer, "rb") as file:
        content = hashlib.sha256(file.read()).hexdigest()
    library = f"sentencepiece {sentencepiece.__version__}" if tokenizer.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    return hashlib.sha256(f"{library}\n{content}\nno begin, end or added special tokens\n".encode()).hexdigest()


class Pieces:
    """Counts of the tokenizers library.

    Byte-level BPE without a prefix space and without a normaliser never joins two tokens over a single space between
    other characters: the space opens the next token.  A text's count is then the sum over its pieces, and the library
    counts each new piece once.  Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        parts = json.loads(self.library.to_str())
        cut = parts["pre_tokenizer"] or {}
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])) for t in parts["added_tokens"])
        byte_level = cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]
        self.additive = byte_level and plain and parts["normalizer"] is None
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def _count(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: set[str]) -> dict[str, int]:
        """Count the new pieces, each behind its space; the counts of long ones are handed back."""
        if len(self.known) > KNOWN_PIECES:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = pieces - known.keys()
        met = new & older.keys()
        known.update(zip(met, map(older.__getitem__, met)))
        new = list(new - met)
        rare = {}
        for start in range(0, len(new), 5000):
            for piece, n in zip(new[start : start + 5000], self._count([" " + p for p in new[start : start + 5000]])):
                (known if len(piece) <= PIECE_CHARS else rare)[piece] = n
        return rare

    def count(self, texts: list[str]) -> list[int]:
        if not self.additive:
            return self._count(texts)
        cut = [_SINGLE.split(t) if _UNEVEN.search(t) else t.split(" ") for t in texts]
        rare = self._learn(set().union(*(c[1:] for c in cut)))
        known = {**self.known, **rare}.__getitem__ if rare else self.known.__getitem__
        return [n + sum(map(known, c[1:])) for n, c in zip(self._count([c[0] for c in cut]), cut)]


class Sentences:
    """Counts of the sentencepiece library."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.library.encode(texts, num_threads=1)]


@lru_cache(maxsize=1)
def _counter(path: str):
    return Sentences(path) if path.endswith(".model") else Pieces(path)


def content_digest(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def read_cache(spark: SparkSession, folder: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version; other versions' files are not read.  No folder: no rows."""
    try:
        rows = spark.read.schema(CACHE).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE)
    return rows.filter(F.col("version") == version(tokenizer)).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode_misses(docs: DataFrame, misses: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(digest, n_tokens) of ``misses(digest, key)``, whose texts ``docs`` holds."""

    def run(batches):
        import pyarrow as pa

        counter = _counter(tokenizer)
        for batch in batches:
            texts, counts, start = batch.column(1).to_pylist(), [], 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop]) <= BLOCK_CHARS):
                    size += len(texts[stop])
                    stop += 1
                counts += counter.count(texts[start:stop])
                start = stop
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    texts = docs.select(F.col(key).alias("_key"), text_of(text).alias("text")).withColumn("digest", content_digest(F.col("text")))
    wanted = misses.select(F.col("digest").alias("_digest"), F.col("key").alias("_wanted"))
    few = misses.limit(BROADCAST_MISSES + 1).count() <= BROADCAST_MISSES
    wanted = F.broadcast(wanted) if few else wanted.hint("shuffle_hash")
    found = texts.join(wanted, (F.col("digest") == F.col("_digest")) & F.col("_key").eqNullSafe(F.col("_wanted")))
    counted = found.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")
    # rows that repeat key and text were counted once each
    return counted.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str, tokenizer: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) per row of ``docs``; new counts are appended to the folder ``cache``.

    ``tokenizer`` is a file that driver and executors have: .json for tokenizers, .model for sentencepiece.  Counts are
    those of the library without begin, end or added special tokens; special strings inside texts count as it
    takes them.  Null and empty texts have 0 bytes and 0 tokens, repeated rows and null keys stay, other columns
    are not read.
    """
    spark = docs.sparkSession
    content = text_of(text)
    named = stored(docs.select(F.col(key).alias("key"), content_digest(content).alias("digest"), F.octet_length(content).cast("long").alias("n_bytes")), "digests")
    groups = stored(named.groupBy("digest").agg(F.min("key").alias("key"), F.count("*").alias("rows")), "distinct-digests")
    misses = stored(groups.join(read_cache(spark, cache, tokenizer), "digest", "left_anti").select("digest", "key"), "cache-misses")
    new = encode_misses(docs, misses, tokenizer, key, text)
    new.withColumn("version", F.lit(version(tokenizer))).write.partitionBy("version").mode("append").parquet(cache)
    counts = groups.join(read_cache(spark, cache, tokenizer), "digest").select("digest", "rows", "n_tokens")
    counted = lookup_join(named, counts, "digest", "rows")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
