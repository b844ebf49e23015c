"""One query per operator, over whole tables with production parameters, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from mementa.llm import (
    bpe, chat, decontaminate, exact_dedup, line_dedup, merkle, secrets, simhash, token_counts, token_orc, toxicity,
    turn_repair, warc,
)
from mementa.llm.common import stored, table
from mementa.session import scratch_folder, tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(tune(spark), sf_dir)

    QUERIES[function.__name__] = run
    return function


@query
def op1_line_dedup(s, d):
    """Every document with its text after the deletion of later repeated runs."""
    docs = table(s, d, "documents")
    return line_dedup.deduplicate_lines(docs, extend=True).select("doc_id", "text")


@query
def op2_warc(s, d):
    folder = scratch_folder(s, "warc")
    archives = warc.write(table(s, d, "pages"), folder)
    return warc.read(s, archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op3_toxicity(s, d):
    docs = table(s, d, "documents")
    model = toxicity.fit(docs, toxicity.grades(table(s, d, "labels")))
    return toxicity.score(docs, model)


@query
def op4_chat_format(s, d):
    turns = table(s, d, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = s.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(text).alias("text"),
    )
    log = chat.as_log(turns.unionByName(extra))
    return chat.read_back(stored(chat.render(chat.messages(log)), "chat-formatted"))


@query
def op5_exact_dedup(s, d):
    return exact_dedup.deduplicate(table(s, d, "documents"))


@query
def op6_secret_scan(s, d):
    return secrets.digest(secrets.find_secrets(table(s, d, "documents")))


@query
def op7_token_orc(s, d):
    folder = scratch_folder(s, "tokens-orc")
    token_orc.write(table(s, d, "documents"), folder, WORD_TOKENIZER, end_id=2)
    return token_orc.positions(token_orc.read(s, folder))


@query
def op8_decontaminate(s, d):
    return decontaminate.find_leaks(table(s, d, "documents"), table(s, d, "benchmark"))


@query
def op9_byte_bpe(s, d):
    encoded = bpe.encode(table(s, d, "documents"), RANKS, public_tokenizers.PATTERN)
    return bpe.digests(encoded, RANKS)


@query
def op10_simhash(s, d):
    return simhash.near_duplicates(table(s, d, "documents"))


@query
def op11_token_counts(s, d):
    """Counts of all documents, from a cache that starts empty: every distinct text is a miss once."""
    return token_counts.count_tokens(table(s, d, "documents"), scratch_folder(s, "token-counts"), BYTE_TOKENIZER)


@query
def op12_merkle_manifest(s, d):
    return merkle.audit(table(s, d, "documents"))


@query
def op13_turn_repair(s, d):
    return turn_repair.repair_damaged(table(s, d, "conversations"))


ORACLES = {
    "op5_exact_dedup": """
        WITH named AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM named WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op2_warc": """
        WITH named AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
            FROM pages
        ), marked AS (
            SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS newest
            FROM named
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN newest IS NOT NULL AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> newest THEN newest END AS refers_to
        FROM marked
    """,
}
