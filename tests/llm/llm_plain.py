"""Plain Python forms of the pipeline's decisions."""

import base64
from collections import Counter
from functools import lru_cache

import public_tokenizers
import test_operators as plain


def line_dedup(spark, rows):
    """With matches extended, as the pipeline does."""
    plain.remember_order(spark, rows)
    return plain.plain_extended(rows, 50)


def components(rows):
    prints = [(i, plain.plain_fingerprint(t or "")) for i, t in rows]
    named = {(i, fp): c for (i, fp, c) in plain.plain_components(prints)}
    return [named[i, f"{fp:016x}"] for i, fp in prints]


def leaks(rows, items) -> Counter:
    return plain.plain_leaks(rows, items)


@lru_cache
def _encoding():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe_ids(text):
    return _encoding().encode_ordinary(text or "")
