"""Token counts, the Merkle manifest and conversation repair against plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from mementa.llm import merkle, token_counts, turn_repair
from mementa.llm.common import placed
from mementa.llm.queries import BYTE_TOKENIZER, QUERIES


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def counted(frame):
    return Counter(tuple(r) for r in frame.collect())


def test_placed(spark):
    rng = random.Random(3)
    data = [(rng.choice(["", "a", "b", "b", "b", "b"]), rng.choice([None, *range(9)]), i) for i in range(3000)]
    found, sizes = placed(spark.createDataFrame(data, "g string, x long, i long").repartition(5), "g", ["x"], "placed-test")
    order = lambda r: (r[1] is not None, r[1] or 0)
    for group in ("", "a", "b"):
        mine = [r for r in data if r[0] == group]
        rows = sorted((r for r in found.collect() if r["g"] == group), key=lambda r: r["position"])
        assert [r["position"] for r in rows] == list(range(len(mine)))
        assert [r["x"] for r in rows] == [r[1] for r in sorted(mine, key=order)]
    assert {r["g"]: r["n"] for r in sizes.collect()} == Counter(r[0] for r in data)


# ---------------------------------------------------------------- token counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTE_TOKENIZER)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def plain_counts(docs, count, limit=1024):
    return Counter((i, len((t or "").encode()), n := count(t), n > limit) for i, t in docs)


def test_counts_documents(spark, sf, documents, library):
    assert counted(QUERIES["op11_token_counts"](spark, sf)) == plain_counts(documents, library)


def test_counts_edges(spark, odd_docs, odd_texts, no_docs, library, tmp_path):
    found = token_counts.count_tokens(odd_docs, str(tmp_path / "a"), BYTE_TOKENIZER, limit=3)
    assert counted(found) == plain_counts(odd_texts, library, 3)
    assert token_counts.count_tokens(no_docs, str(tmp_path / "b"), BYTE_TOKENIZER).count() == 0


@pytest.mark.parametrize("few", [0, 5_000])
def test_counts_cache(spark, tmp_path, monkeypatch, library, few):
    """Stored counts are taken as they are, misses are encoded once and appended, versions are kept apart."""
    monkeypatch.setattr(token_counts, "BROADCAST_MISSES", few)
    cache, encoded = str(tmp_path / "cache"), []
    kept = token_counts.encode_misses
    monkeypatch.setattr(token_counts, "encode_misses", lambda d, m, *a: encoded.append(m.count()) or kept(d, m, *a))
    first = spark.createDataFrame([(1, "one two"), (2, "three"), (3, "one two")], "doc_id long, text string")
    more = first.unionByName(spark.createDataFrame([(4, "three"), (5, "new"), (None, None), (None, "new")], "doc_id long, text string"))
    token_counts.count_tokens(first, cache, BYTE_TOKENIZER)
    assert counted(token_counts.count_tokens(more, cache, BYTE_TOKENIZER)) == plain_counts([tuple(r) for r in more.collect()], library)
    token_counts.count_tokens(more, cache, BYTE_TOKENIZER)
    assert encoded == [2, 2, 0]
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest", "version").distinct().count() == 4
    wrong = stored.select("digest", F.lit(77).cast("long").alias("n_tokens"), "version")
    other = str(tmp_path / "other")
    wrong.write.partitionBy("version").parquet(other)
    assert {r["n_tokens"] for r in token_counts.count_tokens(more, other, BYTE_TOKENIZER).collect()} == {77}
    words = public_tokenizers.path("word_bpe_49k.json")
    token_counts.count_tokens(first, other, words)
    assert encoded == [2, 2, 0, 0, 2] and spark.read.parquet(other).select("version").distinct().count() == 2


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_libraries(documents, name):
    path = public_tokenizers.path(name)
    texts = ["", " ", "a <|endoftext|> b<|endoftext|>", "x  y", " a b ", "a\x1c b", "a \x85b", "né 🙂 ſ", "<s> hi </s>", *[t or "" for _, t in documents[:60]]]
    if name.endswith("model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        expected = [len(processor.encode(t)) for t in texts]
    else:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        expected = [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert token_counts._counter(path).count(texts) == expected


ODD = st.lists(st.sampled_from([" ", "  ", "a", "Bc", "é", "中", "'s", "12", "!?", "\n", "\t", "\x1c", "\x85", " ", "\xa0", "<|endoftext|>", "🙂"]), max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD.map("".join), max_size=6))
def test_counts_pieces(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTE_TOKENIZER)
    assert _PIECES.count(texts) == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


_PIECES = token_counts.Pieces(BYTE_TOKENIZER)


def test_counts_memory(monkeypatch, documents):
    monkeypatch.setattr(token_counts, "KNOWN_PIECES", 50)
    pieces, fresh = token_counts.Pieces(BYTE_TOKENIZER), token_counts.Pieces(BYTE_TOKENIZER)
    texts = [t or "" for _, t in documents[:80]]
    assert [pieces.count([t])[0] for t in texts] == fresh.count(texts)
    assert max(map(len, pieces.known)) <= token_counts.PIECE_CHARS


# ---------------------------------------------------------------- Merkle manifest


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_siblings(levels, i):
    for level in levels[:-1]:
        run = level[i & -8 : (i & -8) + 8]
        yield run[: i & 7], run[(i & 7) + 1 :]
        i >>= 3


def plain_leaf(doc, text):
    def field(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    return sha(*map(field, (doc["doc_id"], doc["source"], doc["lang"], doc["n_chars"], text)))


def plain_manifest(docs):
    langs = sorted({d["lang"] for d in docs}, key=lambda x: (x is not None, (x or "").encode()))
    members = {x: sorted((d for d in docs if d["lang"] == x), key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, plain_leaf(d, d["text"]))) for x in langs}
    trees = {x: plain_tree([plain_leaf(d, d["text"]) for d in members[x]]) for x in langs}
    top = plain_tree([trees[x][-1][0] for x in langs])
    root, out = top[-1][0], Counter()
    for number, lang in enumerate(langs):
        for i, doc in enumerate(members[lang]):
            path = [*plain_siblings(trees[lang], i), *plain_siblings(top, number)]
            text = doc["text"]
            if doc["doc_id"] is not None and zlib.crc32(str(doc["doc_id"]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = plain_leaf(doc, text)
            for before, after in path:
                folded = sha(*before, folded, *after)
            proof = sha(*(x for b, a in path for x in b + a))
            out[doc["doc_id"], trees[lang][0][i], trees[lang][-1][0], root, proof, folded, folded == root] += 1
    return out


def test_manifest_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert counted(QUERIES["op12_merkle_manifest"](spark, sf)) == plain_manifest(docs)


def test_manifest_edges(odd_docs, no_docs):
    langs = odd_docs.withColumn("lang", F.when(F.col("doc_id") > 5, "é").when(F.col("doc_id") > 2, "z").when(F.col("doc_id") == 1, ""))
    for docs in (odd_docs, langs):
        assert counted(merkle.audit(docs)) == plain_manifest(docs.collect())
    assert merkle.audit(no_docs).count() == 0


@pytest.mark.parametrize("height", [1, 2])
def test_manifest_layers(spark, monkeypatch, height):
    """Trees cut into several layers, one tree with most of the leaves, more trees than a block has leaves."""
    monkeypatch.setattr(merkle, "BLOCK_HEIGHT", height)
    merkle.extent.cache_clear()
    data = [(i, "a" if i % 3 else f"l{i % 89}", f"Text {i}") for i in range(700)]
    docs = spark.createDataFrame(data, "doc_id long, lang string, text string").selectExpr("*", "null as source", "length(text) as n_chars")
    assert counted(merkle.audit(docs)) == plain_manifest(docs.collect())
    merkle.extent.cache_clear()


def test_addresses():
    """Every node has a slot of its own, and every aligned subtree of a split lies in one stretch."""
    for levels in range(1, 6):
        slots = [merkle.address(levels, d, i) for d in range(levels) for i in range(8**d)]
        assert sorted(slots) == list(range(merkle.slots(levels)))
        top = levels // 2
        for root in range(8**top if top else 0):
            inside = [merkle.address(levels, top + d, (root << 3 * d) + i) for d in range(levels - top) for i in range(8**d)]
            assert max(inside) - min(inside) + 1 == len(inside) == merkle.slots(levels - top)
    at = merkle.address(4, 3, np.arange(512))
    assert at.tolist() == [merkle.address(4, 3, i) for i in range(512)]
    for height in range(9):
        pieces, depth, places = merkle.layers(height), height, []
        assert sum(pieces) == height
        for piece in pieces:
            depth -= piece
            places += [(merkle.block_address(height, depth, i), merkle.slots(piece + 1)) for i in range(8**depth)] if depth < 4 else []
        assert all(a + n <= b for (a, n), (b, _) in zip(sorted(places), sorted(places)[1:]))
    assert merkle.block_address(8, 0, 0) == 0 and merkle.block_address(8, 4, 4095) + merkle.slots(5) == merkle.extent(8)


# ---------------------------------------------------------------- conversation repair

SPACE = " \t\n\x0b\x0c\r"
NEEDED = {"": "u", "s": "u", "u": "a", "a": "u"}


def plain_damage(turns):
    out = {}
    for conv, turn, role, text in turns:
        role, text = (" " if v is None else v for v in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        rows = out.setdefault(conv, [])
        rows += [(turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def plain_repair(rows):
    """Cheapest audits as (cost, letters) by state, from the last row to the first."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), sha(r[2])))
    seen, faults = set(), []
    for _, role, text in rows:
        last = text.rstrip(SPACE)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    best = {"": (0, ""), "a": (0, ""), "u": (2, "I"), "s": (4, "II")}
    for fault, initial in zip(reversed(faults), reversed(initials)):
        here = {}
        for state, follow in NEEDED.items():
            ways = [(best[state][0] + 3, "D" + best[state][1])]
            if fault in ("", "truncated"):
                more = fault == "truncated"
                ways.append((best[follow][0] + 2 + more, "R" + best[follow][1]))
                if initial == follow or (initial == "s" and state == ""):
                    ways.append((best[initial][0] + more, "K" + best[initial][1]))
            here[state] = min(ways)
        for _ in range(4):
            here = {s: min(here[s], (here[f][0] + 2, "I" + here[f][1])) for s, f in NEEDED.items()}
        best = here
    cost, audit = best[""]
    state, out, left = "", [], iter(rows)
    for letter in audit:
        _, role, text = (None, None, "") if letter == "I" else next(left)
        if letter in "IR":
            role = {"u": "user", "a": "assistant"}[NEEDED[state]]
        if letter != "D":
            state = role[0]
            out.append(f"{role}:{text}")
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, sha("\n".join(out)))


def plain_repairs(turns):
    return Counter((conv, *plain_repair(rows)) for conv, rows in plain_damage(turns).items())


def test_repair_conversations(spark, sf):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert counted(QUERIES["op13_turn_repair"](spark, sf)) == plain_repairs(turns)


@pytest.mark.parametrize("block_rows", [3, 4096])
def test_repair_edges(spark, block_rows):
    """Null ids, turns, roles and texts, ties, repeats, odd roles, conversations over many blocks, extra columns."""
    rng = random.Random(7)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "user", "assistant"], [None, "", " \t\n", "a", "a.", "b! ", "c?\n", "ä" * 20_000, "."]
    turns = [(c, rng.choice([None, *range(50)]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(25)] for _ in range(rng.choice([1, 2, 6, 60, 250]))]
    frame = spark.createDataFrame([(*t, 1, "x") for t in turns], "conv_id long, turn long, role string, text string, block int, conv string")
    assert counted(turn_repair.repair_damaged(frame.repartition(4), block_rows)) == plain_repairs(turns)
    assert turn_repair.repair_damaged(frame.limit(0), block_rows).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=turn_repair.LETTERS, max_size=12), min_size=1, max_size=4), st.lists(st.integers(0, 9), min_size=4, max_size=4))
def test_least_pieces(blocks, ends):
    """Pieces, exits and costs per entry state against all edit sequences of a block."""
    found = list(turn_repair.least_pieces([(b, ends, False) for b in blocks]))
    for letters, (cost, exits, pieces) in zip(blocks, found):
        best = [(v, "", s) for s, v in enumerate(ends)]
        for letter in reversed(letters):
            kind, fault = divmod(turn_repair.LETTERS.index(letter), 4)
            here = []
            for state, follow in enumerate(turn_repair.NEXT):
                ways = [(best[state][0] + 3, "D" + best[state][1], best[state][2])]
                if fault < 2:
                    ways.append((best[follow][0] + 2 + fault, "R" + best[follow][1], best[follow][2]))
                    for target in range(4):
                        if (kind, state, target) == (0, 0, 1) or (target == follow and kind == follow - 1):
                            ways.append((best[target][0] + fault, "K" + best[target][1], best[target][2]))
                here.append(min(ways))
            for _ in range(4):
                here = [min(h, (here[f][0] + 2, "I" + here[f][1], here[f][2])) for h, f in zip(here, turn_repair.NEXT)]
            best = here
        assert cost == best[0][0] and pieces == [b[1] for b in best] and exits == [b[2] for b in best]
        costs = turn_repair.transfer(letters)
        assert [min(c + e for c, e in zip(costs[4 * s : 4 * s + 4], ends)) if letters else ends[s] for s in range(4)] == [b[0] for b in best]
