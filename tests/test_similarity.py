"""Banded look-alike join and components against brute force, with and without hot buckets."""

import random

import pytest
from pyspark.sql import functions as F

from mementa.operators import similarity as M
from mementa.operators.components import connected_components


def _signed(value):
    return value - 2**64 if value >= 2**63 else value


def frame(spark, rows):
    data = [(i, a, *[_signed((s >> (64 * w)) & (2**64 - 1)) for w in range(4)]) for i, (a, s) in enumerate(rows)]
    return spark.createDataFrame(data, "sid long, aspect_q int, w0 long, w1 long, w2 long, w3 long")


def expected(rows):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(rows):
        for j in range(i):
            if abs(a - rows[j][0]) <= 8 and bin(s ^ rows[j][1]).count("1") <= 24:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in range(len(rows))}


def flip(rng, sig, n):
    for bit in rng.sample(range(256), n):
        sig ^= 1 << bit
    return sig


def mixed_rows(seed):
    """Random photos, exact-distance pairs, chains, and near-identical bursts."""
    rng = random.Random(seed)
    rows = [(rng.choice([100, 120, 127]), rng.getrandbits(256)) for _ in range(60)]
    for distance in (1, 12, 23, 24, 24, 24, 25, 25, 26):
        base = rng.getrandbits(256)
        rows += [(127, base), (127 + rng.choice([0, 8, 9]), flip(rng, base, distance))]
    chain = rng.getrandbits(256)
    for _ in range(6):
        rows.append((127, chain))
        chain = flip(rng, chain, 24)
    burst = rng.getrandbits(256)
    rows += [(127, flip(rng, burst, rng.randrange(14))) for _ in range(60)]
    return list(dict.fromkeys(rows))


def skewed_rows(seed):
    """Many photos share blank regions (equal bits in whole bands), some of them look alike."""
    rng = random.Random(seed)
    blank = sum(1 << b for b in range(256) if b % 13 in (0, 1, 2, 3, 4))
    shared = rng.getrandbits(256) & blank
    rows = []
    for _ in range(120):
        rows.append((127, shared | (rng.getrandbits(256) & ~blank)))
    for _ in range(40):
        a, s = rng.choice(rows)
        rows.append((a + rng.randrange(-9, 10), flip(rng, s, rng.choice([3, 20, 24, 25, 26]))))
    return list(dict.fromkeys(rows))


def components(spark, rows, **options):
    got = M.signature_components(frame(spark, rows), **options).collect()
    return {r.sid: r.component for r in got}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = mixed_rows(seed)
    assert components(spark, rows) == expected(rows)


@pytest.mark.parametrize("rows", [mixed_rows(3), skewed_rows(4)], ids=["mixed", "skewed"])
def test_hot_buckets_stay_exact(spark, rows):
    """Tiny limits force the second band, the main-label split, the grid and the broadcast branch."""
    assert components(spark, rows, hot_rows=3, heavy_rows=4) == expected(rows)


def test_pigeonhole_at_every_distance(spark):
    """Every pair within the limit meets in some probe, also when its bits hit each band twice."""
    rng = random.Random(9)
    left, right = [], []
    for i in range(200):
        base = rng.getrandbits(256)
        bits = [b for band in range(13) for b in rng.sample([x for x in range(256) if x % 13 == band], 2)]
        chosen = bits[2:] if i % 2 else rng.sample(range(256), 24)
        other = base
        for b in chosen:
            other ^= 1 << b
        left.append((127, base))
        right.append((127, other))
    a, b = M.exact_keys(frame(spark, left)), M.probe_keys(frame(spark, right))
    met = a.select("sid", "key").join(b.select("sid", "key"), ["sid", "key"]).select("sid").distinct().count()
    assert met == 200


def test_second_band_meets_every_pair(spark):
    """Inside a shared first bucket, the second-level probes meet every pair within the limit."""
    rng = random.Random(10)
    left, right = [], []
    for _ in range(100):
        base = rng.getrandbits(256)
        band = rng.randrange(13)
        other = base
        for b in rng.sample([x for x in range(256) if x % 13 != band], 24):
            other ^= 1 << b
        left.append((127, base))
        right.append((127, other))
    a = M._explode_keys(M.exact_keys(frame(spark, left)), M._second_codes(True), "key2", "key")
    b = M._explode_keys(M.probe_keys(frame(spark, right)), M._second_codes(False), "key2", "key")
    shared = M.exact_keys(frame(spark, left)).select("sid", "key").join(
        M.probe_keys(frame(spark, right)).select("sid", "key"), ["sid", "key"]
    ).distinct()
    met = a.select("sid", "key", "key2").join(b.select("sid", "key", "key2"), ["sid", "key", "key2"])
    assert met.select("sid", "key").distinct().count() == shared.count() >= 100


def test_components_of_random_graphs(spark):
    rng = random.Random(11)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)]
    edges += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), heavy_rows=5)
    assert {r.vertex: r.component for r in got.collect()} == {v: find(v) for v in parent}


def test_groups_and_members(spark):
    base = [0x5A5A5A5A5A5A5A5A, 0x0F0F, 77, -5]
    near = [base[0] ^ 1, *base[1:]]
    far = [~w for w in base]
    rows = [(1, 10, 127, base), (2, 30, 127, near), (3, 30, 127, base), (4, 99, 127, far), (5, 50, 140, base), (6, 1, 127, None)]
    photos = spark.createDataFrame(rows, "id long, size_bytes long, aspect_q int, sig array<long>")
    members = M.similar_members(photos)
    groups = M.similar_groups(members).collect()
    assert [(g.group_key, g.n_files, g.size_bytes, g.reclaimable_bytes, g.keep_id) for g in groups] == [("sim-2", 3, 30, 40, 2)]
    shown = M.group_members(members, M.similar_groups(members)).collect()
    assert {(r.id, r.is_largest, r.preselected) for r in shown} == {(1, False, False), (2, True, False), (3, False, False)}
    files = spark.createDataFrame([("photo",), ("photo",), ("music",)], "category string")
    assert M.photo_candidates(files).first().scanned_candidates == 2


def test_brute_force_helper_agrees(spark):
    rows = mixed_rows(12)[:80]
    links = M.brute_force_links(frame(spark, rows))
    labels = {r.vertex: r.component for r in connected_components(links).collect()}
    assert {i: labels.get(i, i) for i in range(len(rows))} == expected(rows)


def test_text_grids_hold_little_beside_their_batch():
    """A batch of 10,000 texts of 2.5 KB: 11 MB of grids, no second copy of the texts."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from mementa.plans.bindings import text_grids

    edge = pa.array(["x" * 300, None, "", "é" * 136, "a" * 271, "ab" * 400], pa.string())
    got = text_grids(edge.slice(1)).to_pylist()
    assert [g is None for g in got] == [True, True, False, True, False]
    assert got[2] == list("é".encode()) * 136 and got[4] == [
        int(np.mean(np.frombuffer(b"ab" * 400, np.uint8)[i * 800 // 272 : (i + 1) * 800 // 272])) for i in range(272)
    ]
    texts = pa.array([f"{i:05d} some text " * 160 for i in range(10_000)])
    tracemalloc.start()
    grids = text_grids(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(grids) == 10_000 and peak < 20_000_000


def test_grid_of_a_long_text_holds_no_copy_of_it():
    """One text of 32 MB: its bytes are summed where they lie, to the same cells."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from mementa.plans.bindings import text_grids

    n = 32_000_007
    text = "abcdefg" * (n // 7) + "a" * (n % 7)
    texts = pa.array([text, None, "b" * 300], pa.string())
    tracemalloc.start()
    grids = text_grids(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    raw = np.frombuffer(text.encode(), np.uint8)
    cells = [int(raw[i * n // 272 : (i + 1) * n // 272].astype(np.int64).sum()) // ((i + 1) * n // 272 - i * n // 272) for i in range(272)]
    assert grids.to_pylist() == [cells, None, [98] * 272] and peak < 2_000_000
