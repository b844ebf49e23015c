"""Look-alike photos: exact banded Hamming join and transitive groups.

Two signatures look alike when their aspects differ by at most 8 and their 256 bits by at most 24.
Groups are the connected components of that relation, so an edge inside an already connected group
adds nothing; the plan below exploits this to stay exact without ever listing all pairs of a group.

1. Equal signatures collapse to one representative.
2. Bits are dealt to 13 interleaved bands (bit b to band b mod 13, so a blank image region thins every
   band instead of making one band constant).  With thresholds 0 for band 0 and 1 for the other twelve,
   the sum of (threshold + 1) is 25, so any pair within 24 bits meets the threshold in some band (general
   pigeonhole principle; multi-index hashing, Norouzi et al., CVPR 2012; Qin et al., ICDE 2018).
3. Star contraction: every signature is compared with one representative of each of its buckets, and
   the components of these edges become labels.  Near-identical bursts collapse here in linear work.
4. Signatures meet their one-bit neighbours per band in an equi-join; pairs with equal labels are
   skipped and only distinct pairs of labels leave the join.
5. In a bucket above ``hot_rows`` the rows of the main label are kept apart and never meet each other.
   The rest is joined directly when small, else refined by a second band (the same principle for the
   remaining bits); what is still large then is split again and cut into a salted grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mementa import constants as K
from mementa.functions import signature as S
from mementa.operators.common import HEAVY_KEY_ROWS, lookup_join
from mementa.operators.components import connected_components
from mementa.session import reliable_checkpoint

BITS, BANDS = 256, 13
WORDS = [f"w{i}" for i in range(4)]
HOT_ROWS = 4096
# Hot keys are broadcast up to this number (their count is checked) and joined by key beyond it.
BROADCAST_KEYS = 100_000
NO_BIT = 511


def _signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def _int_array(values: list[int]) -> Column:
    text = ",".join(str(v) for v in values)
    return F.expr(f"cast(split('{text}', ',') as array<bigint>)")


MASKS = [
    _signed(sum(1 << (b % 64) for b in range(w * 64, w * 64 + 64) if b % BANDS == band))
    for band in range(BANDS)
    for w in range(4)
]


def _codes(bands: list[int], wide: int | None, exact_only: int | None) -> list[int]:
    """Probes as p * 512 + q: bits p and q to flip (q = NO_BIT for none); p = 256 + band flips nothing."""
    codes = [(BITS + band) * 512 + NO_BIT for band in bands]
    codes += [p * 512 + NO_BIT for p in range(BITS) if p % BANDS in bands and p % BANDS != exact_only]
    if wide is not None:
        bits = [p for p in range(BITS) if p % BANDS == wide]
        codes += [p * 512 + q for i, p in enumerate(bits) for q in bits[i + 1:]]
    return codes


def _key(df: DataFrame, code: Column, out: str, prefix: str | None = None) -> DataFrame:
    """Band key of a signature with the bits of ``code`` flipped.

    The key hashes the masked words; a hash collision only adds a candidate that the test rejects.
    """
    p, q = F.floor(code / 512), F.pmod(code, F.lit(512))
    band = F.when(p >= BITS, p - BITS).otherwise(F.pmod(p, F.lit(BANDS))).cast("int")
    masks = _int_array(MASKS)

    def flip(bit: Column, w: int) -> Column:
        inside = (bit >= w * 64) & (bit < w * 64 + 64)
        shifted = F.call_function("shiftleft", F.lit(1).cast("long"), (bit - w * 64).cast("int"))
        return F.when(inside, shifted).otherwise(F.lit(0).cast("long"))

    words = [
        F.col(WORDS[w])
        .bitwiseXOR(flip(p, w))
        .bitwiseXOR(flip(q, w))
        .bitwiseAND(F.element_at(masks, band * 4 + (w + 1)))
        for w in range(4)
    ]
    parts = ([F.col(prefix)] if prefix else []) + [band, *words]
    return df.withColumn(out, F.xxhash64(*parts)).withColumn(f"{out}_band", band)


def _explode_keys(df: DataFrame, codes: Column, out: str, prefix: str | None = None) -> DataFrame:
    opened = df.withColumn("_code", F.explode(codes))
    return _key(opened, F.col("_code"), out, prefix).drop("_code")


def exact_keys(signatures: DataFrame) -> DataFrame:
    return _explode_keys(signatures, _int_array([(BITS + b) * 512 + NO_BIT for b in range(BANDS)]), "key")


def probe_keys(signatures: DataFrame) -> DataFrame:
    return _explode_keys(signatures, _int_array(_codes(list(range(BANDS)), None, 0)), "key")


def _second_codes(exact: bool) -> Column:
    """Per first band, the probes into the other twelve.

    Inside a bucket at most 24 differing bits remain for twelve bands, so threshold 1 everywhere and 2
    in one of them again sums to 25.
    """
    rows = []
    for band in range(BANDS):
        others = [b for b in range(BANDS) if b != band]
        codes = (
            [(BITS + b) * 512 + NO_BIT for b in others] if exact else _codes(others, (band + 1) % BANDS, None)
        )
        rows.append(_int_array(codes))
    return F.element_at(F.array(*rows), F.col("key_band") + 1)


def _same(left: str, right: str) -> Column:
    return S.similar(
        [F.col(f"{left}.{w}") for w in WORDS], F.col(f"{left}.aspect_q"),
        [F.col(f"{right}.{w}") for w in WORDS], F.col(f"{right}.aspect_q"),
    )


COLUMNS = ["sid", "label", "aspect_q", *WORDS]


def _links(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Distinct pairs of labels joined by at least one look-alike pair.

    The member has the smaller sid and the prober the larger one, so every pair is tested once.
    """
    joined = left.select(*on, *COLUMNS).alias("l").join(right.select(*on, *COLUMNS).alias("r"), on)
    wanted = (F.col("l.label") != F.col("r.label")) & (F.col("l.sid") < F.col("r.sid"))
    return (
        joined.filter(wanted & _same("l", "r"))
        .select(
            F.least("l.label", "r.label").alias("a"), F.greatest("l.label", "r.label").alias("b")
        )
        .distinct()
    )


def _crowded(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows: their main label and the number of rows outside it."""
    labels = rows.groupBy(key, "label").agg(F.count("*").alias("n"))
    return reliable_checkpoint(
        labels.groupBy(key)
        .agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("m"))
        .filter(F.col("n") > limit)
        .select(key, F.col("m.label").alias("main"), F.col("n"), (F.col("n") - F.col("m.n")).alias("others"))
    )


def _keys(df: DataFrame) -> DataFrame:
    """A table of hot keys, broadcast where there are few; adaptive execution splits the skewed join otherwise."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def _split(members: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Part 0 holds the rows of the main label, part 1 the rest; the main label only probes the rest."""
    is_main = F.col("label") == F.col("main")
    parts = F.when(is_main, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    return members.withColumn("part", F.when(is_main, 0).otherwise(1)), probes.withColumn("part", F.explode(parts))


def _hot_links(members: DataFrame, probes: DataFrame, limit: int) -> DataFrame:
    """Links found through hot buckets (``members`` and ``probes`` carry main label and counts).

    Rows of the main label of a bucket are never compared with each other.  A rest of at most ``limit``
    rows is joined directly; everything else is refined by a second band.
    """
    left, right = _split(members, probes)
    few = (F.col("part") == 1) & (F.col("others") <= limit)
    direct = _links(left.filter(few), right.filter(few), ["key", "part"])
    parted = F.xxhash64("key", "part")
    refined = _refined_links(
        left.filter(~few).withColumn("key", parted).drop("main", "n", "others", "part"),
        right.filter(~few).withColumn("key", parted).drop("main", "n", "others", "part"),
        limit,
    )
    return direct.unionByName(refined)


def _refined_links(members: DataFrame, probes: DataFrame, limit: int) -> DataFrame:
    """Links found by a second band inside hot buckets.

    A second-level bucket above ``limit`` is again split by its main label, and the remaining work is
    cut into a grid of cells of about ``limit`` by ``limit``, so no task receives a whole bucket.
    """
    left = _explode_keys(members, _second_codes(exact=True), "key2", "key")
    right = _explode_keys(probes, _second_codes(exact=False), "key2", "key")
    big = _keys(_crowded(left, "key2", limit))
    plain = _links(left.join(big, "key2", "left_anti"), right.join(big, "key2", "left_anti"), ["key2"])
    cells = F.ceil(F.col("n") / limit).cast("int")
    every = F.explode(F.sequence(F.lit(0), cells - 1))
    own = F.pmod(F.xxhash64("sid"), cells).cast("int")
    grid_left, grid_right = _split(left.join(big, "key2"), right.join(big, "key2"))
    gridded = _links(
        grid_left.withColumn("row", own).withColumn("col", every),
        grid_right.withColumn("col", own).withColumn("row", every),
        ["key2", "part", "row", "col"],
    )
    return plain.unionByName(gridded)


def signature_components(signatures: DataFrame, hot_rows: int = HOT_ROWS,
                         heavy_rows: int = HEAVY_KEY_ROWS) -> DataFrame:
    """(sid, component) of distinct signatures (sid, aspect_q, w0..w3); the component is its least sid."""
    base = reliable_checkpoint(signatures)
    total = BANDS * base.count()
    exact = exact_keys(base)
    buckets = reliable_checkpoint(
        exact.groupBy("key")
        .agg(F.count("*").alias("n"), F.min(F.struct("sid", "aspect_q", *WORDS)).alias("rep"))
        .filter("n >= 2")
    )
    star = (
        lookup_join(exact.alias("x").select("key", F.struct("sid", "aspect_q", *WORDS).alias("own")),
                    buckets, "key", "n", heavy_rows, total)
        .filter((F.col("own.sid") != F.col("rep.sid")) & _same("own", "rep"))
        .select(F.col("own.sid").alias("a"), F.col("rep.sid").alias("b"))
    )
    first = connected_components(star, heavy_rows)
    labelled = reliable_checkpoint(
        base.join(first, F.col("sid") == F.col("vertex"), "left")
        .withColumn("label", F.coalesce("component", "sid"))
        .drop("vertex", "component")
    )
    members, probes = exact_keys(labelled), probe_keys(labelled)
    limit = hot_rows
    hot = buckets.filter(F.col("n") > limit).select("key")
    if hot.isEmpty():
        links = _links(members, probes, ["key"])
    else:
        small = _keys(hot)
        main = _keys(_crowded(members.join(small, "key"), "key", limit))
        links = _links(
            members.join(small, "key", "left_anti"), probes.join(small, "key", "left_anti"), ["key"]
        ).unionByName(_hot_links(members.join(main, "key"), probes.join(main, "key"), limit))
    second = connected_components(links, heavy_rows)
    return labelled.join(second, F.col("label") == F.col("vertex"), "left").select(
        "sid", F.coalesce("component", "label").alias("component")
    )


def distinct_signatures(photos: DataFrame) -> DataFrame:
    """Collapse photos with equal aspect and bits: the least id stands for all of them."""
    return (
        photos.filter("sig IS NOT NULL")
        .withColumn("signature", F.struct("aspect_q", "sig"))
        .groupBy("signature")
        .agg(F.min("id").alias("sid"), F.count("*").alias("copies"))
    )


def similar_members(photos: DataFrame, hot_rows: int = HOT_ROWS,
                    heavy_rows: int = HEAVY_KEY_ROWS) -> DataFrame:
    """Every photo with a signature as (id, size_bytes, component).

    The signatures are materialised first (some 80 bytes per photo), so callers may pass them as an
    expression over pixels without having it evaluated again by every step.
    """
    stored = reliable_checkpoint(
        photos.select("id", "size_bytes", "aspect_q", "sig")
    ).filter("sig IS NOT NULL")
    total = stored.count()
    distinct = distinct_signatures(stored)
    words = [F.get("signature.sig", F.lit(i)).alias(w) for i, w in enumerate(WORDS)]
    components = signature_components(
        distinct.select("sid", F.col("signature.aspect_q").alias("aspect_q"), *words), hot_rows, heavy_rows
    )
    labelled = distinct.join(components, "sid").select("signature", "copies", "component")
    tagged = stored.withColumn("signature", F.struct("aspect_q", "sig"))
    joined = lookup_join(tagged, labelled, "signature", "copies", heavy_rows, total)
    return joined.select("id", "size_bytes", "component")


def similar_groups(members: DataFrame) -> DataFrame:
    """Groups of two or more look-alikes; the largest file leads and is kept."""
    leader = F.max(F.struct("size_bytes", (-F.col("id")).alias("neg_id"))).alias("lead")
    return (
        members.groupBy("component")
        .agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("total"), leader)
        .filter("n_files >= 2")
        .select(
            F.concat(F.lit("sim-"), (-F.col("lead.neg_id")).cast("string")).alias("group_key"),
            "n_files",
            F.col("lead.size_bytes").alias("size_bytes"),
            (F.col("total") - F.col("lead.size_bytes")).alias("reclaimable_bytes"),
            (-F.col("lead.neg_id")).alias("keep_id"),
            "component",
        )
    )


def group_members(members: DataFrame, groups: DataFrame, heavy_rows: int = HEAVY_KEY_ROWS) -> DataFrame:
    """Members of the groups; none is pre-selected, as look-alikes need a human decision."""
    cols = groups.select("component", "group_key", "n_files", "keep_id")
    return (
        lookup_join(members, cols, "component", "n_files", heavy_rows)
        .withColumn("is_largest", F.col("id") == F.col("keep_id"))
        .withColumn("preselected", F.lit(False))
        .drop("keep_id")
    )


def photo_candidates(files: DataFrame) -> DataFrame:
    """All photos count as scanned, also those without a usable signature."""
    return files.agg(F.count_if(F.col("category") == "photo").alias("scanned_candidates"))


def brute_force_links(signatures: DataFrame) -> DataFrame:
    """Reference answer for small inputs only (tests): every pair is compared."""
    left, right = signatures.alias("l"), signatures.alias("r")
    return left.join(right, (F.col("l.sid") < F.col("r.sid")) & _same("l", "r")).select(
        F.col("l.sid").alias("a"), F.col("r.sid").alias("b")
    )
