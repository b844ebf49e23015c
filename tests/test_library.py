"""Index, duplicates, consolidation, coverage, purge, sync and library tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from mementa.operators import consolidation as C
from mementa.operators import duplicates as D
from mementa.operators import index as I
from mementa.operators import sync as Y
from mementa.operators.common import lookup_join, number_rows, prefix_sum, upsert
from mementa.plans import bindings as B
from mementa.plans import library as stored_library
from mementa.plans.library import Library, run_consolidation, run_index
from mementa.sources import objects as O

INV = "root_path string, absolute_path string, relative_path string, size_bytes long, modified_unix long, extension string"


def inventory(spark, root, entries):
    rows = []
    for rel, data, mtime in entries:
        ext = rel.rsplit(".", 1)[1] if "." in rel else None
        rows.append((root, f"{root}/{rel}", rel, len(data), mtime, ext, hashlib.sha256(data).hexdigest(), data))
    return spark.createDataFrame(rows, INV + ", content_hash string, content binary")


def indexed(spark, entries, root="/r"):
    files = I.describe(inventory(spark, root, entries))
    return files.withColumn("id", F.row_number().over(__import__("pyspark").sql.Window.orderBy("relative_path")).cast("long"))


def test_index_and_metrics(spark):
    inv = inventory(spark, "/r", [("Photo/DCIM/image.jpg", b"abc", 1), ("Video/Camera/movie.mp4", b"12345", 2)])
    files = I.describe(inv)
    summary = I.index_summary(files).first()
    assert (summary.scanned_files, summary.indexed_files, summary.total_bytes) == (2, 2, 8)
    metrics = [(r.category, r.n_files, r.n_bytes) for r in I.category_metrics(files).collect()]
    assert metrics == [("photo", 1, 3), ("video", 1, 5), ("music", 0, 0), ("documents", 0, 0)]
    assert files.filter("category = 'photo'").first().source == "DCIM"
    assert I.index_summary(files.limit(0)).first().total_bytes == 0
    assert I.scan_run_rows(files.limit(0)).count() == 0


def test_paging(spark):
    files = indexed(spark, [("Photo/a/1.jpg", b"1", 5), ("Photo/a/2.jpg", b"22", 5), ("Photo/a/3.jpg", b"3", None)])
    first, second = I.page_files(files, None, 2, 0).collect(), I.page_files(files, None, 2, 2).collect()
    assert [r.size_bytes for r in first] == [2, 1] and len(second) == 1
    assert {r.id for r in first} & {r.id for r in second} == set()
    assert I.page_files(files, None, 0).count() == 1
    assert I.page_files(files, "video").count() == 0
    last = first[-1]
    after = I.page_after(files, last.modified_unix, last.size_bytes, last.id, None, 2).collect()
    assert [r.id for r in after] == [r.id for r in second]
    assert I.page_has_more(files, None, 2, 0).first().has_more and not I.page_has_more(files, None, 2, 2).first().has_more


def test_incremental_index_reuses_hashes(spark):
    inv = inventory(spark, "/r", [("a.txt", b"one", 1), ("b.txt", b"two", None), ("c.txt", b"three", 3), ("d.txt", b"new", 4)])
    plain = inv.drop("content_hash", "content")
    old = I.describe(inv).withColumn("content_hash", F.concat(F.lit("old-"), "relative_path")).filter("relative_path <> 'd.txt'")
    old = old.withColumn("modified_unix", F.when(F.col("relative_path") == "c.txt", 2).otherwise(F.col("modified_unix")))
    contents = inv.filter("relative_path <> 'd.txt'").select("absolute_path", "content")
    for bits in (1, 3, I.FILTER_BITS):  # one bit lets every path through
        rows = I.incremental_index(plain, old, I.hash_from_table(contents, filter_bits=bits)).collect()
        got = {r.relative_path: (r.content_hash, r.unchanged) for r in rows}
        assert got == {
            "a.txt": ("old-a.txt", True), "b.txt": ("old-b.txt", True),
            "c.txt": (hashlib.sha256(b"three").hexdigest(), False), "d.txt": (None, False),
        }


def test_upsert_keeps_vanished_rows_and_overwrites_with_null(spark):
    old = spark.createDataFrame([(1, "a", "h1"), (2, "b", "h2")], "id long, absolute_path string, content_hash string")
    new = spark.createDataFrame([("b", None), ("c", "h3")], "absolute_path string, content_hash string")
    got = {tuple(r) for r in upsert(old, new, ["absolute_path"], keep=["id"]).collect()}
    assert got == {(1, "a", "h1"), (2, "b", None), (None, "c", "h3")}


def test_exact_duplicates(spark):
    nine = bytes([9, 9, 9, 9])
    files = indexed(spark, [("a.bin", nine, 7), ("b.bin", nine, 3), ("c.bin", bytes([1, 2, 3, 4, 5]), 1)])
    groups = D.duplicate_groups(files)
    row = groups.first()
    assert groups.count() == 1 and (row.size_bytes, row.n_files, row.reclaimable_bytes) == (4, 2, 4)
    assert files.filter(F.col("id") == row.oldest_id).first().relative_path == "b.bin"
    summary = D.scan_summary(groups, D.candidate_count(files)).first()
    assert (summary.total_groups, summary.reclaimable_bytes, summary.scanned_candidates) == (1, 4, 2)
    # a third, unreadable file of the same size is a candidate, but in no group
    more = files.unionByName(files.limit(1).withColumn("id", F.lit(9).cast("long")).withColumn("content_hash", F.lit(None).cast("string")))
    assert D.candidate_count(more).first().scanned_candidates == 3 and D.duplicate_groups(more).first().n_files == 2


def test_empty_duplicates_and_null_times(spark):
    files = indexed(spark, [("x/a", b"", None), ("x/b", b"", 5), ("x/c", b"", None)])
    row = D.duplicate_groups(files).first()
    assert (row.n_files, row.reclaimable_bytes) == (3, 0)
    assert files.filter(F.col("id") == row.oldest_id).first().relative_path == "x/b"


@pytest.mark.parametrize("heavy", [2, 10**6])
def test_selection_prefers_regular_names(spark, heavy):
    files = indexed(spark, [("x/DUPLICATE_1.jpg", b"q", 1), ("x/2.jpg", b"q", 5), ("x/3.jpg", b"q", 9), ("y/DUPLICATE_a", b"zz", 1), ("y/duplicate_b", b"zz", 2)])
    members = D.duplicate_members(files, D.duplicate_groups(files), heavy)
    kept = {r.relative_path for r in members.filter("NOT preselected").collect()}
    assert kept == {"x/2.jpg", "y/DUPLICATE_a"} and members.count() == 5
    chosen = members.filter("relative_path IN ('x/3.jpg', 'y/DUPLICATE_a')")
    left = D.remove_selected(members, chosen, "content_hash")
    assert {r.relative_path for r in left.collect()} == {"x/DUPLICATE_1.jpg", "x/2.jpg"}
    everything = D.deletable_selection(members, members.filter("size_bytes = 2"), "content_hash")
    assert [r.deletable for r in everything.collect()] == [False, False]


def test_tile_cap(spark):
    files = indexed(spark, [(f"x/{i:03}", b"same", i) for i in range(30)])
    members = D.duplicate_members(files, D.duplicate_groups(files))
    assert D.first_tiles(members, "content_hash", D.keep_order()).count() == 24
    assert D.hidden_members(D.duplicate_groups(files)).first().n_hidden == 6


def test_display_limit_reaches_the_map_side(spark, sf):
    plan = D.first_tiles(B.files(spark, sf), "content_hash", D.keep_order())._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_hash_backfill_only_touches_collisions(spark):
    files = indexed(spark, [("a", b"xx", 1), ("b", b"yy", 1), ("c", b"longer", 1)])
    bare = files.withColumn("content_hash", F.lit(None).cast("string"))
    filled = I.backfill_hashes(bare, I.hash_from_table(files.select("absolute_path", "content")))
    got = {r.relative_path: r.content_hash for r in filled.collect()}
    assert got == {"a": hashlib.sha256(b"xx").hexdigest(), "b": hashlib.sha256(b"yy").hexdigest(), "c": None}


def test_purge_guard(spark):
    paths = ["/lib/objects/ab/x", "/lib/objects2/x", "/home/.app/x", "/data/gone", "/data/here", "/lib/objects"]
    requests = spark.createDataFrame([(p,) for p in paths], "absolute_path string")
    contents = spark.createDataFrame([("/lib/objects/ab/abc.jpg",)], "storage_path string")
    roots = D.protected_roots(contents).unionByName(spark.createDataFrame([("/home/.app/",)], "root string"))
    existing = spark.createDataFrame([("/data/here",), ("/lib/objects/ab/x",)], "absolute_path string")
    salted = {tuple(r) for r in D.purge_verdict(requests, roots, existing, broadcast_roots=1).collect()}
    assert salted == {tuple(r) for r in D.purge_verdict(requests, roots, existing).collect()}
    rows = {r.absolute_path: r for r in D.purge_verdict(requests, roots, existing).collect()}
    assert {p: r.verdict for p, r in rows.items()} == dict(zip(paths, ["refused", "missing", "refused", "missing", "eligible", "refused"]))
    assert "own storage" in rows[paths[0]].error and rows["/data/here"].error is None
    files = existing.withColumn("id", F.lit(1))
    assert [r.absolute_path for r in I.delete_paths(files, existing.limit(1)).collect()] == ["/lib/objects/ab/x"]


def test_purge_guard_resolves_paths(spark):
    paths = {
        "/home/../lib/objects/ab/x": "refused", "/lib//objects/./ab/x": "refused", "/../lib/objects/y": "refused",
        "../x": "refused", "/lib/objects/../here": "eligible", "/lib/objects/../gone": "missing",
    }
    requests = spark.createDataFrame([(p,) for p in paths], "absolute_path string")
    roots = spark.createDataFrame([("/lib/x/../objects/",)], "root string")
    existing = spark.createDataFrame([("/lib/here",), ("/lib/objects/ab/x",)], "absolute_path string")
    verdicts = D.purge_verdict(requests, roots, existing)
    assert {r.absolute_path: r.verdict for r in verdicts.collect()} == paths
    assert [r.absolute_path for r in D.eligible_paths(verdicts).collect()] == ["/lib/here"]


def test_unreadable_files_end_a_run(spark, tmp_path):
    library = Library(spark, str(tmp_path / "lib"))
    inv = inventory(spark, "/src", [A, C_]).withColumn("content_hash", F.when(F.col("relative_path") == A[0], F.col("content_hash")))
    with pytest.raises(Exception, match="File could not be read: /src/Docs/c.bin"):
        run_consolidation(library, inv, "generic-folder", "b", "/src", "/dest", "1")
    assert library.read("contents").isEmpty() and [r.status for r in library.read("import_runs").collect()] == ["running"]


def test_changed_photo_loses_its_signature_without_a_signer(spark):
    inv = inventory(spark, "/r", [("a.jpg", b"one", 1), ("b.jpg", b"two", 2)]).drop("content_hash")
    old = I.describe(inv).withColumns({"content_hash": F.lit("h"), "aspect_q": F.lit(5), "sig": F.array(F.lit(1).cast("long"))})
    old = old.withColumn("size_bytes", F.when(F.col("relative_path") == "b.jpg", 9).otherwise(F.col("size_bytes")))
    found = I.incremental_index(inv.drop("content"), old, I.hash_from_table(inv.select("absolute_path", "content")))
    after = I.upsert_files(old.withColumn("id", F.lit(1)), found)
    got = {r.relative_path: (r.content_hash, r.aspect_q, r.sig) for r in after.collect()}
    assert got == {"a.jpg": ("h", 5, [1]), "b.jpg": (hashlib.sha256(b"two").hexdigest(), None, None)}


A, B_, C_ = ("Photo/a.jpg", bytes([1, 2, 3]), 1), ("Photo/b.jpg", bytes([1, 2, 3]), 2), ("Docs/c.bin", bytes([4, 5]), 3)


def test_plan_and_run_differ_inside_a_source(spark):
    inv = inventory(spark, "/src", [A, B_, C_])
    empty = spark.createDataFrame([], "hash string, size_bytes long, extension string, storage_path string")
    outside = spark.createDataFrame([(hashlib.sha256(A[1]).hexdigest(),)], "content_hash string")
    plan = C.plan_consolidation(inv, empty, outside).first()
    assert (plan.total_files, plan.new_files, plan.duplicate_files, plan.total_bytes, plan.new_bytes, plan.already_on_computer) == (3, 3, 0, 8, 8, 2)
    run = C.run_summary(inv, empty, outside).first()
    assert (run.copied_files, run.duplicate_files, run.occurrences_recorded, run.copied_bytes, run.duplicate_bytes, run.already_on_computer) == (2, 1, 3, 5, 3, 1)
    actions = {r.relative_path: r.action for r in C.run_actions(inv, empty).collect()}
    assert actions == {"Photo/a.jpg": "copied", "Photo/b.jpg": "duplicate", "Docs/c.bin": "copied"}
    assert C.import_outcome(C.run_summary(inv, empty, outside)).first().already_had_copy == 1
    none = C.run_summary(inv.limit(0), empty, outside).first()
    assert none.total_files == 0 and none.copied_bytes == 0


RUN = dict(adapter="generic-folder", label="My backup", source_path="/src", destination="/dest")


def test_consolidation_twice(spark, tmp_path):
    library = Library(spark, str(tmp_path / "lib"), buckets=4)
    inv = inventory(spark, "/src", [A, B_, C_])
    args = dict(RUN, device_id="d1", store=O.from_table(inv))
    first = run_consolidation(library, inv, run_token="1", **args).first()
    assert (first.total_files, first.copied_files, first.duplicate_files, first.occurrences_recorded) == (3, 2, 1, 3)
    outside = C.indexed_outside(library.read("files"), "/dest")
    again = C.plan_consolidation(inv, library.read("contents"), outside).first()
    assert (again.new_files, again.duplicate_files) == (0, 3)
    coverage = C.backup_coverage(library.read("backups"), library.read("occurrences"), library.read("contents")).first()
    assert (coverage.total_files, coverage.covered_files, coverage.safe_to_delete, coverage.coverage_percent) == (3, 3, True, 100.0)
    assert (coverage.total_bytes, coverage.reclaimable_bytes) == (8, 8)
    files = {r.relative_path: r for r in library.read("files").collect()}
    assert set(files) == {"Photo/b.jpg", "Docs/c.bin"} and files["Photo/b.jpg"].source == "My backup"
    before = {n: library.read(n).count() for n in ("files", "contents", "occurrences", "backups", "devices", "objects")}
    second = run_consolidation(library, inv, run_token="2", **args).first()
    assert (second.copied_files, second.duplicate_files, second.occurrences_recorded) == (0, 3, 3)
    assert {n: library.read(n).count() for n in before} == before
    entries = [r.action for r in library.read("import_run_entries").collect()]
    assert entries.count("copied") == 2 and entries.count("duplicate") == 4
    assert library.read("import_runs").count() == 2 and library.read("devices").first().label == "Unknown device"
    assert {r.status for r in library.read("import_runs").collect()} == {"completed"}
    kept = {(r.hash, r.n_bytes, r.intact) for r in O.read_back(library.read("objects")).collect()}
    assert kept == {(hashlib.sha256(d).hexdigest(), len(d), True) for _, d, _ in (A, C_)}


def test_observed_counters_are_the_summary(spark, tmp_path):
    inv = inventory(spark, "/src", [A, B_, C_, ("Docs/d.bin", b"", 4), ("Docs/e.bin", b"", 5)])
    library = Library(spark, str(tmp_path / "lib"), buckets=2)
    elsewhere = I.describe(inventory(spark, "/pc", [("x/f.jpg", A[1], 1)]))
    library.upsert_index(elsewhere)
    empty = library.read("contents")
    expected = C.run_summary(inv, empty, C.indexed_outside(library.read("files"), "/dest")).first().asDict()
    done = run_consolidation(library, inv, run_token="1", store=None, **RUN).first().asDict()
    assert done == expected and done["already_on_computer"] == 1
    nothing = run_consolidation(library, inv.limit(0), run_token="2", store=None, **RUN).first()
    assert (nothing.total_files, nothing.copied_bytes) == (0, 0)
    assert library.read("import_runs").count() == 2


def test_a_run_that_dies_stands_as_running_and_is_mended(spark, tmp_path, monkeypatch):
    library = Library(spark, str(tmp_path / "lib"), buckets=2)
    inv = inventory(spark, "/src", [A, B_, C_])
    with monkeypatch.context() as broken:
        broken.setattr(stored_library.C, "imported_index", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run_consolidation(library, inv, run_token="1", store=O.from_table(inv), **RUN)
    run = library.read("import_runs").first()
    assert (run.status, run.finished_at) == ("running", None) and library.read("contents").count() == 2
    again = run_consolidation(library, inv, run_token="1", store=O.from_table(inv), **RUN).first()
    assert (again.copied_files, again.duplicate_files) == (2, 1)
    assert library.read("contents").count() == 2 and library.stored("contents").count() == 2 and library.read("import_run_entries").count() == 3
    done = library.read("import_runs").first()
    assert done.status == "completed" and done.started_at >= run.started_at and done.finished_at >= done.started_at
    assert library.read("files").count() == 2


def test_index_reads_prune_and_upserts_touch_their_partitions(spark, tmp_path):
    library = Library(spark, str(tmp_path / "lib"), buckets=4)
    rows = [(f"{c}/{i}.{e}", b"x", 1) for c, e in (("Photo/a", "jpg"), ("Video/a", "mp4"), ("Music/a", "mp3")) for i in range(12)]
    library.upsert_index(I.describe(inventory(spark, "/r", rows)))
    plan = library.read("files").filter("category = 'photo'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(category" in plan and "(category#" in plan.split("PartitionFilters")[1][:200]

    def stamps():
        found = {}
        for path in sorted((tmp_path / "lib" / "files").rglob("*.parquet")):
            found.setdefault(str(path.parent), []).append(path.name)
        return found

    before, ids = stamps(), {r.absolute_path: r.id for r in library.read("files").collect()}
    assert sorted(ids.values()) == list(range(1, 37))
    changed = I.describe(inventory(spark, "/r", [("Photo/a/3.jpg", b"yy", 2), ("Photo/a/new.jpg", b"z", 2)]))
    library.upsert_index(changed)
    after = stamps()
    moved = {k for k in after if after[k] != before.get(k)}
    assert 1 <= len(moved) <= 2 and all("category=photo" in m for m in moved)
    now = {r.absolute_path: r for r in library.read("files").collect()}
    assert len(now) == 37 and now["/r/Photo/a/3.jpg"].size_bytes == 2 and now["/r/Photo/a/new.jpg"].id == 37
    assert {p: r.id for p, r in now.items() if p in ids} == ids


def test_paths_change_category_and_leave_the_index(spark, tmp_path):
    library = Library(spark, str(tmp_path / "lib"), buckets=1)
    library.upsert_index(I.describe(inventory(spark, "/r", [("a.jpg", b"1", 1), ("b.mp4", b"2", 1)])))
    ids = {r.absolute_path: r.id for r in library.read("files").collect()}
    video = inventory(spark, "/r", [("a.jpg", b"1", 1)]).withColumns({"category": F.lit("video"), "source": F.lit("s")})
    library.upsert_index(video)
    got = {r.absolute_path: (r.category, r.id) for r in library.read("files").collect()}
    assert got == {p: ("video", i) for p, i in ids.items()}
    library.upsert_index(video.withColumn("category", F.lit("photo")))
    assert {r.absolute_path: r.category for r in library.read("files").collect()} == {"/r/a.jpg": "photo", "/r/b.mp4": "video"}
    gone = spark.createDataFrame([("/r/a.jpg",), ("/r/none",)], "absolute_path string")
    library.remove_index(gone)
    assert [r.absolute_path for r in library.read("files").collect()] == ["/r/b.mp4"]
    library.remove_index(gone)
    library.upsert_index(I.describe(inventory(spark, "/r", [("a.jpg", b"1", 1)])))
    assert {r.absolute_path: r.id for r in library.read("files").collect()} == {"/r/b.mp4": ids["/r/b.mp4"], "/r/a.jpg": 3}


def test_number_rows(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("x"))
    got = [(r.x, r.n) for r in number_rows(rows, ["x"], 10, "n").collect()]
    assert sorted(got) == [(i, i + 10) for i in range(5000)]
    assert number_rows(rows.limit(0), ["x"], 1, "n").count() == 0


def test_index_job_is_idempotent(spark, tmp_path):
    library = Library(spark, str(tmp_path / "lib"), buckets=4)
    inv = inventory(spark, "/r", [A, C_])
    hasher = I.hash_from_table(inv.select("absolute_path", "content"))
    plain = inv.drop("content", "content_hash")
    run_index(library, plain, hasher)
    once = {tuple(r) for r in library.read("files").drop("indexed_at").select("id", "absolute_path", "content_hash").collect()}
    run_index(library, plain, hasher)
    assert {tuple(r) for r in library.read("files").select("id", "absolute_path", "content_hash").collect()} == once
    assert library.read("scan_runs").count() == 2 and all(i is not None for i, _, _ in once)


def test_paths_that_a_table_repeats_are_indexed_once(spark, tmp_path):
    inv = inventory(spark, "/r", [("a.txt", b"one", 1), ("b.txt", b"two", 2)])
    twice = inv.select("absolute_path", "content").unionAll(inv.select("absolute_path", "content"))
    library = Library(spark, str(tmp_path / "lib"))
    run_index(library, inv.drop("content_hash", "content"), I.hash_from_table(twice))
    assert sorted(r.content_hash for r in library.read("files").collect()) == sorted(r.content_hash for r in inv.collect())


def test_objects_of_one_chunk_are_read_back_without_a_shuffle_of_bytes(spark):
    """Only names, sizes and verdicts leave the scan, and no Python worker sees the bytes."""
    rows = [(hashlib.sha256(d).hexdigest(), 0, d) for d in (b"", b"one", b"three")] + [("torn", 0, b"x")]
    objects = spark.createDataFrame(rows, "hash string, chunk long, data binary")
    found = O.read_back(objects)
    assert {tuple(r) for r in found.collect()} == {(h, len(d), h != "torn") for h, _, d in rows}
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_objects_in_chunks(spark, tmp_path):
    sizes = {"empty": 0, "one": 5, "full": 4096, "more": 4097, "big": 300_001}
    data = {n: bytes(i * 31 % 251 for i in range(size)) for n, size in sizes.items()}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    rows = [(str(tmp_path / n), hashlib.sha256(c).hexdigest(), len(c), c) for n, c in data.items()]
    wanted = spark.createDataFrame(rows, "absolute_path string, content_hash string, size_bytes long, content binary")
    library = Library(spark, str(tmp_path / "lib"))
    expected = {(h, n, True) for _, h, n, _ in rows}
    for run, found in (("1", O.from_files(wanted, 4096)), ("2", O.from_table(wanted, chunk_bytes=4096)(wanted))):
        library.replace("objects", O.sharded(found, run))
        mine = library.read("objects").filter(F.col("run_id") == run)
        assert mine.count() == 1 + 1 + 1 + 2 + 74 and mine.agg(F.max(F.octet_length("data"))).first()[0] == 4096
        assert {tuple(r) for r in O.read_back(mine).collect()} == expected
    assert {tuple(r) for r in O.read_back(library.read("objects")).collect()} == expected  # stored by two runs
    assert all(r.shard == r.hash[:2] for r in library.read("objects").collect())
    torn = library.read("objects").filter("run_id = '1' AND chunk <> 3")
    assert {r.hash for r in O.read_back(torn).collect() if not r.intact} == {hashlib.sha256(data["big"]).hexdigest()}
    with pytest.raises(Exception, match="changed while it was stored"):
        O.from_files(wanted.withColumn("size_bytes", F.col("size_bytes") + 1), 4096).collect()


def test_coverage_with_orphans_and_empty_backups(spark):
    backups = spark.createDataFrame([("b1", "B1", "/1", 1), ("b2", "B2", "/2", 2), ("b3", "B3", "/3", 3)], "id string, label string, source_path string, imported_at long")
    occ = spark.createDataFrame([("h1", "b1"), ("h1", "b1"), ("hx", "b1"), ("h1", "b2")], "content_hash string, backup_id string")
    contents = spark.createDataFrame([("h1", 10, "/p")], "hash string, size_bytes long, storage_path string")
    rows = C.newest_first(C.backup_coverage(backups, occ, contents)).collect()
    assert [(r.backup_id, r.total_files, r.covered_files, r.total_bytes, r.reclaimable_bytes, r.safe_to_delete) for r in rows] == [
        ("b3", 0, 0, 0, 0, False), ("b2", 1, 1, 10, 10, True), ("b1", 3, 2, 20, 0, False)]
    assert rows[0].coverage_percent == 0.0 and round(rows[2].coverage_percent, 6) == 66.666667


def test_already_elsewhere(spark):
    same = bytes([7, 7, 7, 7])
    files = indexed(spark, [("x/f.bin", same, 1)], "/elsewhere")
    outside = C.indexed_outside(files, "/dest")
    empty = spark.createDataFrame([], "hash string")
    plan = C.plan_consolidation(inventory(spark, "/src", [("f.bin", same, 1)]), empty, outside).first()
    assert (plan.new_files, plan.already_on_computer) == (1, 1)
    assert C.indexed_outside(indexed(spark, [("x/f.bin", same, 1)], "/dest"), "/dest").count() == 0
    assert C.indexed_outside(indexed(spark, [("x/f.bin", same, 1)], "/destination"), "/dest").count() == 1


def sync_inventory(spark, rows):
    return spark.createDataFrame(
        [("b", f"/s/{rel}", rel, size) for rel, size in rows], "backup_id string, absolute_path string, relative_path string, size_bytes long"
    )


def test_sync(spark):
    source = sync_inventory(spark, [("Photo/DCIM/a.jpg", 3), ("Music/b.mp3", 5), ("Music/c.mp3", 6), ("Other/x", 1)])
    wanted = spark.createDataFrame([("Photo",), ("Music",), ("Video",), ("Games",)], "category string")
    verdicts = Y.requested_verdicts(wanted, source, "/s")
    assert {r.category: r.error for r in verdicts.collect()} == {
        "Photo": None, "Music": None, "Video": "Missing category folder: /s/Video", "Games": "Unsupported category: Games"}
    target = sync_inventory(spark, [("Music/c.mp3", 9)])
    actions = Y.sync_actions(source, target, verdicts, "/d")
    total = Y.sync_summary(actions, verdicts).first()
    assert (total.copied_files, total.skipped_files, total.copied_bytes, total.skipped_bytes, total.file_errors, total.category_errors) == (2, 1, 8, 6, 1, 2)
    assert "Skipped existing file with different size: /d/Music/c.mp3" in {r.error for r in Y.sync_errors(actions, verdicts).collect()}
    again = Y.sync_summary(Y.sync_actions(source, source, verdicts, "/d"), verdicts).first()
    assert (again.copied_files, again.skipped_files, again.file_errors) == (0, 3, 0)
    scan = {r.name: (r.file_count, r.total_bytes, r.n_sub_sources) for r in Y.category_scan(source).collect()}
    assert scan == {"Photo": (1, 3, 1), "Music": (2, 11, 0)}
    assert [(r.name, r.sub_source) for r in Y.sub_sources(source).collect()] == [("Photo", "DCIM")]


def test_sync_empty_folders(spark):
    folders = sync_inventory(spark, [("Video", 0), ("Music/old", 0)]).withColumn("is_dir", F.lit(True))
    source = sync_inventory(spark, [("Music/b.mp3", 5)]).withColumn("is_dir", F.lit(False)).unionByName(folders)
    verdicts = Y.requested_verdicts(spark.createDataFrame([("Video",), ("Photo",)], "category string"), source, "/s")
    assert {r.category: r.verdict for r in verdicts.collect()} == {"Video": "ok", "Photo": "missing"}
    scan = {r.name: (r.file_count, r.total_bytes, r.n_sub_sources) for r in Y.category_scan(source).collect()}
    assert scan == {"Video": (0, 0, 0), "Music": (1, 5, 1)}
    assert [(r.name, r.sub_source) for r in Y.sub_sources(source).collect()] == [("Music", "old")]
    music = spark.createDataFrame([("Music", "ok", None)], "category string, verdict string, error string")
    assert [r.inner_path for r in Y.sync_actions(source, source, music, "/d").collect()] == ["b.mp3"]


def test_media_mapping(spark):
    frame = spark.createDataFrame([("WhatsApp Audio",), ("WhatsApp Voice Notes",), ("Photo",)], "folder string")
    assert {r.folder: r.destination for r in Y.media_mapping(frame, "folder").collect()} == {
        "WhatsApp Audio": "Music", "WhatsApp Voice Notes": "Music", "Photo": "Photo"}


def test_sub_source_label_shows_six(spark):
    names = spark.createDataFrame([("b", "Photo", f"s{i}") for i in range(9)], "backup_id string, name string, sub_source string")
    assert Y.top_sub_sources(names).first().sub_source_label == "s0, s1, s2, s3, s4, s5"


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_prefix_sum(spark, block):
    frame = spark.createDataFrame([(g, i * 2, i) for g in "ab" for i in range(10)], "g string, p long, v long")
    got = {(r.g, r.p): r.o for r in prefix_sum(frame, ["g"], "p", "v", "o", block).collect()}
    assert got == {(g, i * 2): sum(range(i)) for g in "ab" for i in range(10)}


@pytest.mark.parametrize("heavy", [1, 5, 100])
def test_lookup_join_is_a_join(spark, heavy):
    big = spark.createDataFrame([(k, i) for i, k in enumerate("aaaaaaabbc")], "k string, i long")
    small = big.groupBy("k").agg(F.count("*").alias("n")).filter("k <> 'c'")
    assert sorted((r.k, r.i, r.n) for r in lookup_join(big, small, "k", "n", heavy).collect()) == sorted(
        [("a", i, 7) for i in range(7)] + [("b", i, 2) for i in (7, 8)])


def test_heavy_members_are_spread_over_partitions(spark):
    """All members of a heavy key must not end up in one shuffle partition."""
    big = spark.range(0, 4000, 1, 4).select((F.col("id") % 4000 >= 1000).alias("hot"), "id").select(
        F.when(F.col("hot"), F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id"
    )
    small = big.groupBy("k").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = lookup_join(big, small, "k", "n", heavy_rows=1000)
        sizes = [r["count"] for r in joined.filter("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 3000 and len(sizes) == 4 and max(sizes) < 1200
        plain = big.join(small, "k").filter("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
        assert len(plain) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
