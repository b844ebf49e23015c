"""A user's session: index, browse, deduplicate, consolidate, purge."""

import hashlib

from pyspark.sql import functions as F

from mementa.operators import duplicates as D
from mementa.operators import index as I
from mementa.plans.commands import Commands
from mementa.plans.library import Library
from mementa.sources import images, inventory, objects
from test_sources import png


def test_session(spark, tmp_path):
    root = tmp_path / "pics"
    (root / "Photo" / "DCIM").mkdir(parents=True)
    across = [[x * 14 for x in range(16)] for _ in range(16)]
    png(root / "Photo" / "DCIM" / "a.png", across)
    png(root / "Photo" / "DCIM" / "b.png", [[v + 3 for v in row] for row in across])
    png(root / "Photo" / "DCIM" / "c.png", across)
    (root / "notes.txt").write_bytes(b"hello")
    commands = Commands(spark, Library(spark, str(tmp_path / "library")))
    found = inventory.walk(spark.createDataFrame([(str(root),)], "root_path string"), 2)
    signed = []

    def signer(wanted):
        signed.append(wanted.count())
        return images.signer(spark, str(root))(wanted)

    summary = commands.index_multimedia(found, inventory.hash_files, signer).first()
    assert summary.scanned_files == 4
    commands.index_multimedia(found, inventory.hash_files, signer)
    assert signed == [3, 0]  # the second scan reuses all signatures
    assert {r.category: r.n_files for r in commands.category_metrics().collect()} == {
        "photo": 3, "video": 0, "music": 0, "documents": 1}
    assert commands.list_indexed_files("photo").count() == 3
    groups = commands.find_duplicate_files().collect()
    assert len(groups) == 1 and groups[0].n_files == 2
    assert commands.duplicate_files("photo").count() == 2
    look = commands.find_similar_photos().collect()
    assert len(look) == 1 and look[0].n_files == 3 and commands.similar_photos().count() == 3

    hashed = I.describe(found).join(inventory.hash_files_strict(found), "absolute_path")
    assert commands.plan_consolidation(hashed, "/dest").first().already_on_computer == 4
    done = commands.run_consolidation(
        hashed, adapter="generic-folder", label="Pics", source_path=str(root), destination="/dest", run_token="t"
    ).first()
    assert (done.copied_files, done.duplicate_files) == (3, 1)
    assert [r.intact for r in objects.read_back(commands.library.read("objects")).collect()] == [True] * 3
    assert commands.backup_coverage().first().safe_to_delete

    stored = commands.library.read("contents").first().storage_path
    target = str(root / "notes.txt")
    requests = spark.createDataFrame([(target,), (stored,), ("/gone",)], "absolute_path string")
    verdicts = commands.purge(requests, found, ["/home/me/.app"])
    assert {r.verdict for r in verdicts.collect()} == {"eligible", "refused", "missing"}
    left = {r.absolute_path for r in commands.library.read("files").collect()}
    assert target not in left and stored in left
    assert D.purge_summary(verdicts, hashed).first().removed_from_index == 1
    assert hashlib.sha256(b"hello").hexdigest() in {r.hash for r in commands.library.read("contents").collect()}


def test_scans_read_what_the_index_lacks(spark, tmp_path):
    commands = Commands(spark, Library(spark, str(tmp_path / "library")))
    rows = [("/r", f"/r/{n}.png", f"{n}.png", 2, 1, "png", d) for n, d in (("a", b"xx"), ("b", b"xx"), ("c", b"yy"))]
    inv = spark.createDataFrame(rows, "root_path string, absolute_path string, relative_path string, size_bytes long, modified_unix long, extension string, content binary")
    nothing = inv.limit(0).select("absolute_path", F.lit("").alias("content_hash"))
    commands.index_multimedia(inv.drop("content"), lambda wanted: nothing)
    assert commands.find_duplicate_files(hasher=lambda wanted: nothing).count() == 0
    assert commands.find_duplicate_files(hasher=I.hash_from_table(inv)).first().n_files == 2
    summary = commands.duplicate_summary().first()
    assert (summary.total_groups, summary.reclaimable_bytes, summary.scanned_candidates) == (1, 2, 3)
    signer = lambda wanted: wanted.select("absolute_path", F.lit(9).alias("aspect_q"), F.array(*[F.lit(7).cast("long")] * 4).alias("sig"))
    assert commands.find_similar_photos().count() == 0
    assert commands.find_similar_photos(signer).first().n_files == 3


def test_scans_read_missing_hashes_by_default(spark, tmp_path):
    """The bytes are read from the file system unless the caller brings a reader."""
    root = tmp_path / "pics"
    root.mkdir()
    across = [[x * 14 for x in range(16)] for _ in range(16)]
    png(root / "a.png", across)
    png(root / "b.png", across)
    (root / "c.txt").write_bytes(b"c")
    commands = Commands(spark, Library(spark, str(tmp_path / "library"), buckets=2))
    found = inventory.walk(spark.createDataFrame([(str(root),)], "root_path string"), 2)
    nothing = spark.createDataFrame([], "absolute_path string, content_hash string")
    commands.index_multimedia(found, lambda wanted: nothing)
    assert commands.library.read("files").filter("content_hash IS NOT NULL").isEmpty()
    assert [g.n_files for g in commands.find_duplicate_files().collect()] == [2]
    assert commands.library.read("files").filter("content_hash IS NOT NULL").count() == 2
    assert [g.n_files for g in commands.find_similar_photos().collect()] == [2]


def test_roots_with_all_outcomes(spark, tmp_path):
    for name in ("full/Photo", "empty", "hollow/inner"):
        (tmp_path / name).mkdir(parents=True)
    (tmp_path / "full" / "Photo" / "a.jpg").write_bytes(b"abc")
    names = ["full", "empty", "hollow", "missing"]
    roots = spark.createDataFrame([(str(tmp_path / n),) for n in names], "root_path string")
    commands = Commands(spark, Library(spark, str(tmp_path / "library"), buckets=2))
    got = {r.root_path.rsplit("/", 1)[1]: (r.outcome, r.scanned_files, r.indexed_files, r.total_bytes) for r in commands.index_folders(roots).collect()}
    assert got == {"full": ("listed", 1, 1, 3), "empty": ("empty", 0, 0, 0), "hollow": ("listed", 0, 0, 0), "missing": ("missing", 0, 0, 0)}
    runs = {r.root_path.rsplit("/", 1)[1]: r.scanned_files for r in commands.library.read("scan_runs").collect()}
    assert runs == {"full": 1, "empty": 0, "hollow": 0}
    assert commands.library.read("files").count() == 1


def test_small_commands(spark):
    commands = Commands(spark, None)
    assert commands.adapter_registry().count() == 4
    sources = spark.createDataFrame([("1", "adb-generic", None)], "id string, adapter string, path string")
    assert commands.scan_sources(sources).first().adapter_label == "Android device (ADB)"
    inv = spark.createDataFrame([("b", "/s/Photo/DCIM/a", "Photo/DCIM/a", 3)], "backup_id string, absolute_path string, relative_path string, size_bytes long")
    assert commands.scan_categories(inv).first().file_count == 1
    actions, verdicts = commands.run_sync(inv, inv.limit(0), spark.createDataFrame([("Photo",)], "category string"), "/s", "/d")
    assert actions.first().action == "copied" and verdicts.first().error is None


def test_signature_backfill(spark):
    rows = [("/a.png", "photo", "png", None, None), ("/b.png", "photo", "png", 5, [1, 2, 3, 4]), ("/c.svg", "photo", "svg", None, None), ("/d.png", "other", "png", None, None)]
    files = spark.createDataFrame(rows, "absolute_path string, category string, extension string, aspect_q int, sig array<long>")

    def signer(wanted):
        return wanted.select("absolute_path", F.lit(9).alias("aspect_q"), F.array(*[F.lit(7).cast("long")] * 4).alias("sig"))

    got = {r.absolute_path: (r.aspect_q, r.sig) for r in I.backfill_signatures(files, signer).collect()}
    assert got == {"/a.png": (9, [7] * 4), "/b.png": (5, [1, 2, 3, 4]), "/c.svg": (None, None), "/d.png": (None, None)}
