"""Loaders: folder walk, hashing, payload files, images, registry and streams."""

import hashlib
import os
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from mementa.functions import signature as S
from mementa.operators import index as I
from mementa.operators import inventories as V
from mementa.operators import similarity as M
from mementa.plans.library import Library
from mementa.sources import images, inventory, payloads, registry
from mementa.streaming import ingest


def png(path, pixels):
    """Write a grey PNG with the standard library."""
    height, width = len(pixels), len(pixels[0])
    raw = b"".join(b"\0" + bytes(row) for row in pixels)

    def chunk(kind, data):
        body = kind + data
        return len(data).to_bytes(4, "big") + body + zlib.crc32(body).to_bytes(4, "big")

    header = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_walk_keeps_hidden_and_empty_files(spark, tmp_path):
    (tmp_path / "Photo" / "DCIM").mkdir(parents=True)
    (tmp_path / "Photo" / "DCIM" / "a.JPG").write_bytes(b"abc")
    (tmp_path / ".hidden").write_bytes(b"")
    (tmp_path / "_under.txt").write_bytes(b"x")
    os.symlink(tmp_path / "_under.txt", tmp_path / "link.txt")
    old = tmp_path / "old.bin"
    old.write_bytes(b"o")
    os.utime(old, (-5, -5))
    found = inventory.walk(spark.createDataFrame([(str(tmp_path),)], "root_path string"), 4)
    rows = {r.relative_path: r for r in found.collect()}
    assert set(rows) == {"Photo/DCIM/a.JPG", ".hidden", "_under.txt", "old.bin"}
    both = inventory.walk(spark.createDataFrame([(str(tmp_path),)], "root_path string"), 4, folders=True)
    assert {r.relative_path for r in both.collect() if r.is_dir} == {"Photo", "Photo/DCIM"}
    assert (rows["Photo/DCIM/a.JPG"].extension, rows["Photo/DCIM/a.JPG"].size_bytes) == ("jpg", 3)
    assert rows[".hidden"].extension is None and rows["old.bin"].modified_unix is None
    assert rows["_under.txt"].modified_unix == int((tmp_path / "_under.txt").stat().st_mtime)
    simple = inventory.binary_files(spark, str(tmp_path), with_content=True)
    assert "Photo/DCIM/a.JPG" in {r.relative_path for r in inventory.hashed_content(simple).collect()}


def test_walk_goes_on_beside_bad_roots(spark, tmp_path):
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "a").write_bytes(b"x")
    (tmp_path / "file").write_bytes(b"x")
    roots = spark.createDataFrame([(str(tmp_path / n),) for n in ("none", "good", "file")], "root_path string")
    scan = inventory.walk_roots(roots, 2)
    assert {os.path.basename(r.root_path): (r.outcome, r.failed_folders) for r in scan.outcomes.collect()} == {
        "none": ("missing", 0), "good": ("listed", 0), "file": ("failed", 0)}
    assert [r.relative_path for r in scan.files.collect()] == ["a"] and scan.folders.count() == 0


def test_walk_tells_of_folders_that_cannot_be_listed(spark, tmp_path):
    assert list(inventory._entries("/r", str(tmp_path / "gone"))) == [("/r", str(tmp_path / "gone"), None, None, None, "missing")]
    (tmp_path / "f").write_bytes(b"")
    assert [r[5] for r in inventory._entries("/r", str(tmp_path / "f"))] == ["Not a directory"]


def test_chunked_hash(spark, tmp_path):
    data = bytes([0x5A]) * (1024 * 1024 + 123)
    (tmp_path / "big").write_bytes(data)
    paths = spark.createDataFrame([(str(tmp_path / "big"),), (str(tmp_path / "gone"),)], "absolute_path string")
    assert [tuple(r) for r in inventory.hash_files(paths).collect()] == [(str(tmp_path / "big"), hashlib.sha256(data).hexdigest())]
    with pytest.raises(Exception, match="cannot read"):
        inventory.hash_files_strict(paths).collect()


def test_text_and_archives(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("one\r\ntwo\n")
    (tmp_path / "t" / "b.txt").write_text("x")
    whole = {os.path.basename(r.source_path): r.text for r in payloads.whole_text(spark, str(tmp_path / "t")).collect()}
    assert whole == {"a.txt": "one\r\ntwo\n", "b.txt": "x"}
    assert [r.line for r in payloads.text_lines(spark, str(tmp_path / "t")).filter("source_path LIKE '%a.txt'").orderBy("line_no").collect()] == ["one", "two", ""]
    logs = payloads.listing_logs(spark, str(tmp_path / "t")).select("device", "folder").distinct().collect()
    assert {tuple(r) for r in logs} == {("t", "a"), ("t", "b")}
    (tmp_path / "z").mkdir()
    with zipfile.ZipFile(tmp_path / "z" / "c.zip", "w") as archive:
        archive.writestr("a/call_log.exml", "<?xml version='1.0'?>")
        archive.writestr("b.json.enc", bytes(300))
    entries = payloads.archive_entries(spark, str(tmp_path / "z"), with_content=True)
    rows = sorted(entries.collect(), key=lambda r: r.entry_index)
    assert [(r.entry_name, len(r.head), len(r.content)) for r in rows] == [("a/call_log.exml", 21, 21), ("b.json.enc", 128, 300)]
    counted = V.archive_inventory(entries.select(F.lit("b").alias("backup_id"), F.lit("l").alias("backup_label"), F.lit("CALLLOG").alias("item_type"), "*"))
    assert counted.first().parse_status == "xml_readable"


def test_archives_in_ranges(spark, tmp_path, monkeypatch):
    """Listing reads the directory and the heads only; bad and empty archives have a status."""
    import io

    with zipfile.ZipFile(tmp_path / "good.zip", "w") as archive:
        archive.writestr("big.bin", os.urandom(3_000_000))
        archive.writestr(zipfile.ZipInfo("dir/"), b"")
        archive.writestr("call_log.exml", b"<?xml" + b" " * 500_000, compress_type=zipfile.ZIP_DEFLATED)
        archive.writestr("é.txt", b"")
        archive.comment = b"PK\x05\x06 a comment"[4:] * 10
    with zipfile.ZipFile(tmp_path / "empty.zip", "w"):
        pass
    whole = (tmp_path / "good.zip").read_bytes()
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    (tmp_path / "zero.zip").write_bytes(b"")
    (tmp_path / "torn.zip").write_bytes(whole[:1000])
    found = payloads.scan_archives(payloads.archive_paths(spark, str(tmp_path)))
    status = {os.path.basename(r.archive_path): r.status for r in found.status.collect()}
    # Spark's sources leave out empty files
    assert status == {"good.zip": "listed", "empty.zip": "empty", "bad.zip": "unreadable", "torn.zip": "unreadable"}
    rows = sorted(found.entries.collect(), key=lambda r: r.entry_index)
    assert [(r.entry_name, len(r.head)) for r in rows] == [("big.bin", 128), ("dir/", 0), ("call_log.exml", 128), ("é.txt", 0)]
    full = {r.entry_name: bytes(r.content) for r in payloads.archive_entries(spark, str(tmp_path), with_content=True).collect()}
    with zipfile.ZipFile(tmp_path / "good.zip") as archive:
        assert full == {i.filename: archive.read(i) for i in archive.infolist()}
    read = []

    class Counting(io.FileIO):
        def read(self, n=-1):
            data = super().read(n)
            read.append(len(data))
            return data

    monkeypatch.setattr("builtins.open", lambda p, m: Counting(p, "r"))
    assert len(list(payloads._scan(str(tmp_path / "good.zip"), False))) == 5 and sum(read) < 90_000
    monkeypatch.undo()
    keys = ("b", "l", "CALLLOG")
    archives = spark.createDataFrame([(*keys, str(tmp_path / f"{n}.zip")) for n in ("good", "empty", "bad")], "backup_id string, backup_label string, item_type string, archive_path string")
    counted = V.archive_inventory(found.entries.join(archives, "archive_path"))
    every = {os.path.basename(r.archive_path): (r.entry_count, r.parse_status) for r in V.with_unlisted(counted, archives, found.status).collect()}
    assert every == {"good.zip": (4, "xml_readable"), "empty.zip": (0, "inventory_only"), "bad.zip": (0, "unreadable")}


def test_archives_of_64_bits(tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as archive:
        for i in range(70_000):
            archive.writestr(zipfile.ZipInfo(f"{i}"), b"")
    rows = list(payloads._scan(str(tmp_path / "many.zip"), False))
    assert len(rows) == 70_001 and rows[-1][5] == "listed" and rows[69_999][2] == "69999"
    with zipfile.ZipFile(tmp_path / "forced.zip", "w") as archive:
        with archive.open("x", "w", force_zip64=True) as entry:
            entry.write(b"12345")
    assert [r[4] for r in payloads._scan(str(tmp_path / "forced.zip"), True)] == [b"12345", None]


def test_message_tables(spark):
    assert payloads.messages(spark, "no_such_table").count() == 0 and payloads.optional_table(spark, "no_such_table") is None
    spark.createDataFrame([("j", "hi", 1)], "key_remote_jid string, data string, timestamp long").createOrReplaceTempView("some_messages")
    assert payloads.messages(spark, "some_messages").first().data == "hi"


def test_images_group_by_look(spark, tmp_path):
    across = [[x * 14 for x in range(16)] for _ in range(16)]
    png(tmp_path / "a.png", across)
    png(tmp_path / "b.png", [[v + 3 for v in row] for row in across])
    png(tmp_path / "c.png", [[y * 14] * 16 for y in range(16)])
    png(tmp_path / "flat.png", [[90] * 16 for _ in range(16)])
    (tmp_path / "bad.png").write_bytes(b"not an image")
    signed = images.with_signature(images.luma_grids(images.decoded(spark, str(tmp_path))))
    rows = {os.path.basename(r.absolute_path): r for r in signed.collect()}
    assert set(rows) == {"a.png", "b.png", "c.png", "flat.png"} and rows["flat.png"].sig is None
    assert rows["a.png"].aspect_q == 127 and len(rows["a.png"].luma) == S.GRID_WIDTH * S.GRID_HEIGHT
    photos = signed.select(F.ascii(F.substring(F.substring_index("absolute_path", "/", -1), 1, 1)).cast("long").alias("id"), F.lit(1).cast("long").alias("size_bytes"), "aspect_q", "sig")
    groups = M.similar_groups(M.similar_members(photos)).collect()
    assert [(g.n_files, g.group_key) for g in groups] == [(2, f"sim-{ord('a')}")]


def _files_read(spark):
    """Files that the scans of the last query opened."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    every = store.executionsList()
    last = max((every.apply(i) for i in range(every.size())), key=lambda e: e.executionId())
    values = dict(v.split(" -> ") for v in store.executionMetrics(last.executionId()).mkString("\n").split("\n") if " -> " in v)
    metrics = [last.metrics().apply(i) for i in range(last.metrics().size())]
    return sum(int(values[str(i)]) for i in {m.accumulatorId() for m in metrics if m.name() == "number of files read"})


def test_only_wanted_photos_are_decoded(spark, tmp_path):
    across = [[x * 14 for x in range(16)] for _ in range(16)]
    names = [f"p {i}+ä%41.png" for i in range(40)]
    for name in names:
        png(tmp_path / name, across)
    (tmp_path / "w.webp").write_bytes(b"RIFF")
    (tmp_path / "broken.png").write_bytes(b"no")
    png(tmp_path / "flat.png", [[90] * 16 for _ in range(16)])
    asked = [names[3], names[17], "w.webp", "broken.png", "flat.png", "gone.png"]
    wanted = spark.createDataFrame([(str(tmp_path / n),) for n in asked], "absolute_path string")
    found = images.decoded_only(wanted, str(tmp_path))
    assert {os.path.basename(r.absolute_path) for r in found.collect()} == {names[3], names[17], "flat.png"}
    assert _files_read(spark) == 5  # all that were asked for and exist, of more than 40
    status = {os.path.basename(r.absolute_path): r.status for r in images.photo_status(wanted).collect()}
    assert status == {names[3]: "signed", names[17]: "signed", "w.webp": "unsupported", "broken.png": "unreadable", "flat.png": "flat", "gone.png": "unreadable"}
    assert images.sign_files(wanted).count() == 3 and images.sign_files(wanted.limit(0)).count() == 0
    lost = spark.createDataFrame([("/no/such/folder/a.png",)], "absolute_path string")
    assert images.sign_files(lost).count() == 0


def test_triangle_weights_average_and_interpolate():
    halves = images.triangle_weights(4, 2)
    assert halves.shape == (2, 4) and abs(halves.sum(axis=1) - 1).max() < 1e-9
    assert (images.triangle_weights(5, 5) == __import__("numpy").eye(5)).all()


def test_registry_and_sources(spark):
    assert {r.adapter for r in registry.registry(spark).collect()} == {"adb-generic", "generic-folder", "samsung-smartswitch", "google-takeout"}
    sources = spark.createDataFrame([("1", "adb-generic", None, 1), ("2", "x", "/p", 2), ("1", "generic-folder", "", 3)], "id string, adapter string, path string, seq long")
    assert [r.adapter_label for r in registry.with_adapter_label(sources).orderBy("seq").collect()] == ["Android device (ADB)", "x", "Generic folder"]
    assert [(r.id, r.seq) for r in registry.latest_sources(sources).collect()] == [("1", 3), ("2", 2)]
    assert registry.with_path(sources).count() == 1 and registry.by_adapter(sources, "adb-generic").count() == 1
    assert registry.all_sources([sources, sources.drop("path")]).count() == 6
    totals = I.library_totals(spark.createDataFrame([("photo", 5), ("other", 9)], "category string, size_bytes long"), sources).first()
    assert (totals.n_files, totals.n_bytes, totals.n_sources, totals.n_phones, totals.n_backups) == (1, 5, 3, 1, 1)


def _arrive(spark, folder, number, rows):
    data = [("/r", f"/r/{p}", p, len(c), t, "txt", hashlib.sha256(c).hexdigest()) for p, c, t in rows]
    schema = ingest_schema() + ", content_hash string"
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{number}")


def ingest_schema():
    return "root_path string, absolute_path string, relative_path string, size_bytes long, modified_unix long, extension string"


def test_stream_dedup_over_batches_and_restart(spark, tmp_path):
    arriving, library = str(tmp_path / "in"), Library(spark, str(tmp_path / "lib"))

    def run():
        stream = spark.readStream.schema(ingest_schema() + ", content_hash string").option("recursiveFileLookup", True).parquet(arriving)
        ingest.dedup_ingest(stream, library, "/dest", str(tmp_path / "ck")).awaitTermination()

    _arrive(spark, arriving, 1, [("a", b"x", 1), ("b", b"x", 1), ("c", b"y", 1)])
    run()
    _arrive(spark, arriving, 2, [("d", b"y", 1), ("e", b"z", 1)])
    run()
    run()
    got = {r.original_path: r.action for r in library.read("import_run_entries").collect()}
    assert got == {"a": "copied", "b": "duplicate", "c": "copied", "d": "duplicate", "e": "copied"}
    assert library.read("contents").count() == 3


def test_a_file_without_hash_does_not_stop_a_stream(spark, tmp_path):
    arriving, library = str(tmp_path / "in"), Library(spark, str(tmp_path / "lib"))
    schema = ingest_schema() + ", content_hash string"
    rows = [("/r", "/r/a", "a", 1, 1, "txt", "aa"), ("/r", "/r/b", "b", 2, 1, "txt", None)]
    spark.createDataFrame(rows, schema).write.parquet(arriving)
    stream = spark.readStream.schema(schema).parquet(arriving)
    ingest.dedup_ingest(stream, library, "/dest", str(tmp_path / "ck")).awaitTermination()
    assert [(r.absolute_path, r.size_bytes) for r in library.read("unread_files").collect()] == [("/r/b", 2)]
    assert [r.original_path for r in library.read("import_run_entries").collect()] == ["a"]
    assert [r.status for r in library.read("import_runs").collect()] == ["completed"]


def test_a_replayed_batch_writes_the_same(spark, tmp_path):
    """The stream's progress is lost, its library is not: every row is there once, with the first actions."""
    arriving, library = str(tmp_path / "in"), Library(spark, str(tmp_path / "lib"))
    _arrive(spark, arriving, 1, [("a", b"x", 1), ("b", b"x", 1), ("c", b"y", 1)])
    for progress in ("ck1", "ck2"):
        stream = spark.readStream.schema(ingest_schema() + ", content_hash string").option("recursiveFileLookup", True).parquet(arriving)
        ingest.dedup_ingest(stream, library, "/dest", str(tmp_path / progress), stream_id="s").awaitTermination()
    assert sorted(r.action for r in library.read("import_run_entries").collect()) == ["copied", "copied", "duplicate"]
    assert library.stored("contents").count() == 2 and library.read("import_runs").count() == 1


def test_two_streams_share_a_library(spark, tmp_path):
    library = Library(spark, str(tmp_path / "lib"))
    for name, data in (("one", [("a", b"x", 1)]), ("two", [("b", b"x", 1), ("c", b"y", 1)])):
        arriving = str(tmp_path / name)
        _arrive(spark, arriving, 1, data)
        stream = spark.readStream.schema(ingest_schema() + ", content_hash string").option("recursiveFileLookup", True).parquet(arriving)
        ingest.dedup_ingest(stream, library, "/dest", str(tmp_path / f"ck-{name}")).awaitTermination()
    got = {r.original_path: r.action for r in library.read("import_run_entries").collect()}
    assert got == {"a": "copied", "b": "duplicate", "c": "copied"}


def test_stream_index_updates_changed_files(spark, tmp_path):
    arriving, library = str(tmp_path / "in"), Library(spark, str(tmp_path / "lib"))

    def hasher(wanted):
        return wanted.withColumn("content_hash", F.concat(F.lit("h-"), "absolute_path"))

    def run():
        stream = spark.readStream.schema(ingest_schema()).option("recursiveFileLookup", True).parquet(arriving)
        ingest.incremental_index(stream, library, hasher, str(tmp_path / "ck")).awaitTermination()

    _arrive(spark, arriving, 1, [("a", b"x", 1), ("a", b"xyz", 2), ("b", b"q", 1)])
    run()
    assert {r.relative_path: r.size_bytes for r in library.read("files").collect()} == {"a": 3, "b": 1}
    _arrive(spark, arriving, 2, [("b", b"qqqq", 9)])
    run()
    rows = {r.relative_path: r for r in library.read("files").collect()}
    assert rows["b"].size_bytes == 4 and rows["b"].content_hash == "h-/r/b" and rows["a"].size_bytes == 3
