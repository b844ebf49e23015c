"""Scalar functions against the documented cases and edge values."""

import math
import uuid

import pytest
from pyspark.sql import functions as F

from mementa.functions import paths as P
from mementa.functions import signature as S
from mementa.functions import text as X


def values(spark, function, inputs, type_="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {type_}")
    return [r.o for r in frame.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]


def test_extension(spark):
    given = ["a/b.JPG", "a.b/c", ".bashrc", "x/.hidden.txt", "a.", "..", "..a", "noext", "É.É"]
    assert values(spark, P.extension, given) == ["jpg", None, None, "txt", "", None, "a", None, "É"]


def test_classification_and_source(spark):
    frame = spark.createDataFrame(
        [(0, "a/x.jpg", "JPG"), (1, "x", "mp4"), (2, "x", "flac"), (3, "x", "pdf"), (4, "Photo/DCIM/file.bin", "bin"),
         (5, "a/b.apk", "apk"), (6, "Music", None), (7, "x/y", None), (8, "x", "ts"), (9, "x", "key"), (10, "Photos/x", "avif")],
        "i int, p string, e string",
    )
    got = [r.c for r in frame.select("i", P.classify("p", "e").alias("c")).orderBy("i").collect()]
    assert got == ["photo", "video", "music", "documents", "photo", "other", "music", "other", "video", "documents", "other"]
    assert values(spark, P.source_of, ["Photo/image.jpg", "Photo/DCIM/image.jpg", "a", "a/b/c/d"]) == [
        "local", "DCIM", "local", "b"]


def test_paths(spark):
    within = spark.createDataFrame(
        [("/lib/x", "/lib"), ("/library/x", "/lib"), ("/lib", "/lib/"), ("/a", "/")], "p string, r string"
    ).select(P.path_within("p", "r").alias("w"), P.relative_path("p", "r").alias("r")).collect()
    assert [r.w for r in within] == [True, False, True, True]
    assert [r.r for r in within] == ["x", "/library/x", "", "a"]
    assert values(spark, P.shorten_path, ["", None, "a/b", "/Users/x/Backups/Phone/DCIM", "C:\\a\\b\\c\\d", "/a//b/"]) == [
        "Not selected yet", "Not selected yet", "a/b", ".../Backups/Phone/DCIM", ".../b/c/d", "/a//b/"]
    assert values(spark, P.objects_root, ["/a/objects/b/objects/ab/h", "/objects", "objects/ab/h", "/a/myobjects/x"]) == [
        "/a/objects/b/objects", "/objects", "objects", None]
    assert values(spark, P.is_duplicate_named, ["a/DUPLICATE_x.jpg", "duplicate/x"]) == [True, False]
    assert values(spark, P.file_stem, ["a/example.apk", "App.v1.apk", "x"]) == ["example", "App.v1", "x"]


def test_uuid5_equals_the_standard(spark):
    names = ["generic-folder:/a", "SERIAL", "é", ""]
    assert values(spark, P.uuid5, names) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    assert values(spark, P.uuid5, ["SERIAL"]) != values(spark, P.uuid5, ["OTHER"])


def test_redaction_and_timestamp(spark):
    assert values(spark, P.redact, ["RFCT816LGQN", "abc", "  abcde ", "abcd"]) == [
        "[redacted:LGQN]", "[redacted]", "[redacted:bcde]", "[redacted]"]
    assert values(spark, P.backup_timestamp, ["SM-X000A_20250102030405", "x_2025", "20250102030405", "a_99999999999999"]) == [
        "2025-01-02T03:04:05", None, None, "9999-99-99T99:99:99"]


def test_message_database_names(spark):
    assert values(spark, P.is_message_db_file, ["MSGSTORE-1.db", "wa.db-wal", "x.crypt12", "crypt12", "wadb"]) == [
        True, True, True, False, False]
    assert values(spark, P.message_db_format, ["a.crypt15", "a.crypt14", "a.db"]) == ["crypt15", "crypt14", "unknown"]


def test_titles(spark):
    long = "x" * 200
    assert values(spark, X.first_line_title, ["\n \t\n My note \nBody", "", " \n ", "\u00a0a\u2003", long]) == [
        "My note", None, None, "a", "x" * 80]
    assert values(spark, X.title120, [long]) == ["x" * 120]


def test_markup(spark):
    assert values(spark, X.strip_html, ["<b>Hi</b> &amp; you <i", "a > b", " <x\ny>t</x> "]) == ["Hi &amp; you", "a  b", "t"]
    assert values(spark, X.href, ['<a href="u"', '<a HREF="v"', '<a HREF="v" href="u"', "<a href='x'", '<a href=""', '<a href="open', '<a HREF="v" href="']) == [
        "u", "v", "u", None, "", None, None]
    assert values(spark, X.json_region, ['xxxx{"name":"Ada"}yyyy', "[1]{}", "}{", "none"]) == [
        '{"name":"Ada"}', "[1]{}", None, None]
    assert values(spark, lambda c: X.xml_region(c, "R"), ["junk<?xml v?><R>a</R>tail", "<x><R/></x>z", "<R a>", "none"]) == [
        "<?xml v?><R>a</R>", "<R/></x>", "<R a>", None]
    assert values(spark, X.xml_unescape, ["a &quot;b&quot; &#65;&#x20AC;&amp;lt;", "&nope;", "a & b", "plain"]) == [
        'a "b" A€&lt;', None, None, "plain"]


def test_formats(spark):
    sizes = [0.0, math.nan, 512.0, 1024.0, 1.5 * 1024**2, 1280.0, 1024.0**4 * 5000, -3.0, math.inf, None]
    assert values(spark, X.format_bytes, sizes, "double") == [
        "0 B", "0 B", "512 B", "1.0 KB", "1.5 MB", "1.3 KB", "5000.0 TB", "0 B", "0 B", "0 B"]
    assert values(spark, X.format_count, [1234567, 0], "long") == ["1,234,567", "0"]
    assert values(spark, X.format_date, [1700000000, 0, None, -1], "long") == ["Nov 14, 2023", "—", "—", "Dec 31, 1969"]
    assert values(spark, X.category_label, ["photo", "other", "new"]) == ["Photos", "Other", "new"]
    assert values(spark, X.kib_to_bytes, ["12\t/x", "du: error", "", None, "9" * 20]) == [12288, 0, 0, 0, 2**63 - 1]


@pytest.mark.parametrize("w,h,expected", [(0, 5, 127), (100, 100, 127), (400, 100, 254), (1, 100, 0), (4, 3, None)])
def test_aspect(spark, w, h, expected):
    got = spark.createDataFrame([(w, h)], "w int, h int").select(S.aspect_q("w", "h").alias("a")).first().a
    if expected is None:
        expected = math.floor((math.log2(w / h) + 2) / 4 * 254 + 0.5)
    assert got == expected


def test_difference_hash(spark):
    import random

    rng = random.Random(7)
    grids = [[rng.randrange(256) for _ in range(272)] for _ in range(5)] + [[5] * 272, list(range(17)) * 16, [1, 2]]
    got = values(spark, S.dhash256, grids, "array<int>")
    for grid, words in zip(grids, got):
        if len(grid) != 272 or max(grid) - min(grid) < 10:
            assert words is None
            continue
        bits = [grid[r * 17 + c] < grid[r * 17 + c + 1] for r in range(16) for c in range(16)]
        expected = [sum(1 << i for i in range(64) if bits[w * 64 + i]) for w in range(4)]
        assert [w % 2**64 for w in words] == expected
    assert got[6] == [-1, -1, -1, -1]


def test_character_references(spark):
    cases = {"&#x00000041;": "A", "&#0000000066;": "B", "&#x110000;": None, "&#xD800;": None, "&#0;": None, "&#x1F600;": "\U0001F600", "&#99999999999;": None}
    frame = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r["v"]: r["x"] for r in frame.select("v", X.xml_unescape("v").alias("x")).collect()} == cases
