"""The driver tables seen as backups: every binding is a projection of a whole table."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from mementa import constants as K
from mementa.functions import paths as P
from mementa.functions import signature as S
from mementa.operators import consolidation as C
from mementa.operators import index as I
from mementa.operators.common import group_winner

# How document ids map to extensions and folders.
EXTENSIONS = ["jpg", "png", "mp4", "mp3", "pdf", "txt", "bin", None]
FOLDERS = ["Photo", "Video", "Music", "Documents", "Misc"]
BACKUP_FOLDERS = ["CONTACT", "CALLLOG", "APK", "MESSAGE", "SBROWSER"]
DESTINATION = "/library"
IMPORTED_SOURCES = [f"src{i}" for i in range(10)]
# Bytes from which on a text's grid is summed cell by cell.
LONG_TEXT = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), index.cast("int"))


def inventory(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """File inventory of the documents; Catalyst drops hashing where no query asks for it."""
    d = table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    based = d.select(
        doc.alias("id"),
        F.col("source").alias("backup_id"),
        F.concat(F.lit("/backups/"), "source").alias("root_path"),
        _pick(EXTENSIONS, doc % 8).alias("extension"),
        _pick(FOLDERS, doc % 5).alias("folder"),
        "source",
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.when(doc % 11 != 0, F.lit(1700000000) + (doc * 7919) % 1000000).alias("modified_unix"),
        F.sha2(F.col("text"), 256).alias("content_hash"),
        *([F.col("text")] if text else []),
    )
    relative = F.concat(
        "folder", F.lit("/"), "source", F.lit("/"), F.col("id").cast("string"),
        F.coalesce(F.concat(F.lit("."), "extension"), F.lit("")),
    )
    return (
        based.withColumn("relative_path", relative)
        .withColumn("absolute_path", F.concat("root_path", F.lit("/"), "relative_path"))
        .drop("folder", "source")
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index: the inventory with category and source."""
    return I.describe(inventory(spark, sf_dir))


def prior_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library after importing ten of the backups: the least id of each content wins."""
    imported = inventory(spark, sf_dir).filter(F.col("backup_id").isin(IMPORTED_SOURCES))
    first = group_winner(imported, ["content_hash"], [F.col("id")], ["id", "size_bytes", "extension"])
    return first.select(
        F.col("content_hash").alias("hash"),
        "size_bytes",
        "extension",
        P.storage_path(F.lit(DESTINATION), "content_hash", "extension").alias("storage_path"),
    )


def backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "documents").select("source").distinct()
    return names.select(
        F.col("source").alias("id"),
        F.lit("generic-folder").alias("adapter"),
        F.concat(F.lit("Backup "), "source").alias("label"),
        F.concat(F.lit("/backups/"), "source").alias("source_path"),
        F.lit(None).cast("string").alias("device_id"),
        F.substr("source", F.lit(4)).cast("long").alias("imported_at"),
    )


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(spark, sf_dir).select(
        "content_hash", "backup_id", F.col("relative_path").alias("original_path"),
        F.col("modified_unix").alias("original_mtime"),
    )


def previous_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older index: the imported backups, every seventh file changed since."""
    old = files(spark, sf_dir).filter(F.col("backup_id").isin(IMPORTED_SOURCES))
    return old.withColumn(
        "size_bytes", F.when(F.col("id") % 7 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes"))
    )


def content_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(spark, sf_dir, text=True).select("absolute_path", F.col("text").alias("content"))


def backup_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of the suppliers: adapters cycle, phones have no path."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    adapter = _pick([a for a, _, _ in K.ADAPTERS] + ["custom"], key % 5)
    return s.select(
        F.concat(F.lit("source-"), (key % 97).cast("string")).alias("id"),
        adapter.alias("adapter"),
        F.col("s_name").alias("label"),
        F.when(key % 5 != 0, F.concat(F.lit("/sources/"), key.cast("string"))).alias("path"),
        key.alias("seq"),
    )


def text_grids(texts: pa.Array) -> pa.Array:
    """A grid per text, read where Arrow holds the bytes."""
    cells = S.GRID_WIDTH * S.GRID_HEIGHT
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    sizes = np.where(raw.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    large = sizes >= cells
    out = np.empty((np.count_nonzero(large), cells), np.int32)
    for row, i in enumerate(np.flatnonzero(large)):
        borders = np.arange(cells + 1) * sizes[i] // cells
        text = data[offsets[i] : offsets[i + 1]]
        if sizes[i] > LONG_TEXT:  # reduceat copies the text as longs, sums of slices do not
            sums = np.array([text[a:b].sum(dtype=np.int64) for a, b in pairwise(borders.tolist())])
        else:
            sums = np.add.reduceat(text, borders[:-1], dtype=np.int64)
        out[row] = sums // np.diff(borders)
    starts = np.concatenate([[0], np.cumsum(large * cells)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(out.ravel()), mask=pa.array(~large))


def luma_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luma grids from whole documents: cell i is the mean of the bytes from i/272 to (i+1)/272 of the text.

    Texts below 272 bytes stay as photos that cannot be decoded: no grid.  As in the photo source, numpy reduces the
    bytes in Arrow batches.  It reads them where Arrow holds them, so a worker needs a batch, which the session bounds,
    and 1 KB for the grid of each of its rows; a text above ``LONG_TEXT`` is summed without a wider copy.
    """
    grids = F.arrow_udf(text_grids, ArrayType(IntegerType()))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        (F.lit(300) + F.col("n_chars") % 8).cast("int").alias("width"),
        F.lit(200).alias("height"),
        grids("text").alias("luma"),
    )


def signed_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids = luma_grids(spark, sf_dir)
    return grids.select(
        "id", "size_bytes", S.aspect_q("width", "height").alias("aspect_q"), S.dhash256("luma").alias("sig")
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("key_remote_jid"),
        F.col("text").alias("data"),
        F.col("turn").alias("timestamp"),
    )


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("b"), (page % 20).cast("string")).alias("backup_id"),
        F.concat(F.lit("/b/SBROWSER/"), page.cast("string"), F.lit(".html")).alias("source_path"),
        F.col("html").alias("text"),
    )


def contact_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decrypted contact entries: one per customer, archives by nation, junk around the JSON region."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    nested = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("displayName"),
                    key.alias("phone"),
                    F.concat("c_mktsegment", F.lit("@example.org")).alias("email"),
                    F.struct(F.lit("").alias("displayName"), F.col("c_mktsegment").alias("name")).alias("group"),
                )
            ).alias("contacts")
        )
    )
    nation = F.col("c_nationkey").cast("string")
    return c.select(
        F.concat(F.lit("n"), nation).alias("backup_id"),
        F.concat(F.lit("/n"), nation, F.lit("/CONTACT/Contact.SPBM")).alias("source_path"),
        key.alias("entry_index"),
        F.concat(F.lit("xxxx"), nested, F.lit("yyyy")).alias("text"),
    )


def call_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decrypted call logs: one entry per order with a named and an unnamed call."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    xml = F.concat(
        F.lit("junk<?xml version='1.0'?><CallLogs><CallLog name=\"Clerk &quot;"), key,
        F.lit("&quot; &amp; Co\" type=\"in\" date=\""), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit("\"/><!-- <CallLog name=\"no\"/> --><CallLog number='+"), F.col("o_custkey").cast("string"),
        F.lit("' duration=\"7\"></CallLog></CallLogs>tail"),
    )
    return o.select(
        F.col("o_orderstatus").alias("backup_id"),
        F.concat(F.lit("/c/"), key, F.lit("/CALLLOG.zip")).alias("source_path"),
        xml.alias("text"),
    )


def calendar_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar files: one per order, two summaries (the last wins), start with or without a value."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    start = F.when(key % 3 == 0, F.lit("DTSTART")).otherwise(F.concat(F.lit("DTSTART;TZID=UTC:"), day))
    text = F.concat(
        F.lit("BEGIN:VEVENT\r\nSUMMARY:draft\r\nSUMMARY:Order "), key.cast("string"), F.lit("\r\n"), start,
        F.lit("\r\nEND:VEVENT\r\n"),
    )
    ext = _pick(["ics", "VCS", "dat"], key % 3)
    return o.select(
        F.col("o_orderstatus").alias("backup_id"),
        F.concat(F.lit("/k/"), key.cast("string"), F.lit("."), ext).alias("source_path"),
        text.alias("text"),
    )


def note_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes: the document texts as text files, containers with text, or other files."""
    doc = F.col("doc_id")
    ext = _pick(["txt", "md", "html", "sdocx", "bin"], doc % 5)
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("backup_id"),
        F.concat(F.lit("/s/"), doc.cast("string"), F.lit("."), ext).alias("source_path"),
        "text",
    )


def browser_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History files in JSON: one per page, with a nested child."""
    page = F.col("page_id")
    text = F.to_json(
        F.struct(
            F.struct(F.lit(" Saved ").alias("title"), page.alias("url")).alias("a"),
            F.array(F.struct(F.col("url").alias("uri"))).alias("children"),
            F.lit(5).alias("title"),
        )
    )
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("b"), (page % 20).cast("string")).alias("backup_id"),
        F.concat(F.lit("/b/SBROWSER/"), page.cast("string"), F.lit(".json")).alias("source_path"),
        text.alias("text"),
    )


def phone_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of structured backups, one per part: app packages, message databases and others."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    top = _pick(["APK", "GALAXYSTORE", "DISABLEDAPPS", "MESSAGE", "WhatsApp", "CONTACT", "SBROWSER", "CALENDER"], key % 8)
    name = F.when(key % 8 < 3, F.when(key % 10 < 6, F.lit("App.v1.apk")).otherwise(F.lit("notes.txt"))).otherwise(
        _pick(["msgstore.db.crypt14", "WA.DB", "x.crypt15", "readme.md"], F.floor(key / 8) % 4)
    )
    backup = F.concat(F.lit("p"), (key % 50).cast("string"))
    relative = F.concat(top, F.lit("/"), key.cast("string"), F.lit("/"), name)
    root = F.concat(F.lit("/phones/"), backup)
    return p.select(
        backup.alias("backup_id"),
        F.concat(F.lit("Phone "), (key % 50).cast("string")).alias("backup_label"),
        root.alias("root_path"),
        relative.alias("relative_path"),
        F.concat(root, F.lit("/"), relative).alias("absolute_path"),
        F.col("p_size").cast("long").alias("size_bytes"),
        key.alias("seq"),
    )


def with_folders(inventory: DataFrame, sub_folder: str, empty_folder: str) -> DataFrame:
    """``inventory`` with folder rows: a sub-folder without files per backup, and per backup one whose only entry is
    an empty folder."""
    backups = inventory.drop("relative_path", "absolute_path", "size_bytes").dropDuplicates(["backup_id"])

    def folder(name: str) -> DataFrame:
        return backups.withColumns({
            "relative_path": F.lit(name), "absolute_path": F.concat("root_path", F.lit(f"/{name}")),
            "size_bytes": F.lit(0).cast("long"), "is_dir": F.lit(True),
        })

    alone = folder(empty_folder).withColumns({n: F.concat(n, F.lit("-empty")) for n in ("backup_id", "root_path")})
    return inventory.withColumn("is_dir", F.lit(False)).unionByName(folder(sub_folder)).unionByName(alone)


def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive entries, one per order line; the head is XML, ASCII or binary."""
    li = table(spark, sf_dir, "lineitem")
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    item = _pick(["CONTACT", "CALLLOG", "OTHER"], key % 3)
    name = _pick(["a/image/x.bin", "p.jpg", "q.png", "c.json.enc", "d/blob/z", "u/call_log.exml", "call_log.exml"], line - 1)
    head = F.when((key + line) % 4 == 0, F.unhex(F.lit("009F9296"))).when(
        (key + line) % 4 == 1, F.encode(F.lit("<?xml version=\"1.0\" ü"), "UTF-8")
    ).otherwise(F.encode(F.col("l_returnflag"), "UTF-8"))
    return li.select(
        F.concat(F.lit("b"), (F.col("l_suppkey") % 10).cast("string")).alias("backup_id"),
        F.concat(F.lit("Backup "), (F.col("l_suppkey") % 10).cast("string")).alias("backup_label"),
        item.alias("item_type"),
        F.concat(F.lit("/a/"), key.cast("string"), F.lit(".zip")).alias("archive_path"),
        (line * 100000 + F.col("l_partkey") % 100000).alias("entry_index"),
        name.alias("entry_name"),
        head.alias("head"),
    )


def item_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item metric documents, one per event, with missing counts."""
    e = table(spark, sf_dir, "events")
    entry = F.struct(
        F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("ViewCount"),
        F.get_json_object("props", "$.k").cast("long").alias("ContentCount"),
        F.upper("event_type").alias("Type"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_id") * 10).alias("Size"),
    )
    other = F.struct(
        F.lit(None).cast("long").alias("ViewCount"), F.lit(1).cast("long").alias("ContentCount"),
        F.lit("MESSAGE").alias("Type"), F.lit(4096).cast("long").alias("Size"),
    )
    return e.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("backup_id"),
        F.concat(F.lit("Event "), F.col("event_id").cast("string")).alias("backup_label"),
        F.to_json(F.struct(F.array(entry, other).alias("ListItems"))).alias("text"),
    )


def listing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing logs, one line per order; some lines are blank or report denied access."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    folder = _pick([k for k, _ in K.DEVICE_MEDIA_FOLDERS], F.col("o_custkey") % 5)
    line = (
        F.when(key % 10 == 0, F.lit("  "))
        .when(key % 10 == 1, F.concat(F.lit("find: '/x/"), key.cast("string"), F.lit("': Permission denied")))
        .otherwise(F.concat(F.lit(" /sdcard/"), folder, F.lit("/"), key.cast("string"), F.lit(".jpg ")))
    )
    return o.select(
        F.concat(F.lit("dev"), (F.col("o_custkey") % 40).cast("string")).alias("device"),
        folder.alias("folder"),
        key.alias("line_no"),
        line.alias("line"),
    )


def listing_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size listings, one per customer; some are unreadable."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("dev"), (key % 40).cast("string")).alias("device"),
        _pick([k for k, _ in K.DEVICE_MEDIA_FOLDERS], key % 5).alias("folder"),
        F.when(key % 4 == 0, F.lit("du: error")).otherwise(
            F.concat((key * 3).cast("string"), F.lit("\t/sdcard/x"))
        ).alias("size_text"),
    )


def device_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device lists, one line per customer; line 1 is the header."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    status = _pick(["device", "unauthorized", "offline"], key % 3)
    line = F.when(key % 20 == 19, F.lit("lonely")).otherwise(
        F.concat(F.lit(" SER"), key.cast("string"), F.lit("\t "), status, F.lit(" usb:1"))
    )
    return c.select(
        F.concat(F.lit("host"), F.col("c_nationkey").cast("string")).alias("host"),
        (key + 1).alias("line_no"),
        line.alias("line"),
    )


def message_db_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Database folder listings, one line per order."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    name = (
        F.when(F.col("o_custkey") % 6 == 0, F.lit("msgstore.db.crypt14"))
        .when(F.col("o_custkey") % 6 == 1, F.lit("chatsettings.db"))
        .otherwise(F.concat(F.lit("msgstore-"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".1.db.crypt15")))
    )
    return o.select(
        F.concat(F.lit("dev"), F.col("o_custkey").cast("string")).alias("device"),
        _pick(K.MESSAGE_DB_FOLDERS, key % 3).alias("folder"),
        F.concat(F.lit(" "), name, F.lit(" ")).alias("line"),
    )


def sync_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier sync of the imported backups, every ninth file with another size."""
    old = inventory(spark, sf_dir).filter(F.col("backup_id").isin(IMPORTED_SOURCES))
    return old.select(
        "absolute_path", "relative_path",
        F.when(F.col("id") % 9 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"),
    )


def requested_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories asked for: the folders that occur, plus the sources' names (unsupported)."""
    inv = inventory(spark, sf_dir)
    folders = inv.select(F.substring_index("relative_path", "/", 1).alias("category")).distinct()
    return folders.unionByName(inv.select(F.col("backup_id").alias("category")).distinct())


def purge_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths to purge: the inventory, the stored objects, and look-alike paths beside the library."""
    inv = inventory(spark, sf_dir).select("absolute_path")
    stored = prior_contents(spark, sf_dir).select(F.col("storage_path").alias("absolute_path"))
    beside = inv.select(F.concat(F.lit("/library/objects2"), "absolute_path").alias("absolute_path"))
    return inv.unionByName(stored).unionByName(beside)


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.backup_coverage(
        backups(spark, sf_dir), occurrences(spark, sf_dir), prior_contents(spark, sf_dir)
    )
