"""Structured records from plaintext payloads: one row shape for all kinds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from mementa import constants as K
from mementa.functions import paths as P
from mementa.functions import text as X
from mementa.functions.paths import let
from mementa.operators.common import dimension
from mementa.schemas import STRUCTURED_RECORD
from mementa.session import reliable_checkpoint


# Entries of an archive whose records are numbered together.
ORDINAL_BLOCK = 4096


def _record(kind: str, title: Column, subtitle: Column, status: str | Column, ident: Column) -> list[Column]:
    status_col = F.lit(status) if isinstance(status, str) else status
    return [
        ident.alias("id"),
        F.lit(kind).alias("kind"),
        title.alias("title"),
        subtitle.alias("subtitle"),
        F.col("source_path"),
        status_col.alias("parse_status"),
    ]


def _ident(*parts: Column | str) -> Column:
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.concat_ws(":", *columns)


def _no_text() -> Column:
    return F.lit(None).cast("string")


def status_rows(df: DataFrame, kind: str, status: str | Column) -> DataFrame:
    """Status record of a file or folder given as (backup_id, source_path)."""
    return df.select(
        "backup_id",
        *_record(
            kind, P.base_name("source_path"), _no_text(), status,
            _ident(F.col("backup_id"), kind, F.col("source_path")),
        ),
    )


# ---------------------------------------------------------------- nested JSON


def json_objects(payloads: DataFrame, text: str = "text", levels: int = 10) -> DataFrame:
    """Every object at any depth, with a sortable depth-first position (parents before children).

    Each step explodes a node into itself and its children, so ``levels`` steps are one narrow pipeline over
    one scan.  Payloads of few brackets need no more; with others, the walk goes on from a checkpoint until no unopened
    container is left, whatever the depth.
    Object children come in key order.
    """
    others = [c for c in payloads.columns if c != text]

    def as_object(v: Column) -> Column:
        return F.try_variant_get(v, "$", "map<string,variant>")

    def as_list(v: Column) -> Column:
        return F.try_variant_get(v, "$", "array<variant>")

    def node(index: Column, v: Column) -> Column:
        place = F.concat(F.col("_pos"), F.lpad(index.cast("string"), 10, "0"))
        return F.struct(place.alias("_pos"), v.alias("_v"), F.lit(False).alias("_done"))

    def by_key(a: Column, b: Column) -> Column:
        return F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)

    v, done = F.col("_v"), F.col("_done")
    container = as_object(v).isNotNull() | as_list(v).isNotNull()
    itself = F.array(F.struct(F.col("_pos"), v.alias("_v"), F.lit(True).alias("_done")))

    def split(c: Column) -> Column:
        """An object and its children, or the children of a list; nothing of a scalar."""
        entries = F.array_sort(F.map_entries(c["object"]), by_key)
        return F.when(
            c["object"].isNotNull(), F.concat(itself, F.transform(entries, lambda e, i: node(i, e["value"])))
        ).otherwise(F.transform(c["list"], lambda e, i: node(i, e)))

    # finished nodes pass through untouched; scalars leave at the next step
    step = F.when(done, itself).otherwise(let(F.struct(as_object(v).alias("object"), as_list(v).alias("list")), split))
    # the explode keeps later conditions from parsing the text again
    root = F.struct(F.lit("").alias("_pos"), F.try_parse_json(F.col(text)).alias("_v"), F.lit(False).alias("_done"))
    nodes = payloads.select(*others, F.inline(F.array(root)))

    def opened(rows: DataFrame, steps: int) -> DataFrame:
        for _ in range(steps):
            rows = rows.select(*others, F.inline(step))
        return rows

    # no payload is deeper than its opening brackets are many
    bare = F.replace(F.replace(F.col(text), F.lit("{"), F.lit("")), F.lit("["), F.lit(""))
    brackets = F.octet_length(text) - F.octet_length(bare)
    deepest = payloads.agg(F.coalesce(F.max(brackets), F.lit(0))).first()[0]
    if deepest <= levels:
        nodes = opened(nodes, deepest)
    else:
        nodes = reliable_checkpoint(opened(nodes, levels))
        while not nodes.filter(~done & container).isEmpty():
            nodes = reliable_checkpoint(opened(nodes, levels))
    return nodes.filter(done).select(
        *others, F.col("_pos").alias("position"), as_object(v).alias("object")
    )


def first_string(node: Column | str, keys: Sequence[str]) -> Column:
    """First key whose value is a non-empty string after trimming; numbers do not count."""
    n = F.col(node) if isinstance(node, str) else node

    def text_of(key: str) -> Column:
        value = F.try_element_at(n, F.lit(key))
        trimmed = X.trim_unicode(F.try_variant_get(value, "$", "string"))
        filled = let(trimmed, lambda t: F.when(F.length(t) > 0, t))
        return F.when(F.schema_of_variant(value) == "STRING", filled)

    return F.coalesce(*[text_of(k) for k in keys])


def contacts(payloads: DataFrame) -> DataFrame:
    """Contacts of decrypted archive entries (backup_id, source_path, entry_index, text).

    Ordinals continue over the entries of an archive.  Records are numbered in blocks of ``ORDINAL_BLOCK`` entries, and
    a block begins behind the records of the blocks before.
    """
    region = payloads.withColumn("text", X.json_region("text"))
    found = (
        json_objects(region.select("backup_id", "source_path", "entry_index", "text"))
        .withColumn("title", first_string("object", ["displayName", "name", "formattedName", "givenName"]))
        .withColumn("subtitle", first_string("object", ["phoneNumber", "phone", "email", "number"]))
        .drop("object")
    )
    # ranks and offsets both start from the records, so the walk is done once and kept
    found = reliable_checkpoint(found).filter("title IS NOT NULL")
    archive = ["backup_id", "source_path"]
    cut = found.withColumn("_block", F.floor(F.col("entry_index") / ORDINAL_BLOCK))
    place = Window.partitionBy(*archive, "_block").orderBy("entry_index", "position")
    earlier = Window.partitionBy(*archive).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*archive, "_block").agg(F.count("*").alias("_n"))
    offsets = totals.select(*archive, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    ranked = cut.withColumn("_rank", F.row_number().over(place) - 1)
    ordinal = F.col("_before") + F.col("_rank")
    return ranked.join(offsets, [*archive, "_block"]).select(
        "backup_id",
        *_record(
            "contact", F.col("title"), F.col("subtitle"), "parsed_decrypted_contact",
            _ident(F.col("backup_id"), "contact", F.col("source_path"), ordinal),
        ),
    )


def browser_json(payloads: DataFrame) -> DataFrame:
    """Bookmarks and history from JSON files (backup_id, source_path, text)."""
    found = (
        json_objects(payloads.select("backup_id", "source_path", "text"))
        .withColumn("title", first_string("object", ["title", "name"]))
        .withColumn("url", first_string("object", ["url", "uri"]))
        .drop("object")
        .filter("title IS NOT NULL OR url IS NOT NULL")
    )
    rank = F.row_number().over(Window.partitionBy("backup_id", "source_path").orderBy("position")) - 1
    return found.withColumn("_rank", rank).select(
        "backup_id",
        *_record(
            "browser", F.coalesce("title", "url", F.lit("Browser record")), F.col("url"), "parsed_browser_json",
            _ident(F.col("backup_id"), "browser", F.col("source_path"), F.col("_rank")),
        ),
    )


# ---------------------------------------------------------------- markup and text


def anchors(html: Column | str) -> Column:
    """Array of (title, url) of the anchors in a page, in order, empty ones left out.

    The page is split at end tags once, and each piece is searched once for an opening.  A piece whose opening has no
    ``>`` takes that of its end tag, and the whole next piece is its content: in the string of kinds, one letter per
    piece, such pairs are found from left to right.
    """

    def opening(piece: Column) -> Column:
        return F.instr(piece, "<a")

    def tag_end(piece: Column) -> Column:
        return F.call_function("locate", F.lit(">"), piece, opening(piece))

    def kind(piece: Column) -> Column:
        return F.when(opening(piece) == 0, "0").when(tag_end(piece) > 0, "1").otherwise("2")

    def anchor(tag: Column, inner: Column) -> Column:
        return F.struct(X.strip_html(inner).alias("title"), X.href(tag).alias("url"))

    def found(pieces: Column) -> Column:
        kinds = F.array_join(F.transform(pieces, kind), "")

        def each(marks: Column) -> Column:
            def parse(piece: Column, i: Column) -> Column:
                own = anchor(F.substr(piece, opening(piece), tag_end(piece) - opening(piece)), F.substr(piece, tag_end(piece) + 1))
                before = F.get(pieces, i - 1)
                carried = anchor(F.concat(F.substr(before, opening(before)), F.lit("</a")), piece)
                return F.when(F.get(marks, i) == "1", own).when(F.get(marks, i) == "x", carried)

            return F.transform(pieces, parse)

        return let(F.split(F.regexp_replace(kinds, "2.", "2x"), ""), each)

    parts = let(F.split(html, "</a>"), lambda p: F.slice(p, F.lit(1), F.size(p) - 1))  # nothing closes the last piece
    return F.filter(let(parts, found), lambda a: (F.length(a["title"]) > 0) | a["url"].isNotNull())


def browser_html(payloads: DataFrame) -> DataFrame:
    """Bookmarks from HTML files (backup_id, source_path, text); the array position is the ordinal."""
    rows = payloads.select(
        "backup_id", "source_path", F.posexplode(anchors(F.col("text"))).alias("_n", "_a")
    )
    title, url = F.col("_a.title"), F.col("_a.url")
    return rows.select(
        "backup_id",
        *_record(
            "browser",
            F.when(F.length(title) > 0, title).otherwise(F.coalesce(url, F.lit("Browser record"))),
            url,
            "parsed_browser_html",
            _ident(F.col("backup_id"), "browser", F.col("source_path"), F.col("_n")),
        ),
    )


# Complete pieces of markup, each found in one pass (possessive repetition: no backtracking): comments, CDATA,
# instructions, document types, end tags, start tags, references.
XML_PIECE = "|".join([
    r"<!--.*?-->", r"<!\[CDATA\[.*?\]\]>", r"<\?.*?\?>", r"<![dD](?:[^<>]++|<[^<>]*+>)*+>", r"</[^>]*+>",
    r"""<(?![!?/])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""", r"&[^;&<]*+;",
])
# Anything else that opens is an error and swallows the rest.
XML_EVENT = rf"(?s){XML_PIECE}|[<&].*"
XML_ATTRIBUTE = r"""(?s)([^\s=/"'<>]++)\s*+=\s*+("[^"]*+"|'[^']*+')"""


def before_first_error(events: Column) -> Column:
    """The markup events in front of the first error: an unfinished piece, or an end tag that does not close the
    innermost open element.  The fold keeps the names of open elements, one per line, and the number of good events."""

    def step(event: Column) -> Column:
        name = F.regexp_extract(event, r"^</?([^\s>]*)", 1)
        closes, opens = event.startswith("</"), event.rlike(r"^<[^!?/]") & ~event.endswith("/>")
        return F.struct(F.when(closes, "-").when(opens, "+").otherwise("0").alias("way"), name.alias("name"))

    def fold(state: Column, e: Column) -> Column:
        line = F.concat(F.lit("\n"), e["name"])
        wrong = (e["way"] == "-") & ~state["open"].endswith(line)
        shorter = F.substr(state["open"], F.lit(1), F.length(state["open"]) - F.length(line))
        after = F.when(e["way"] == "+", F.concat(state["open"], line)).when(e["way"] == "-", shorter).otherwise(state["open"])
        on = F.when(state["open"].isNull() | wrong, F.lit(None)).otherwise(after)
        return F.struct(on.alias("open"), (state["good"] + on.isNotNull().cast("int")).alias("good"))

    def cut(found: Column) -> Column:
        broken = ~F.element_at(found, -1).rlike(rf"^(?s)(?:{XML_PIECE})")
        start = F.struct(F.lit("").alias("open"), F.lit(0).alias("good"))
        good = F.aggregate(F.transform(found, step), start, fold)["good"]
        whole = F.size(found) - F.when(broken, 1).otherwise(0)
        return F.slice(found, F.lit(1), F.least(good, whole))

    return F.when(F.size(events) == 0, events).otherwise(let(events, cut))


def call_elements(xml: Column | str) -> Column:
    """Array of (title, subtitle) per CallLog element in front of the first XML error."""
    events = before_first_error(F.regexp_extract_all(xml, F.lit(XML_EVENT), F.lit(0)))
    tags = F.filter(events, lambda e: e.rlike(r"^<CallLog(?=[\s/>])"))

    def parse(tag: Column) -> Column:
        attributes = F.struct(
            F.regexp_extract_all(tag, F.lit(XML_ATTRIBUTE), F.lit(1)).alias("names"),
            F.regexp_extract_all(tag, F.lit(XML_ATTRIBUTE), F.lit(2)).alias("values"),
        )

        def pick(found: Column) -> Column:
            names, values = found["names"], found["values"]

            def value(key: str) -> Column:
                at = F.array_position(names, key)
                quoted = F.get(values, (at - 1).cast("int"))
                inner = F.substr(quoted, F.lit(2), F.length(quoted) - 2)
                # most values hold no reference
                return F.when(at > 0, F.when(~quoted.contains("&"), inner).otherwise(let(inner, X.xml_unescape)))

            title = F.coalesce(value("name"), value("number"), value("phoneNumber"), F.lit("Call log"))
            subtitle = F.coalesce(value("date"), value("type"), value("duration"))
            return F.struct(title.alias("title"), subtitle.alias("subtitle"))

        return let(attributes, pick)

    return F.transform(tags, parse)


def call_logs(payloads: DataFrame) -> DataFrame:
    """Call log rows of decrypted entries; the ordinal restarts in every entry."""
    rows = payloads.select(
        "backup_id",
        "source_path",
        F.posexplode(call_elements(X.xml_region("text", "CallLogs"))).alias("_n", "_c"),
    )
    return rows.select(
        "backup_id",
        *_record(
            "calllog", F.col("_c.title"), F.col("_c.subtitle"), "parsed_decrypted_calllog",
            _ident(F.col("backup_id"), "calllog", F.col("source_path"), F.col("_n")),
        ),
    )


def last_field(text: Column | str, prefix: str) -> Column:
    """Rest of the last line starting with ``prefix``; NULL when no line does."""
    t = F.col(text) if isinstance(text, str) else text
    pattern = rf"(?s)^(?:.*\n)?{prefix}([^\n]*)"
    return F.when(t.rlike(pattern), F.regexp_replace(F.regexp_extract(t, pattern, 1), "\r$", ""))


def calendar(payloads: DataFrame) -> DataFrame:
    """One record per calendar file (backup_id, source_path, text); other files get a status row.

    The greedy prefix of the pattern finds the last matching line, so no line table is built.
    """
    is_calendar = F.coalesce(P.extension("source_path").isin("ics", "vcs"), F.lit(False))
    start = last_field("text", "DTSTART")
    date = F.when(F.instr(start, ":") > 0, F.substr(start, F.instr(start, ":") + 1))
    parsed = payloads.filter(is_calendar).select(
        "backup_id",
        *_record(
            "calendar", F.coalesce(last_field("text", "SUMMARY:"), F.lit("Calendar event")), date,
            "parsed_text_calendar", _ident(F.col("backup_id"), F.col("source_path")),
        ),
    )
    other = payloads.filter(~is_calendar).select("backup_id", "source_path")
    return parsed.unionByName(status_rows(other, "calendar", K.CALENDAR_STATUS))


def notes(payloads: DataFrame) -> DataFrame:
    """Notes (backup_id, source_path, text): plain text, extracted container text, or a status row."""
    ext = F.coalesce(P.extension("source_path"), F.lit(""))
    plain = ext.isin("txt", "md", "html")
    container = ext.isin("sdoc", "sdocx") & F.col("text").isNotNull()
    title = F.coalesce(X.first_line_title("text"), F.lit("Samsung note"))
    ident = _ident(F.col("backup_id"), "note", F.col("source_path"))
    size = F.when(plain, F.concat(F.octet_length("text").cast("string"), F.lit(" bytes"))).otherwise(
        F.concat(F.length("text").cast("string"), F.lit(" characters"))
    )
    status = F.when(plain, "parsed_text_note").otherwise("parsed_sdocx_text")
    parsed = payloads.filter(plain | container).select(
        "backup_id", *_record("note", title, size, status, ident)
    )
    other = payloads.filter(~(plain | container)).select("backup_id", "source_path")
    return parsed.unionByName(status_rows(other, "note", K.NOTE_STATUS))


# ---------------------------------------------------------------- inventory-based records


def folders(inventory: DataFrame, names: Sequence[str]) -> DataFrame:
    """Top folders of each backup that exist, as (backup_id, folder, source_path)."""
    top = F.substring_index("relative_path", "/", 1)
    return (
        inventory.select("backup_id", "root_path", top.alias("folder"))
        .filter(F.col("folder").isin(list(names)))
        .distinct()
        .select("backup_id", "folder", F.concat_ws("/", "root_path", "folder").alias("source_path"))
    )


def _regular(inventory: DataFrame) -> DataFrame:
    return inventory.filter(~F.col("is_dir")) if "is_dir" in inventory.columns else inventory


def apps(inventory: DataFrame) -> DataFrame:
    """App packages under the app folders; a folder without any gets its status row."""
    names = [n for n, _ in K.APP_FOLDERS]
    top = F.substring_index("relative_path", "/", 1)
    packages = (
        _regular(inventory)
        .filter(top.isin(names) & (P.extension("relative_path") == "apk"))
        .withColumn("folder", top)
        .withColumn("source_path", F.col("absolute_path"))
    )
    parsed = packages.select(
        "backup_id",
        *_record(
            "app", P.file_stem("source_path"),
            F.concat(F.col("size_bytes").cast("string"), F.lit(" bytes")), "parsed_apk_inventory",
            _ident(F.col("backup_id"), "app", F.col("source_path")),
        ),
    )
    statuses = dimension(inventory.sparkSession, ["folder", "status"], K.APP_FOLDERS)
    empty = (
        folders(inventory, names)
        .join(packages.select("backup_id", "folder").distinct(), ["backup_id", "folder"], "left_anti")
        .join(F.broadcast(statuses), "folder")
    )
    return parsed.unionByName(status_rows(empty, "app", F.col("status")))


def message_databases(inventory: DataFrame) -> DataFrame:
    """Status row per encrypted message database file."""
    hits = _regular(inventory).filter(
        F.substring_index("relative_path", "/", 1).isin(K.MESSAGE_FOLDERS)
        & F.col("relative_path").contains("/")
        & P.is_message_db_file(P.base_name("relative_path"))
    )
    return status_rows(
        hits.select("backup_id", F.col("absolute_path").alias("source_path")),
        "whatsapp_message", K.MESSAGE_DB_STATUS,
    )


def missing_kind_status(inventory: DataFrame, records: DataFrame) -> DataFrame:
    """Status row for a contact, call log or app folder without any record of its kind."""
    rules = dimension(inventory.sparkSession, ["kind", "folder", "status"], K.STATUS_FOLDERS)
    present = folders(inventory, [f for _, f, _ in K.STATUS_FOLDERS]).join(F.broadcast(rules), "folder")
    kinds = [k for k, _, _ in K.STATUS_FOLDERS]
    parsed = records.filter(F.col("kind").isin(kinds)).select("backup_id", "kind").distinct()
    missing = present.join(parsed, ["backup_id", "kind"], "left_anti")
    return missing.select(
        "backup_id",
        F.concat_ws(":", "backup_id", "kind", "source_path").alias("id"),
        "kind",
        F.col("folder").alias("title"),
        _no_text().alias("subtitle"),
        "source_path",
        F.col("status").alias("parse_status"),
    )


def browser_status(inventory: DataFrame, browser_records: DataFrame) -> DataFrame:
    """One status row for a browser folder that yielded no record."""
    empty = folders(inventory, ["SBROWSER"]).join(
        browser_records.select("backup_id").distinct(), "backup_id", "left_anti"
    )
    return status_rows(empty, "browser", K.BROWSER_STATUS)


# ---------------------------------------------------------------- messages


def message_sample(messages: DataFrame, limit: int = K.MESSAGE_SAMPLE) -> DataFrame:
    """First messages with text, in a definite order."""
    return (
        messages.filter(F.col("data").isNotNull())
        .orderBy("timestamp", "key_remote_jid", "data")
        .limit(limit)
    )


def messages(table: DataFrame, database_path: str, limit: int = K.MESSAGE_SAMPLE) -> DataFrame:
    """Message records of the sample; the rank runs over the sample only."""
    rank = F.row_number().over(Window.orderBy("timestamp", "key_remote_jid", "data")) - 1
    sample = message_sample(table, limit).withColumn("_rank", rank).withColumn(
        "source_path", F.lit(database_path)
    )
    return sample.select(
        *_record(
            "whatsapp_message", X.title120("data"),
            F.coalesce(F.col("key_remote_jid"), F.col("timestamp").cast("string")),
            "parsed_decrypted_whatsapp_message",
            _ident("whatsapp-message", F.col("source_path"), F.col("_rank")),
        )
    )


def message_counts(messages_table: DataFrame, chats: DataFrame | None) -> DataFrame:
    """Rows of the message and chat tables; an absent table counts zero."""
    spark = messages_table.sparkSession
    parts = messages_table.select(F.lit("m").alias("t"))
    if chats is not None:
        parts = parts.unionByName(chats.select(F.lit("c").alias("t")))
    return parts.agg(
        F.count_if(F.col("t") == "m").alias("message_count"),
        F.count_if(F.col("t") == "c").alias("chat_count"),
    )


def union_records(parts: Sequence[DataFrame]) -> DataFrame:
    """All kinds in one table."""
    return reduce(lambda a, b: a.unionByName(b), [p.select(*STRUCTURED_RECORD) for p in parts])


def prepend(first: DataFrame, rest: DataFrame) -> DataFrame:
    """Bag union that remembers which part comes first."""
    return first.withColumn("part", F.lit(0)).unionByName(rest.withColumn("part", F.lit(1)))


def structured_records(inventory: DataFrame, payloads: DataFrame) -> DataFrame:
    """All records of all backups, from an inventory and plaintext payloads.

    ``payloads`` holds (backup_id, payload, source_path, entry_index, text) with payload one of
    calendar, note, contact, calllog, browser.
    """
    def of(name: str) -> DataFrame:
        return payloads.filter(F.col("payload") == name)

    pages = of("browser")
    ext = P.extension("source_path")
    browser = browser_json(pages.filter(ext == "json")).unionByName(
        browser_html(pages.filter(ext.isin("html", "htm")))
    )
    parsed = [calendar(of("calendar")), notes(of("note")), contacts(of("contact")), call_logs(of("calllog"))]
    parsed += [browser, browser_status(inventory, browser), apps(inventory), message_databases(inventory)]
    together = reduce(lambda a, b: a.unionByName(b), parsed)
    return union_records([together, missing_kind_status(inventory, together)])
