"""Structured records, inventories and listings."""

import random
import time

import pytest
from pyspark.sql import functions as F

from mementa.operators import inventories as V
from mementa.operators import listings as L
from mementa.operators import records as R

PAYLOAD = "backup_id string, source_path string, entry_index long, text string"


def payloads(spark, *texts, path="/b/f"):
    return spark.createDataFrame([("b", path, i, t) for i, t in enumerate(texts)], PAYLOAD)


def brief(frame):
    return [(r.id, r.title, r.subtitle) for r in frame.orderBy("id").collect()]


def test_contacts_walk_nested_objects_in_key_order(spark):
    first = 'xx{"z":{"name":"Zed"},"displayName":" Ada Lovelace ","phone":5,"email":"a@x","a":[{"givenName":"Bob","number":"1"}]}yy'
    second = '[{"formattedName":"Cid","email":"c@x"},{"name":""},{"name":7}]'
    got = brief(R.contacts(payloads(spark, first, second, path="/b/CONTACT")))
    assert got == [
        ("b:contact:/b/CONTACT:0", "Ada Lovelace", "a@x"),
        ("b:contact:/b/CONTACT:1", "Bob", "1"),
        ("b:contact:/b/CONTACT:2", "Zed", None),
        ("b:contact:/b/CONTACT:3", "Cid", "c@x"),
    ]


def test_wrapped_contact_and_repeated_keys(spark):
    got = brief(R.contacts(payloads(spark, '{"contacts":[{"formattedName":"Eve","email":"e@x"}]}')))
    assert got == [("b:contact:/b/f:0", "Eve", "e@x")]
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    assert brief(R.contacts(payloads(spark, '{"name":"A","name":"B"}'))) == [("b:contact:/b/f:0", "B", None)]
    assert brief(R.contacts(payloads(spark, "not json", "{broken"))) == []


def test_deep_json_is_no_loss(spark):
    text = '{"a":' * 5 + '{"name":"x"}' + "}" * 5
    frame = payloads(spark, text)
    assert R.json_objects(frame, levels=6).count() == R.json_objects(frame, levels=2).count() == 6
    deep = spark.createDataFrame([('{"a": [' * 60 + "1" + "]}" * 60,)], "text string")
    assert R.json_objects(deep).count() == 60


def test_browser_json_and_html(spark):
    history = '{"children":[{"title":"Example","url":"https://example.com"}],"name":" ","uri":"u"}'
    assert brief(R.browser_json(payloads(spark, history, path="/h.json"))) == [
        ("b:browser:/h.json:0", "u", "u"), ("b:browser:/h.json:1", "Example", "https://example.com")]
    page = '<p><a href="https://example.org"><b>Example</b> Org</a><a></a><a name=x>only text</a><article>q</article><a HREF="h"></a><a href="open'
    assert brief(R.browser_html(payloads(spark, page, path="/p.html"))) == [
        ("b:browser:/p.html:0", "Example Org", "https://example.org"),
        ("b:browser:/p.html:1", "only text", None),
        ("b:browser:/p.html:2", "q", None),
    ]


def test_call_log(spark):
    xml = """junk<?xml version="1.0"?><CallLogs><CallLog name="Ada" date="2026-06-21 &quot;noon&quot;"/>
      <CallLog number="5 > 4" type="out"></CallLog><!-- <CallLog name="no"/> --><CallLogX name="no"/>
      <CallLog text="name='fake'" phoneNumber='77' name=""/><CallLog/></CallLogs>tail"""
    assert brief(R.call_logs(payloads(spark, xml, path="/c"))) == [
        ("b:calllog:/c:0", "Ada", '2026-06-21 "noon"'), ("b:calllog:/c:1", "5 > 4", "out"),
        ("b:calllog:/c:2", "", None), ("b:calllog:/c:3", "Call log", None)]


def test_calendar_last_line_wins(spark):
    rows = [("b", "/a.ics", "SUMMARY:Draft\r\nX\r\nSUMMARY:Lunch\r\nDTSTART:1\r\nDTSTART;TZ=x:2"), ("b", "/b.VCS", "DTSTART:5\nDTSTART\n"), ("b", "/c.dat", "x")]
    got = {r.source_path: r for r in R.calendar(spark.createDataFrame(rows, "backup_id string, source_path string, text string")).collect()}
    assert (got["/a.ics"].id, got["/a.ics"].title, got["/a.ics"].subtitle) == ("b:/a.ics", "Lunch", "2")
    assert (got["/b.VCS"].title, got["/b.VCS"].subtitle) == ("Calendar event", None)
    assert (got["/c.dat"].title, got["/c.dat"].parse_status) == ("c.dat", "unsupported_calendar_file")


def test_notes(spark):
    rows = [("b", "/n.txt", "\n My note\nBodé"), ("b", "/n.sdocx", "Typed note\nBody\nCanvas text box"), ("b", "/x.sdoc", None), ("b", "/y.bin", None), ("b", "/e.md", "")]
    got = {r.source_path: r for r in R.notes(spark.createDataFrame(rows, "backup_id string, source_path string, text string")).collect()}
    assert (got["/n.txt"].title, got["/n.txt"].subtitle, got["/n.txt"].parse_status) == ("My note", "15 bytes", "parsed_text_note")
    assert (got["/n.sdocx"].title, got["/n.sdocx"].subtitle) == ("Typed note", "31 characters")
    assert got["/x.sdoc"].parse_status == got["/y.bin"].parse_status == "proprietary_note_payload"
    assert (got["/e.md"].title, got["/e.md"].subtitle) == ("Samsung note", "0 bytes")


def phone(spark, *paths):
    rows = [("b", "L", "/r", f"/r/{p}", p, 9, p.endswith("/")) for p in paths]
    rows = [(b, l, r, a.rstrip("/"), p.rstrip("/"), s, d) for b, l, r, a, p, s, d in rows]
    return spark.createDataFrame(rows, "backup_id string, backup_label string, root_path string, absolute_path string, relative_path string, size_bytes long, is_dir boolean")


def test_apps_databases_and_status(spark):
    inv = phone(spark, "APK/example.apk", "DISABLEDAPPS/", "MESSAGE/msgstore.db.crypt14", "WhatsApp/x/photo.jpg", "CONTACT/Contact.SPBM", "SBROWSER/x.bin")
    apps = R.apps(inv)
    assert {(r.title, r.subtitle, r.parse_status) for r in apps.collect()} == {
        ("example", "9 bytes", "parsed_apk_inventory"), ("DISABLEDAPPS", None, "inventory_disabled_apps_payload")}
    dbs = R.message_databases(inv).collect()
    assert [(r.title, r.parse_status) for r in dbs] == [("msgstore.db.crypt14", "encrypted_whatsapp_message_database")]
    status = R.missing_kind_status(inv, apps).collect()
    assert [(r.id, r.title) for r in status] == [("b:contact:/r/CONTACT", "CONTACT")]
    parsed = R.contacts(payloads(spark, '{"name":"Ada"}'))
    assert R.missing_kind_status(inv, apps.unionByName(parsed)).count() == 0
    assert R.browser_status(inv, R.browser_json(payloads(spark, "{}"))).first().title == "SBROWSER"
    assert R.browser_status(inv, R.browser_json(payloads(spark, '{"title":"x"}'))).count() == 0


def test_all_records_together(spark):
    inv = phone(spark, "APK/a.apk", "CONTACT/c", "CALLLOG/c.zip", "SBROWSER/h.json")
    rows = [
        ("b", "calendar", "/r/CALENDER/a.ics", 0, "SUMMARY:Lunch"), ("b", "note", "/r/N/n.txt", 0, "My note"),
        ("b", "contact", "/r/CONTACT/c", 0, '{"name":"Ada"}'), ("b", "calllog", "/r/C", 0, "<CallLogs><CallLog name='x'/></CallLogs>"),
        ("b", "browser", "/r/SBROWSER/h.json", 0, '{"title":"t"}'), ("b", "browser", "/r/SBROWSER/h.htm", 0, '<a href="u">v</a>'),
    ]
    table = spark.createDataFrame(rows, "backup_id string, payload string, source_path string, entry_index long, text string")
    kinds = sorted(r.kind for r in R.structured_records(inv, table).collect())
    assert kinds == ["app", "browser", "browser", "calendar", "calllog", "contact", "note"]


def test_messages(spark):
    rows = [(None, "hello from whatsapp", 7), ("j", None, 1), ("j", "y" * 130, 9)]
    table = spark.createDataFrame(rows, "key_remote_jid string, data string, timestamp long")
    got = brief(R.messages(table, "/db"))
    assert got == [("whatsapp-message:/db:0", "hello from whatsapp", "7"), ("whatsapp-message:/db:1", "y" * 120, "j")]
    counts = R.message_counts(table, None).first()
    assert (counts.message_count, counts.chat_count) == (3, 0)


def test_item_metrics(spark):
    text = '{"ListItems":[{"ViewCount":12,"ContentCount":12,"Type":"CONTACT","Size":2048},{"Type":"MESSAGE","Size":4096}]}'
    frame = spark.createDataFrame([("b", "L", text), ("c", "M", "{}")], "backup_id string, backup_label string, text string")
    got = {(r.item_type, r.view_count, r.content_count, r.size_bytes) for r in V.item_metrics(frame).collect()}
    assert got == {("CONTACT", 12, 12, 2048), ("MESSAGE", 0, 0, 4096)}


def test_readable_xml(spark):
    heads = [bytes([0, 159, 146, 150]), b"<?xml \xff", b"plain", b"", bytes(127) + b"\x80", bytes(128) + b"\x80"]
    frame = spark.createDataFrame(list(enumerate(heads)), "i int, head binary")
    assert [r.o for r in frame.select("i", V.readable_xml("head").alias("o")).orderBy("i").collect()] == [False, True, True, True, False, True]


def test_archive_inventory(spark):
    rows = [("CALLLOG", "/a", 0, "x/call_log.exml", b"\xff"), ("CALLLOG", "/a", 1, "call_log.exml", b"<?xml"), ("CALLLOG", "/a", 2, "i/image/q", b""),
            ("CONTACT", "/c", 0, "a.json.enc", b""), ("CONTACT", "/c", 1, "p.jpg", b""), ("CONTACT", "/c", 2, "x/blob/y.png", b""), ("CONTACT", "/d", 0, "x", b"")]
    frame = spark.createDataFrame([("b", "L", *r) for r in rows], "backup_id string, backup_label string, item_type string, archive_path string, entry_index int, entry_name string, head binary")
    got = {r.archive_path: (r.entry_count, r.encrypted_entries, r.image_entries, r.blob_entries, r.parse_status) for r in V.archive_inventory(frame).collect()}
    assert got == {"/a": (3, 0, 1, 0, "xml_readable"), "/c": (3, 1, 2, 1, "encrypted_contact_payload"), "/d": (1, 0, 0, 0, "inventory_only")}
    folder = V.folder_inventory(phone(spark, "CALENDER/event.vcs"), ["CALENDER", "APK"]).first()
    assert (folder.entry_count, folder.parse_status, folder.archive_path) == (1, "inventory_only", "/r/CALENDER")
    empty = V.folder_inventory(phone(spark, "APK").withColumn("is_dir", F.lit(True)), ["CALENDER", "APK"]).first()
    assert (empty.entry_count, empty.archive_path) == (0, "/r/APK")


def test_unfinished_markup(spark):
    page = '<a href="/x">' * 20000 + "<a" * 20000
    rows = [("b", "/p", page + "</a>" + page), ("b", "/q", page)]
    frame = spark.createDataFrame(rows, "backup_id string, source_path string, text string")
    assert [r.source_path for r in R.browser_html(frame).collect()] == ["/p"]
    log = "<CallLogs><CallLog name='a'/><CallLog name='b'/>" + "<!--<CallLog name='c'/>" * 20000 + "</CallLogs>"
    calls = spark.createDataFrame([("b", "/c", log)], "backup_id string, source_path string, text string")
    assert [r.title for r in R.call_logs(calls).collect()] == ["a", "b"]


def test_call_log_ends_at_the_first_error(spark):
    row = "<CallLog name='%s'/>"
    cases = {
        "<CallLogs>" + row % "a" + "<!-- <b> -->" + row % "b" + "</CallLogs>": "ab",
        "<CallLogs>" + row % "a" + "</Other>" + row % "b" + "</CallLogs>": "a",
        "<CallLogs><x><y>" + row % "a" + "</x>" + row % "b" + "</CallLogs>": "a",
        "<CallLogs><x><y>" + row % "a" + "</y ></x>" + row % "b" + "</CallLogs>": "ab",
        "</CallLogs>" + row % "a" + "</CallLogs>": "",
        "<CallLogs>" + row % "a" + "<!x>" + row % "b" + "</CallLogs>": "a",
        "<CallLogs>" + row % "a" + "<![CDATA[" + row % "c" + "]]>" + row % "b" + "</CallLogs>": "ab",
        "<CallLogs>" + row % "a" + "<![CDATA[" + row % "b" + "</CallLogs>": "a",
        "<?xml version='1'?><!DOCTYPE x [<!ENTITY a 'b'>]><CallLogs>" + row % "a" + "<?pi <CallLog/> ?>" + row % "b" + "</CallLogs>": "ab",
        "<CallLogs>" + row % "a" + "a &amp; b" + row % "b" + "</CallLogs>": "ab",
        "<CallLogs>" + row % "a" + "a & b" + row % "b" + "</CallLogs>": "a",
        "<CallLogs>" + row % "a" + "<CallLog name='b></CallLogs>": "a",
        "<CallLogs>" + row % "a" + "<CallLog name='b'>x</CallLog></CallLogs>" + row % "c" + "</CallLogs>": "abc"[:2] + "c",
    }
    frame = spark.createDataFrame([("b", str(i), x) for i, x in enumerate(cases)], "backup_id string, source_path string, text string")
    got = {}
    for r in sorted(R.call_logs(frame).collect(), key=lambda r: r.id):
        got[int(r.source_path)] = got.get(int(r.source_path), "") + r.title
    assert [got.get(i, "") for i in range(len(cases))] == list(cases.values())


def plain_anchors(page):
    """The rule of the page parser, word for word: find an opening, its end, the next end tag."""
    out = []
    while (at := page.find("<a")) >= 0:
        page = page[at:]
        end = page.find(">")
        close = page.find("</a>", end + 1)
        if end < 0 or close < 0:
            break
        out.append((page[:end], page[end + 1 : close]))
        page = page[close + 4 :]
    return out


def stripped(html):
    out, inside = "", False
    for c in html:
        inside = True if c == "<" else False if c == ">" else inside
        out += c if not inside and c != ">" else ""
    return out.strip()


def test_anchors_follow_the_parser(spark):
    rng = random.Random(5)
    parts = ["<a", "<a href=\"u\"", ">", "</a>", "t", " ", "<b>", "</a", "<"]
    pages = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(pages)), "i int, text string")
    got = {r.i: [(a.title, a.url) for a in r.found] for r in frame.select("i", R.anchors(F.col("text")).alias("found")).collect()}
    for i, page in enumerate(pages):
        plain = [(stripped(inner), "u" if 'href="u"' in tag else None) for tag, inner in plain_anchors(page)]
        assert len(got[i]) == len([p for p in plain if p[0] or p[1]]), (page, got[i], plain)
        assert [g[1] for g in got[i]] == [p[1] for p in plain if p[0] or p[1]], page


@pytest.mark.parametrize("parse, unit, close", [(R.anchors, "<a ", "</a>"), (R.anchors, "<a></a>", ""), (R.anchors, "<a </a>", ""), (R.call_elements, "<CallLog ", ""), (R.call_elements, "<CallLog/>", ""), (R.call_elements, "<!--", "")])
def test_markup_takes_linear_time(spark, parse, unit, close):
    """Four times the text takes about four times as long, not sixteen times."""

    def seconds(n):
        frame = spark.range(1).select(F.concat(F.repeat(F.lit(unit), n), F.lit(close)).alias("text"))
        start = time.perf_counter()
        frame.select(parse(F.col("text")).alias("found")).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds(100)
    assert seconds(80_000) < 8 * seconds(20_000) + 0.5


def test_export_roots(spark):
    rows = [("/a", "x"), ("/b", "Takeout/x"), ("/c", "Archive Browser.html"), ("/d", "Takeout")]
    got = V.takeout_roots(spark.createDataFrame(rows, "root_path string, relative_path string"))
    assert {r.root_path: r.is_export for r in got.collect()} == {"/a": False, "/b": True, "/c": True, "/d": False}


def lines(spark, folder, text, device="d"):
    return spark.createDataFrame([(device, folder, i + 1, t) for i, t in enumerate(text.split("\n"))], "device string, folder string, line_no int, line string")


def test_listing(spark):
    found = lines(spark, "DCIM", "/sdcard/DCIM/photo.jpg\nfind: '/sdcard/Android/data': Permission denied\n ")
    row = L.listing_counts(found).first()
    assert (row.file_count, row.permission_denied) == (1, 1)
    sizes = spark.createDataFrame([("d", "DCIM", "12\t/sdcard"), ("d", "Music", "bad")], "device string, folder string, size_text string")
    preview = {r.key: (r.file_count, r.total_bytes, r.available) for r in L.listing_preview(found, sizes).collect()}
    assert len(preview) == 6 and preview["DCIM"] == (1, 12288, True) and preview["Music"] == (0, 0, False)
    assert L.selected_folders(found, None, "folder").count() == 3 and L.selected_folders(found, ["Music"], "folder").count() == 0


def test_devices(spark):
    text = "List of devices attached\nSERIAL1\tdevice\nSERIAL2 unauthorized usb:1\nSERIAL3\toffline\nlonely\n"
    frame = spark.createDataFrame([("h", i + 1, t) for i, t in enumerate(text.split("\n"))], "host string, line_no int, line string")
    rows = L.device_rows(frame).orderBy("line_no").collect()
    assert [(r.serial, r.status, r.redacted_id) for r in rows] == [
        ("SERIAL1", "device", "[redacted:IAL1]"), ("SERIAL2", "unauthorized", "[redacted:IAL2]"), ("SERIAL3", "offline", "[redacted:IAL3]")]
    assert {r.status: r.n_devices for r in L.device_status(frame).collect()} == {"device": 1, "unauthorized": 1, "offline": 1}


def test_message_database_choice(spark):
    current, old = "/sdcard/WhatsApp/Databases", "/storage/emulated/0/WhatsApp/Databases"
    dated = "msgstore-2026-06-19.1.db.crypt15\nmsgstore-2026-06-21.1.db.crypt15\nmsgstore-2026-06-20.1.db.crypt15"
    frame = (
        lines(spark, current, dated + "\nmsgstore.db.crypt15\nmsgstore.db.crypt14", "a")
        .unionByName(lines(spark, current, dated, "b")).unionByName(lines(spark, old, "msgstore.db.crypt15", "b"))
        .unionByName(lines(spark, old, "chatsettings.db", "c"))
    )
    got = {r.device: (r.remote_path, r.format) for r in L.message_db_choice(frame).collect()}
    assert got == {"a": (f"{current}/msgstore.db.crypt15", "crypt15"), "b": (f"{current}/msgstore-2026-06-21.1.db.crypt15", "crypt15")}


def test_contacts_are_numbered_over_blocks_and_parsed_once(spark, monkeypatch):
    frame = payloads(spark, *[f'[{{"name": "a{i}"}}, {{"x": [{{"name": "b{i}"}}]}}]' for i in range(5)])
    plan = R.json_objects(frame)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parse_json") + plan.count("parsejson") == 1
    monkeypatch.setattr(R, "ORDINAL_BLOCK", 2)
    got = {r.title: r.id for r in R.contacts(frame).collect()}
    assert got == {f"{n}{i}": f"b:contact:/b/f:{2 * i + k}" for i in range(5) for k, n in enumerate("ab")}
