"""DuckDB twins of the queries, over the same whole tables."""

from __future__ import annotations

EXT = "(['jpg','png','mp4','mp3','pdf','txt','bin',NULL])[doc_id % 8 + 1]"
FOLDER = "(['Photo','Video','Music','Documents','Misc'])[doc_id % 5 + 1]"
IMPORTED = "('src0','src1','src2','src3','src4','src5','src6','src7','src8','src9')"


def category(ext: str, path: str) -> str:
    return f"""CASE WHEN {ext} IN ('jpg','png') THEN 'photo' WHEN {ext} = 'mp4' THEN 'video'
      WHEN {ext} = 'mp3' THEN 'music' WHEN {ext} IN ('pdf','txt') THEN 'documents'
      WHEN lower(split_part({path}, '/', 1)) IN ('photo','video','music','documents')
        THEN lower(split_part({path}, '/', 1)) ELSE 'other' END"""


def storage(root: str, h: str = "content_hash", ext: str = "extension") -> str:
    return f"'{root}/objects/' || substr({h}, 1, 2) || '/' || {h} || coalesce('.' || {ext}, '')"


def uuid5(expr: str) -> str:
    digest = f"sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode({expr}))"
    return f"""(SELECT substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' ||
      translate(substr(h,17,1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h,18,3) || '-' || substr(h,21,12)
      FROM (SELECT {digest} AS h))"""


# Named building blocks; a query lists the ones it needs in order.
CTE = {
    "inv": f"""inv AS (SELECT *, root_path || '/' || relative_path AS absolute_path FROM (
      SELECT doc_id AS id, source AS backup_id, '/backups/' || source AS root_path, {EXT} AS extension,
        {FOLDER} || '/' || source || '/' || doc_id || coalesce('.' || {EXT}, '') AS relative_path,
        CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes,
        CASE WHEN doc_id % 11 <> 0 THEN 1700000000 + (doc_id * 7919) % 1000000 END AS modified_unix,
        sha256(text) AS content_hash, text FROM documents))""",
    "files": f"""files AS (SELECT *, {category('extension', 'relative_path')} AS category,
      backup_id AS source FROM inv)""",
    "prior": f"""prior AS (SELECT content_hash AS hash, size_bytes, extension, {storage('/library')} AS storage_path
      FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY id) AS rn FROM inv
            WHERE backup_id IN {IMPORTED}) WHERE rn = 1)""",
    "previous": f"""previous AS (SELECT * REPLACE (CASE WHEN id % 7 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes)
      FROM files WHERE backup_id IN {IMPORTED})""",
    "ranked": """ranked AS (SELECT *, row_number() OVER (PARTITION BY content_hash
        ORDER BY relative_path, absolute_path) AS rn,
      row_number() OVER (PARTITION BY content_hash ORDER BY relative_path DESC, absolute_path DESC) AS rev
      FROM inv)""",
    "acts": """acts AS (SELECT *, CASE WHEN rn = 1 AND content_hash NOT IN (SELECT hash FROM prior)
      THEN 'copied' ELSE 'duplicate' END AS action FROM ranked)""",
    "outside": f"""outside AS (SELECT DISTINCT content_hash FROM (
        SELECT storage_path AS absolute_path, hash AS content_hash FROM prior UNION ALL
        SELECT absolute_path, content_hash FROM inv WHERE backup_id NOT IN {IMPORTED})
      WHERE NOT (absolute_path = '/library' OR starts_with(absolute_path, '/library/')))""",
    "grp": """grp AS (SELECT content_hash, count(*) AS n_files,
        (count(*) - 1) * first(size_bytes ORDER BY coalesce(modified_unix, 9223372036854775807), id) AS reclaimable_bytes,
        first(size_bytes ORDER BY coalesce(modified_unix, 9223372036854775807), id) AS size_bytes,
        first(id ORDER BY coalesce(modified_unix, 9223372036854775807), id) AS oldest_id,
        first(id ORDER BY starts_with(lower(split_part(relative_path, '/', -1)), 'duplicate'),
              coalesce(modified_unix, 9223372036854775807), id) AS keep_id
      FROM files GROUP BY content_hash HAVING count(*) >= 2)""",
    "member": """member AS (SELECT f.*, g.n_files, g.reclaimable_bytes, f.id = g.oldest_id AS is_oldest,
        f.id <> g.keep_id AS preselected FROM files f JOIN grp g USING (content_hash))""",
    "cov": """cov AS (SELECT backup_id, 'Backup ' || backup_id AS label, root_path AS source_path,
        CAST(substr(backup_id, 4) AS BIGINT) AS imported_at, count(*) AS total_files,
        count(p.hash) AS covered_files, CAST(coalesce(sum(p.size_bytes), 0) AS BIGINT) AS total_bytes,
        CAST(coalesce(sum(p.size_bytes), 0) AS BIGINT) AS covered_bytes,
        CASE WHEN count(*) = 0 THEN 0.0 ELSE CAST(count(p.hash) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0 END AS coverage_percent,
        CAST(CASE WHEN count(*) = count(p.hash) THEN coalesce(sum(p.size_bytes), 0) ELSE 0 END AS BIGINT) AS reclaimable_bytes,
        count(*) = count(p.hash) AS safe_to_delete
      FROM inv LEFT JOIN prior p ON p.hash = inv.content_hash GROUP BY backup_id, root_path)""",
    "grids": """grids AS (SELECT id, size_bytes, width, CASE WHEN size_bytes >= 272 THEN
          list_transform(range(0, 272), lambda i: CAST(list_sum(codes[i * size_bytes // 272 + 1 : (i + 1) * size_bytes // 272])
            // ((i + 1) * size_bytes // 272 - i * size_bytes // 272) AS INT)) END AS luma
      FROM (SELECT doc_id AS id, n, n AS size_bytes, 300 + n_chars % 8 AS width,
              list_transform(range(0, n), lambda j: 16 * (strpos('0123456789ABCDEF', substr(hex_text, CAST(2 * j + 1 AS INT), 1)) - 1)
                + strpos('0123456789ABCDEF', substr(hex_text, CAST(2 * j + 2 AS INT), 1)) - 1) AS codes
            FROM (SELECT doc_id, n_chars, hex(encode(text)) AS hex_text, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents)))""",
    "signed": """signed AS (SELECT id, size_bytes,
        CAST(round(CAST(CAST((least(greatest(CAST(log2(CAST(width AS FLOAT) / CAST(200 AS FLOAT)) AS FLOAT), CAST(-2 AS FLOAT)), CAST(2 AS FLOAT)) + CAST(2 AS FLOAT)) / CAST(4 AS FLOAT) AS FLOAT) * CAST(254 AS FLOAT) AS FLOAT)) AS INT) AS aspect_q,
        CASE WHEN list_max(luma) - list_min(luma) >= 10 THEN array_to_string(list_transform(range(0, 256),
          lambda b: CASE WHEN luma[b // 16 * 17 + b % 16 + 1] < luma[b // 16 * 17 + b % 16 + 2] THEN '1' ELSE '0' END), '') END AS bits
      FROM grids)""",
    "sigs": """sigs AS (SELECT min(id) AS sid, aspect_q, CAST(bits AS BIT) AS sig FROM signed WHERE bits IS NOT NULL
      GROUP BY aspect_q, bits)""",
    "edge": """edge AS (SELECT a.sid AS a, b.sid AS b FROM sigs a JOIN sigs b
        ON a.sid <> b.sid AND abs(a.aspect_q - b.aspect_q) <= 8 AND bit_count(xor(a.sig, b.sig)) <= 24)""",
    "reach": """reach(a, b) AS (SELECT sid, sid FROM sigs UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)""",
    "comp": """comp AS (SELECT a AS sid, min(b) AS component FROM reach GROUP BY a)""",
    "look": """look AS (SELECT s.id, s.size_bytes, c.component FROM signed s JOIN sigs g
        ON s.aspect_q = g.aspect_q AND CAST(s.bits AS BIT) = g.sig JOIN comp c ON c.sid = g.sid)""",
    "lookgrp": """lookgrp AS (SELECT component, 'sim-' || first(id ORDER BY size_bytes DESC, id) AS group_key,
        count(*) AS n_files, max(size_bytes) AS size_bytes,
        CAST(sum(size_bytes) - max(size_bytes) AS BIGINT) AS reclaimable_bytes,
        first(id ORDER BY size_bytes DESC, id) AS keep_id FROM look GROUP BY component HAVING count(*) >= 2)""",
    "src": """src AS (SELECT 'source-' || (s_suppkey % 97) AS id,
        (['adb-generic','generic-folder','samsung-smartswitch','google-takeout','custom'])[s_suppkey % 5 + 1] AS adapter,
        s_name AS label, CASE WHEN s_suppkey % 5 <> 0 THEN '/sources/' || s_suppkey END AS path, s_suppkey AS seq FROM supplier)""",
    "adapters": """adapters(adapter, adapter_label) AS (VALUES ('adb-generic', 'Android device (ADB)'),
        ('generic-folder', 'Generic folder'), ('samsung-smartswitch', 'Samsung SmartSwitch'), ('google-takeout', 'Google Takeout'))""",
    "phone": """phone AS (SELECT *, root_path || '/' || relative_path AS absolute_path, split_part(relative_path, '/', 1) AS top,
        split_part(relative_path, '/', -1) AS name FROM (
      SELECT 'p' || (p_partkey % 50) AS backup_id, 'Phone ' || (p_partkey % 50) AS backup_label,
        '/phones/p' || (p_partkey % 50) AS root_path, CAST(p_size AS BIGINT) AS size_bytes, p_partkey AS seq,
        (['APK','GALAXYSTORE','DISABLEDAPPS','MESSAGE','WhatsApp','CONTACT','SBROWSER','CALENDER'])[p_partkey % 8 + 1] || '/' || p_partkey || '/' ||
        CASE WHEN p_partkey % 8 < 3 THEN CASE WHEN p_partkey % 10 < 6 THEN 'App.v1.apk' ELSE 'notes.txt' END
          ELSE (['msgstore.db.crypt14','WA.DB','x.crypt15','readme.md'])[p_partkey // 8 % 4 + 1] END AS relative_path FROM part))""",
    "apprec": """apprec AS (SELECT backup_id, backup_id || ':app:' || absolute_path AS id, 'app' AS kind, 'App.v1' AS title,
        size_bytes || ' bytes' AS subtitle, absolute_path AS source_path, 'parsed_apk_inventory' AS parse_status
      FROM phone WHERE top IN ('APK','GALAXYSTORE','DISABLEDAPPS') AND name LIKE '%.apk'
      UNION ALL
      SELECT backup_id, backup_id || ':app:' || root_path || '/' || top, 'app', top, NULL, root_path || '/' || top,
        CASE top WHEN 'APK' THEN 'inventory_apk_payload' WHEN 'GALAXYSTORE' THEN 'inventory_app_store_payload'
          ELSE 'inventory_disabled_apps_payload' END
      FROM phone WHERE top IN ('APK','GALAXYSTORE','DISABLEDAPPS') GROUP BY backup_id, root_path, top
      HAVING count(*) FILTER (name LIKE '%.apk') = 0)""",
    "dbrec": """dbrec AS (SELECT backup_id, backup_id || ':whatsapp_message:' || absolute_path AS id, 'whatsapp_message' AS kind,
        name AS title, CAST(NULL AS VARCHAR) AS subtitle, absolute_path AS source_path,
        'encrypted_whatsapp_message_database' AS parse_status FROM phone
      WHERE top IN ('MESSAGE','WhatsApp') AND regexp_matches(lower(name), '^(msgstore|wa\\.db).*|.*\\.crypt1[245]$'))""",
    "calrec": """calrec AS (SELECT CASE o_orderkey % 3 WHEN 2 THEN o_orderstatus || ':calendar:' || p ELSE o_orderstatus || ':' || p END AS id,
        'calendar' AS kind, CASE o_orderkey % 3 WHEN 2 THEN o_orderkey || '.dat' ELSE 'Order ' || o_orderkey END AS title,
        CASE o_orderkey % 3 WHEN 1 THEN strftime(o_orderdate, '%Y%m%d') END AS subtitle, p AS source_path,
        CASE o_orderkey % 3 WHEN 2 THEN 'unsupported_calendar_file' ELSE 'parsed_text_calendar' END AS parse_status
      FROM (SELECT *, '/k/' || o_orderkey || '.' || (['ics','VCS','dat'])[o_orderkey % 3 + 1] AS p FROM orders))""",
    "items": """items AS (SELECT 'e' || event_id AS backup_id, 'Event ' || event_id AS backup_label,
        upper(event_type) AS item_type, CASE WHEN event_id % 3 <> 0 THEN user_id ELSE 0 END AS view_count,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS content_count,
        CASE WHEN event_id % 5 <> 0 THEN event_id * 10 ELSE 0 END AS size_bytes FROM events
      UNION ALL SELECT 'e' || event_id, 'Event ' || event_id, 'MESSAGE', 0, 1, 4096 FROM events)""",
    "entries": """entries AS (SELECT 'b' || (l_suppkey % 10) AS backup_id, 'Backup ' || (l_suppkey % 10) AS backup_label,
        (['CONTACT','CALLLOG','OTHER'])[l_orderkey % 3 + 1] AS item_type, '/a/' || l_orderkey || '.zip' AS archive_path,
        l_linenumber * 100000 + l_partkey % 100000 AS entry_index,
        (['a/image/x.bin','p.jpg','q.png','c.json.enc','d/blob/z','u/call_log.exml','call_log.exml'])[l_linenumber] AS entry_name,
        (l_orderkey + l_linenumber) % 4 <> 0 AS readable FROM lineitem)""",
    "lst": """lst AS (SELECT 'dev' || (o_custkey % 40) AS device,
        (['DCIM','Pictures','Download','Movies','Music'])[o_custkey % 5 + 1] AS folder, o_orderkey AS line_no,
        o_orderkey % 10 AS kind FROM orders)""",
    "msg": """msg AS (SELECT CAST(conv_id AS VARCHAR) AS key_remote_jid, text AS data, turn AS timestamp FROM conversations)""",
    "top100": """top100 AS (SELECT *, row_number() OVER (ORDER BY timestamp, key_remote_jid, data) - 1 AS rn FROM msg
      QUALIFY rn < 100)""",
    "msgrec": """msgrec AS (SELECT 'whatsapp-message:/db/msgstore.db:' || rn AS id, 'whatsapp_message' AS kind,
        left(data, 120) AS title, key_remote_jid AS subtitle, '/db/msgstore.db' AS source_path,
        'parsed_decrypted_whatsapp_message' AS parse_status FROM top100)""",
    "synced": """synced AS (SELECT s.*, split_part(s.relative_path, '/', 1) AS folder,
        substr(s.relative_path, strpos(s.relative_path, '/') + 1) AS inner_path, t.target_size
      FROM inv s LEFT JOIN (SELECT relative_path, CASE WHEN id % 9 = 0 THEN size_bytes + 1 ELSE size_bytes END AS target_size
        FROM inv WHERE backup_id IN ('src0','src1','src2','src3','src4','src5','src6','src7','src8','src9')) t USING (relative_path)
      WHERE split_part(s.relative_path, '/', 1) IN ('Photo','Video','Music','Documents'))""",
    "syncact": """syncact AS (SELECT absolute_path, folder AS destination, inner_path, size_bytes,
        CASE WHEN target_size IS NULL THEN 'copied' ELSE 'skipped' END AS action,
        CASE WHEN target_size <> size_bytes THEN 'Skipped existing file with different size: /media/' || relative_path END AS error
      FROM synced)""",
    "wish": """wish AS (SELECT DISTINCT split_part(relative_path, '/', 1) AS category FROM inv UNION ALL
      SELECT DISTINCT backup_id FROM inv)""",
    "verdicts": """verdicts AS (SELECT category, CASE WHEN category IN ('Photo','Video','Music','Documents') THEN 'ok' ELSE 'unsupported' END AS verdict,
        CASE WHEN category NOT IN ('Photo','Video','Music','Documents') THEN 'Unsupported category: ' || category END AS error FROM wish)""",
    "purge": """purge AS (SELECT absolute_path, verdict, CASE verdict
          WHEN 'refused' THEN 'Refused to trash a file inside the library''s own storage: ' || absolute_path
          WHEN 'missing' THEN 'File no longer exists: ' || absolute_path END AS error FROM (
        SELECT absolute_path, CASE WHEN starts_with(absolute_path, '/library/objects/') THEN 'refused'
          WHEN absolute_path IN (SELECT absolute_path FROM files WHERE modified_unix IS NOT NULL) THEN 'eligible' ELSE 'missing' END AS verdict
        FROM (SELECT absolute_path FROM inv UNION SELECT storage_path FROM prior UNION
              SELECT '/library/objects2' || absolute_path FROM inv)))""",
    "a": """a AS (SELECT page_id, unnest(l) AS el, generate_subscripts(l, 1) - 1 AS pos FROM (
        SELECT page_id, regexp_extract_all(html, '(?s)<a[^>]*>.*?</a>') AS l FROM pages))""",
}


def sql(blocks: str, body: str) -> str:
    """WITH the named blocks (space separated), then the body."""
    names = blocks.split()
    head = "WITH RECURSIVE " if "reach" in names else "WITH "
    return (head + ",\n".join(CTE[n] for n in names) + "\n" if names else "") + body


RECORD = "id, kind, title, subtitle, source_path, parse_status"
SIGN = "signed sigs edge reach comp look lookgrp"
LINE80 = r"""left(regexp_replace(regexp_extract(text, '[^\s\p{Z}][^\n]*'), '[\s\p{Z}]+$', ''), 80)"""
STRIP = r"""regexp_replace(replace(regexp_replace(%s, '<[^>]*>?', '', 'g'), '>', ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"""


def byte_text(v: str) -> str:
    def one(div: str, unit: str) -> str:
        return f"printf('%.1f {unit}', floor(CAST({v} AS DOUBLE) / {div} * 10 + 0.5) / 10)"

    return f"""CASE WHEN {v} <= 0 THEN '0 B' WHEN {v} < 1024 THEN printf('%.0f B', CAST({v} AS DOUBLE))
      WHEN {v} < 1048576 THEN {one('1024.0', 'KB')} WHEN {v} < 1073741824 THEN {one('1048576.0', 'MB')}
      WHEN {v} < 1099511627776 THEN {one('1073741824.0', 'GB')} ELSE {one('1099511627776.0', 'TB')} END"""


LABEL = "CASE {0} WHEN 'photo' THEN 'Photos' WHEN 'video' THEN 'Videos' WHEN 'music' THEN 'Music' WHEN 'documents' THEN 'Documents' WHEN 'other' THEN 'Other' ELSE {0} END"
FIVE = "(['DCIM','Pictures','Download','Movies','Music'])"
KIB = "CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_custkey * 3 * 1024 END"
NEW = "content_hash NOT IN (SELECT hash FROM prior)"
PLAN = f"""SELECT count(*) AS total_files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes,
  count(*) FILTER ({NEW}) AS new_files, CAST(coalesce(sum(size_bytes) FILTER ({NEW}), 0) AS BIGINT) AS new_bytes,
  count(*) FILTER (NOT ({NEW})) AS duplicate_files,
  CAST(coalesce(sum(size_bytes) FILTER (NOT ({NEW})), 0) AS BIGINT) AS duplicate_bytes,
  count(*) FILTER ({NEW} AND content_hash IN (SELECT content_hash FROM outside)) AS already_on_computer FROM inv"""
COPIED = "action = 'copied'"
RUN = f"""SELECT count(*) AS total_files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes,
  count(*) FILTER ({COPIED}) AS new_files, CAST(coalesce(sum(size_bytes) FILTER ({COPIED}), 0) AS BIGINT) AS new_bytes,
  count(*) FILTER (NOT ({COPIED})) AS duplicate_files,
  CAST(coalesce(sum(size_bytes) FILTER (NOT ({COPIED})), 0) AS BIGINT) AS duplicate_bytes,
  count(*) FILTER ({COPIED} AND content_hash IN (SELECT content_hash FROM outside)) AS already_on_computer,
  count(*) FILTER ({COPIED}) AS copied_files, CAST(coalesce(sum(size_bytes) FILTER ({COPIED}), 0) AS BIGINT) AS copied_bytes,
  count(*) AS occurrences_recorded FROM acts"""
CALLS = """SELECT o_orderstatus || ':calllog:/c/' || o_orderkey || '/CALLLOG.zip:' || n AS id, 'calllog' AS kind,
  CASE n WHEN 0 THEN 'Clerk "' || o_orderkey || '" & Co' ELSE '+' || o_custkey END AS title,
  CASE n WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '7' END AS subtitle,
  '/c/' || o_orderkey || '/CALLLOG.zip' AS source_path, 'parsed_decrypted_calllog' AS parse_status
  FROM orders, (VALUES (0), (1)) v(n)"""
CONTACTS = """SELECT 'n' || c_nationkey || ':contact:/n' || c_nationkey || '/CONTACT/Contact.SPBM:' ||
    (2 * (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) + n) AS id, 'contact' AS kind,
  CASE n WHEN 0 THEN c_name ELSE c_mktsegment END AS title, CASE n WHEN 0 THEN c_mktsegment || '@example.org' END AS subtitle,
  '/n' || c_nationkey || '/CONTACT/Contact.SPBM' AS source_path, 'parsed_decrypted_contact' AS parse_status
  FROM (SELECT * FROM customer) CROSS JOIN (VALUES (0), (1)) v(n)"""
CONTACTS = CONTACTS.replace(
    "(2 * (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) + n)",
    "(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey, n) - 1)",
)

ORACLES: dict[str, str] = {
    "src_inventory": sql("inv", "SELECT absolute_path, relative_path, size_bytes, modified_unix, extension FROM inv"),
    "src_content_hash": sql("inv", "SELECT id, content_hash FROM inv"),
    "src_item_metrics": sql("items", "SELECT * FROM items"),
    "src_archive_entries": sql("entries", "SELECT archive_path, entry_index, entry_name, readable AND ((split_part(split_part(archive_path, '/', 3), '.', 1)::BIGINT + entry_index // 100000) % 4 <> 0) AS readable FROM entries"),
    "src_text_whole": "SELECT '/b/SBROWSER/' || page_id || '.html' AS source_path, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes, html AS text FROM pages",
    "src_text_lines": """SELECT conv_id, turn, CAST(generate_subscripts(l, 1) - 1 AS INT) AS line_no, unnest(l) AS line FROM (
        SELECT conv_id, turn, regexp_split_to_array(text, '\\r?\\n') AS l FROM conversations)""",
    "src_messages": sql("msg", "SELECT * FROM msg"),
    "src_listing_lines": sql("lst", """SELECT device, folder, line_no, CASE kind WHEN 0 THEN '  ' WHEN 1 THEN 'find: ''/x/' || line_no || ''': Permission denied'
        ELSE ' /sdcard/' || folder || '/' || line_no || '.jpg ' END AS line FROM lst"""),
    "src_registry": sql("src adapters", "SELECT adapter, adapter_label, count(s.seq) AS n_sources FROM adapters LEFT JOIN src s USING (adapter) GROUP BY ALL"),
    "src_index": sql("inv files", "SELECT id, absolute_path, category FROM files WHERE category = 'documents'"),
    "sink_files_upsert": sql("inv files previous", """SELECT absolute_path, id, size_bytes, modified_unix, category,
        CASE WHEN id % 13 <> 0 THEN content_hash END AS content_hash FROM files
      UNION ALL SELECT '/gone' || absolute_path, id, size_bytes, modified_unix, category, content_hash FROM previous"""),
    "sink_scan_runs": sql("inv", "SELECT root_path, count(*) AS scanned_files, count(*) AS indexed_files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM inv GROUP BY 1"),
    "sink_contents": sql("inv prior ranked acts", f"SELECT content_hash AS hash, size_bytes, extension, {storage('/library')} AS storage_path FROM acts WHERE action = 'copied'"),
    "sink_backups": f"""SELECT source AS id, CASE WHEN source IN {IMPORTED} THEN 'adb-generic' ELSE 'generic-folder' END AS adapter,
        'Backup ' || source AS label, '/backups/' || source AS source_path, CAST(substr(source, 4) AS BIGINT) AS imported_at
        FROM (SELECT DISTINCT source FROM documents)""",
    "sink_devices": """SELECT coalesce(CAST(c_custkey AS VARCHAR), CAST(s_suppkey AS VARCHAR)) AS id,
        CASE WHEN c_custkey IS NULL THEN s_name WHEN c_custkey % 4 <> 0 THEN c_name ELSE 'Unknown device' END AS label,
        CASE WHEN s_suppkey IS NOT NULL THEN 'maker' END AS manufacturer,
        CASE WHEN s_suppkey IS NOT NULL THEN s_suppkey ELSE c_custkey + 1000 END AS created_at
        FROM supplier FULL JOIN customer ON s_suppkey = c_custkey""",
    "sink_occurrences": sql("inv", "SELECT content_hash, backup_id, relative_path AS original_path, modified_unix AS original_mtime FROM inv"),
    "sink_manifest": sql("inv prior ranked acts", "SELECT 'run-1' AS run_id, relative_path AS original_path, content_hash, action, size_bytes FROM acts"),
    "sink_imported_index": sql("inv prior ranked", f"""SELECT '/library' AS root_path,
        coalesce(p.storage_path, {storage('/library', 'f.content_hash', 'f.extension')}) AS absolute_path, r.relative_path,
        {category('r.extension', 'r.relative_path')} AS category, 'Import' AS source, r.extension, r.size_bytes, r.modified_unix, r.content_hash
        FROM ranked r JOIN ranked f ON f.content_hash = r.content_hash AND f.rn = 1 LEFT JOIN prior p ON p.hash = r.content_hash WHERE r.rev = 1"""),
    "sink_objects": sql("inv prior ranked acts", "SELECT content_hash AS hash, substr(content_hash, 1, 2) AS shard, size_bytes AS n_bytes FROM acts WHERE action = 'copied'"),
    "sink_category_sync": sql("inv synced syncact", "SELECT absolute_path, destination, inner_path, size_bytes FROM syncact WHERE action = 'copied'"),
    "sink_delete_index": sql("inv files", "SELECT id, absolute_path FROM files WHERE modified_unix IS NULL"),
    "sink_recategorize": sql("inv files", "SELECT id, category FROM files"),
    "sink_hash_backfill": sql("inv", """SELECT id, CASE WHEN id % 3 = 0 OR count(*) OVER (PARTITION BY size_bytes) >= 2
        THEN content_hash END AS content_hash FROM inv"""),
    "fn_relative_path": sql("inv", "SELECT id, relative_path AS below, CASE WHEN length(root_path) = 12 AND length(backup_id) <= 3 OR starts_with(absolute_path, substr(root_path, 1, 12) || '/') THEN substr(absolute_path, 14) ELSE absolute_path END AS maybe_below FROM inv"),
    "fn_extension": r"""SELECT page_id, regexp_extract(url, '[^/]*$') AS name,
        CASE WHEN regexp_matches(regexp_extract(url, '[^/]*$'), '^.+\.[^.]*$') THEN lower(regexp_extract(url, '\.([^./]*)$', 1)) END AS extension FROM pages""",
    "fn_media_category": sql("inv", "SELECT id, CASE WHEN extension IN ('jpg','png') THEN 'photo' WHEN extension = 'mp4' THEN 'video' WHEN extension = 'mp3' THEN 'music' WHEN extension IN ('pdf','txt') THEN 'documents' END AS category FROM inv"),
    "fn_classify": sql("inv files", "SELECT id, category FROM files"),
    "fn_source": sql("inv", "SELECT id, backup_id AS source, 'local' AS flat FROM inv"),
    "fn_storage_path": sql("inv", f"SELECT id, {storage('/library')} AS storage_path FROM inv"),
    "fn_uuid5": sql("inv", "SELECT id, " + uuid5("'generic-folder:' || root_path") + " AS backup_uuid FROM inv"),
    "fn_run_id": sql("inv", "SELECT id, " + uuid5("'run:' || backup_id || ':' || id") + " AS run_uuid FROM inv"),
    "fn_redact": """SELECT c_custkey, '[redacted:' || right(c_name, 4) || ']' AS name,
        CASE WHEN c_custkey < 10000 THEN '[redacted]' ELSE '[redacted:' || right(CAST(c_custkey AS VARCHAR), 4) || ']' END AS key FROM customer""",
    "fn_backup_timestamp": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') END AS stamp FROM orders",
    "fn_dup_named": "SELECT doc_id AS id, doc_id % 3 = 0 AS dup_named FROM documents",
    "fn_shorten_path": sql("inv", r"""SELECT id, '.../' || relative_path AS long_path,
        CASE WHEN id % 2 = 0 THEN 'Not selected yet' ELSE 'a\' || backup_id END AS short_path FROM inv"""),
    "fn_title80": f"SELECT doc_id, nullif({LINE80}, '') AS title FROM documents",
    "fn_title120": sql("msg", "SELECT key_remote_jid, timestamp, left(data, 120) AS title FROM msg"),
    "fn_first_string": """SELECT c_custkey AS entry_index, CASE n WHEN 0 THEN NULL WHEN 1 THEN c_name ELSE c_mktsegment END AS title,
        CASE n WHEN 1 THEN c_mktsegment || '@example.org' END AS subtitle FROM customer, (VALUES (0), (1), (2)) v(n)""",
    "fn_strip_html": f"SELECT page_id, {STRIP % 'html'} AS plain FROM pages",
    "fn_href": """SELECT page_id, CAST(pos AS INT) AS n, CASE WHEN regexp_matches(tag, 'href="[^"]*"') THEN regexp_extract(tag, 'href="([^"]*)"', 1) END AS href,
        CASE WHEN regexp_matches(tag, 'href="[^"]*"') THEN regexp_extract(tag, 'href="([^"]*)"', 1) END AS upper_href FROM (
        SELECT page_id, unnest(l) AS tag, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a[^>]*') AS l FROM pages))""",
    "fn_json_region": """SELECT c_custkey AS entry_index, '{"contacts":[{"displayName":" ' || c_name || ' ","phone":' || c_custkey || ',"email":"' || c_mktsegment ||
        '@example.org","group":{"displayName":"","name":"' || c_mktsegment || '"}}]}' AS region FROM customer""",
    "fn_xml_region": """SELECT '/c/' || o_orderkey || '/CALLLOG.zip' AS source_path, '<?xml version=''1.0''?><CallLogs><CallLog name="Clerk &quot;' || o_orderkey ||
        '&quot; &amp; Co" type="in" date="' || strftime(o_orderdate, '%Y-%m-%d') || '"/><!-- <CallLog name="no"/> --><CallLog number=''+' || o_custkey ||
        ''' duration="7"></CallLog></CallLogs>' AS region FROM orders""",
    "fn_wa_format": """SELECT 'dev' || o_custkey AS device, (['/storage/emulated/0/Android/media/com.whatsapp/WhatsApp/Databases','/sdcard/WhatsApp/Databases','/storage/emulated/0/WhatsApp/Databases'])[o_orderkey % 3 + 1] AS folder,
        ' ' || CASE o_custkey % 6 WHEN 0 THEN 'msgstore.db.crypt14' WHEN 1 THEN 'chatsettings.db' ELSE 'msgstore-' || strftime(o_orderdate, '%Y-%m-%d') || '.1.db.crypt15' END || ' ' AS line,
        CASE o_custkey % 6 WHEN 0 THEN 'crypt14' WHEN 1 THEN 'unknown' ELSE 'crypt15' END AS format FROM orders""",
    "fn_coverage_pct": sql("inv prior cov", "SELECT backup_id, coverage_percent FROM cov"),
    "fn_kib_to_bytes": f"""SELECT 'dev' || (c_custkey % 40) AS device, {FIVE}[c_custkey % 5 + 1] AS folder,
        CASE WHEN c_custkey % 4 = 0 THEN 'du: error' ELSE (c_custkey * 3) || chr(9) || '/sdcard/x' END AS size_text, {KIB} AS n_bytes FROM customer""",
    "fn_aspect_q": """SELECT p_partkey, CASE WHEN p_size = 0 OR p_partkey % 40 = 0 THEN 127 ELSE
        CAST(round(CAST(CAST((least(greatest(CAST(log2(CAST(p_size AS FLOAT) / CAST(p_partkey % 40 AS FLOAT)) AS FLOAT), CAST(-2 AS FLOAT)), CAST(2 AS FLOAT)) + CAST(2 AS FLOAT)) / CAST(4 AS FLOAT) AS FLOAT) * CAST(254 AS FLOAT) AS FLOAT)) AS INT) END AS aspect_q FROM part""",
    "fn_dhash256": sql("grids signed", "SELECT id, bits FROM signed"),
    "fn_hamming": sql("grids signed", "SELECT id, CAST(length(replace(bits, '0', '')) AS BIGINT) AS n_bits FROM signed"),
    "fn_format_bytes": sql("inv", f"SELECT id, {byte_text('size_bytes')} AS small, {byte_text('(size_bytes * 1000)')} AS medium, {byte_text('(size_bytes * 1000000000)')} AS large, '0 B' AS none FROM inv"),
    "fn_format_count": sql("inv", "SELECT id, format('{:,}', size_bytes * 1001) AS count_text FROM inv"),
    "fn_format_date": sql("inv", "SELECT id, CASE WHEN coalesce(modified_unix, 0) = 0 THEN '—' ELSE strftime(make_timestamp(modified_unix * 1000000), '%b %-d, %Y') END AS date_text FROM inv"),
    "fn_category_label": sql("inv files", f"SELECT id, {LABEL.format('category')} AS label, {LABEL.format('source')} AS source_label FROM files"),
    "flt_category": sql("inv files", "SELECT id, category FROM files WHERE category = 'photo'"),
    "flt_path_within": sql("inv", "SELECT id, absolute_path FROM inv WHERE absolute_path = '/backups/src1' OR starts_with(absolute_path, '/backups/src1/')"),
    "flt_regular_file": sql("inv", "SELECT id, absolute_path FROM inv"),
    "flt_unchanged": sql("inv files previous", "SELECT i.id, i.absolute_path FROM inv i JOIN previous p ON p.absolute_path = i.absolute_path AND p.size_bytes = i.size_bytes AND p.modified_unix IS NOT DISTINCT FROM i.modified_unix"),
    "flt_similar": sql("grids signed", """SELECT s.id FROM signed s, (SELECT * FROM signed WHERE bits IS NOT NULL ORDER BY id LIMIT 1) f
        WHERE s.bits IS NOT NULL AND abs(s.aspect_q - f.aspect_q) <= 8 AND bit_count(xor(CAST(s.bits AS BIT), CAST(f.bits AS BIT))) <= 24"""),
    "flt_selected_keys": sql("lst", "SELECT device, folder, line_no FROM lst WHERE folder IN ('DCIM', 'Music')"),
    "flt_supported_category": sql("inv wish verdicts", "SELECT * FROM verdicts"),
    "flt_message_db_file": sql("phone", r"SELECT seq, relative_path FROM phone WHERE regexp_matches(lower(name), '^(msgstore|wa\.db).*|.*\.crypt1[245]$')"),
    "flt_not_null_data": sql("msg", "SELECT key_remote_jid, timestamp FROM msg WHERE timestamp <> 1"),
    "flt_thumbnail_needed": sql("inv files", "SELECT id, category = 'photo' AND coalesce(extension = 'png', false) AS needs_thumbnail FROM files"),
    "flt_takeout_root": sql("inv", "SELECT root_path, bool_or(starts_with(relative_path, 'Misc/src1')) AS is_export FROM inv GROUP BY 1"),
    "flt_source_kind": sql("src", "SELECT seq, 'phone' AS kind FROM src WHERE adapter = 'adb-generic' UNION ALL SELECT seq, 'backup' FROM src WHERE path IS NOT NULL"),
    "join_coverage": sql("inv prior cov", "SELECT backup_id, total_files, covered_files, covered_bytes FROM cov"),
    "join_content_exists": sql("inv prior", "SELECT DISTINCT content_hash FROM inv WHERE content_hash IN (SELECT hash FROM prior)"),
    "join_indexed_outside": sql("inv prior outside", "SELECT DISTINCT content_hash FROM inv WHERE content_hash IN (SELECT content_hash FROM outside)"),
    "join_reuse_hash": sql("inv files previous", """SELECT i.id, p.id IS NOT NULL AS unchanged, p.content_hash AS reused_hash FROM inv i LEFT JOIN previous p
        ON p.absolute_path = i.absolute_path AND p.size_bytes = i.size_bytes AND p.modified_unix IS NOT DISTINCT FROM i.modified_unix"""),
    "join_canonical_path": sql("inv prior ranked", f"SELECT content_hash, coalesce(p.storage_path, {storage('/elsewhere', 'r.content_hash', 'r.extension')}) AS absolute_path FROM ranked r LEFT JOIN prior p ON p.hash = r.content_hash WHERE rev = 1"),
    "join_sync_target": sql("inv synced syncact", "SELECT absolute_path, action, error FROM syncact"),
    "join_similar_pairs": sql("grids signed sigs edge reach comp", "SELECT sid, component FROM comp"),
    "join_protected_roots": sql("inv files prior purge", "SELECT absolute_path, error FROM purge WHERE verdict = 'refused'"),
    "join_adapter_label": sql("src adapters", "SELECT seq, adapter, coalesce(adapter_label, adapter) AS adapter_label FROM src LEFT JOIN adapters USING (adapter)"),
    "join_status_suppression": sql("phone", "SELECT DISTINCT backup_id || ':contact:' || root_path || '/CONTACT' AS id, 'contact' AS kind, 'CONTACT' AS title, CAST(NULL AS VARCHAR) AS subtitle, root_path || '/CONTACT' AS source_path, 'encrypted_or_proprietary_payload' AS parse_status FROM phone WHERE top = 'CONTACT'"),
    "agg_category_metrics": sql("inv files", "SELECT c.position, c.category, count(f.id) AS n_files, CAST(coalesce(sum(f.size_bytes), 0) AS BIGINT) AS n_bytes FROM (VALUES (0, 'photo'), (1, 'video'), (2, 'music'), (3, 'documents')) c(position, category) LEFT JOIN files f USING (category) GROUP BY ALL"),
    "agg_library_totals": sql("inv files src", "SELECT (SELECT count(*) FROM files WHERE category <> 'other') AS n_files, (SELECT CAST(sum(size_bytes) AS BIGINT) FROM files WHERE category <> 'other') AS n_bytes, count(*) AS n_sources, count(*) FILTER (adapter = 'adb-generic') AS n_phones, count(path) AS n_backups FROM src"),
    "agg_index_summary": sql("inv", "SELECT count(*) AS scanned_files, count(*) AS indexed_files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM inv"),
    "agg_coverage": sql("inv prior cov", "SELECT * FROM cov"),
    "agg_size_collision": sql("inv", "SELECT size_bytes, count(*) AS n_files FROM inv GROUP BY 1 HAVING count(*) >= 2"),
    "agg_duplicate_groups": sql("inv files grp", "SELECT * FROM grp"),
    "agg_similar_groups": sql("grids " + SIGN, "SELECT group_key, n_files, size_bytes, reclaimable_bytes, keep_id FROM lookgrp"),
    "agg_scan_summary": sql("inv files grp", "SELECT count(*) AS total_groups, CAST(coalesce(sum(reclaimable_bytes), 0) AS BIGINT) AS reclaimable_bytes, (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM files GROUP BY size_bytes HAVING count(*) >= 2)) AS scanned_candidates FROM grp"),
    "agg_plan": sql("inv prior outside", PLAN),
    "agg_category_scan": sql("inv", """SELECT backup_id, split_part(relative_path, '/', 1) AS name, count(size_bytes) AS file_count, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_bytes,
        count(DISTINCT nullif(split_part(relative_path, '/', 2), '')) AS n_sub_sources FROM (SELECT backup_id, relative_path, size_bytes FROM inv
          UNION ALL SELECT DISTINCT backup_id, 'Music/empty', NULL FROM inv UNION ALL SELECT DISTINCT backup_id || '-empty', 'Video', NULL FROM inv)
        WHERE split_part(relative_path, '/', 1) IN ('Photo','Video','Music','Documents') GROUP BY 1, 2"""),
    "agg_folder_inventory": sql("phone", "SELECT backup_id, backup_label, top AS item_type, root_path || '/' || top AS archive_path, count(file) AS entry_count, CAST(0 AS BIGINT) AS encrypted_entries, CAST(0 AS BIGINT) AS image_entries, CAST(0 AS BIGINT) AS blob_entries, 'inventory_only' AS parse_status FROM (SELECT backup_id, backup_label, root_path, top, 1 AS file FROM phone UNION ALL SELECT DISTINCT backup_id, backup_label, root_path, 'CALENDER', NULL FROM phone UNION ALL SELECT DISTINCT backup_id || '-empty', backup_label, root_path || '-empty', 'APK', NULL FROM phone) WHERE top IN ('CALENDER', 'APK') GROUP BY ALL"),
    "agg_archive_inventory": sql("entries", """SELECT backup_id, backup_label, item_type, archive_path, count(*) AS entry_count,
        count(*) FILTER (entry_name LIKE '%.enc') AS encrypted_entries,
        count(*) FILTER (entry_name LIKE '%/image/%' OR entry_name LIKE '%.jpg' OR entry_name LIKE '%.png') AS image_entries,
        count(*) FILTER (entry_name LIKE '%/blob/%') AS blob_entries,
        CASE WHEN item_type = 'CONTACT' AND count(*) FILTER (entry_name LIKE '%.enc') > 0 THEN 'encrypted_contact_payload'
          WHEN item_type = 'CALLLOG' AND count(*) FILTER (entry_name LIKE '%call_log.exml') > 0 THEN
            CASE WHEN arg_max(readable, entry_index) FILTER (entry_name LIKE '%call_log.exml') THEN 'xml_readable' ELSE 'binary_or_encrypted_exml' END
          ELSE 'inventory_only' END AS parse_status FROM entries GROUP BY 1, 2, 3, 4"""),
    "agg_message_counts": "SELECT count(*) AS message_count, count(DISTINCT conv_id) AS chat_count FROM conversations",
    "agg_listing_preview": sql("lst", f"""SELECT d.device, k.key, k.key AS label, k.remote_path, coalesce(l.n, 0) AS file_count, coalesce(s.b, 0) AS total_bytes, coalesce(l.n, 0) > 0 AS available
        FROM (SELECT DISTINCT device FROM lst) d CROSS JOIN (VALUES ('DCIM','/sdcard/DCIM/'), ('Pictures','/sdcard/Pictures/'), ('Download','/sdcard/Download/'), ('Movies','/sdcard/Movies/'),
          ('Music','/sdcard/Music/'), ('WhatsApp Media','/storage/emulated/0/Android/media/com.whatsapp/WhatsApp/Media/')) k(key, remote_path)
        LEFT JOIN (SELECT device, folder, count(*) FILTER (kind > 1) AS n FROM lst GROUP BY 1, 2) l ON l.device = d.device AND l.folder = k.key
        LEFT JOIN (SELECT 'dev' || (c_custkey % 40) AS device, {FIVE}[c_custkey % 5 + 1] AS folder, max({KIB}) AS b FROM customer GROUP BY 1, 2) s ON s.device = d.device AND s.folder = k.key"""),
    "agg_permission_denied": sql("lst", "SELECT device, folder, count(*) FILTER (kind > 1) AS file_count, count(*) FILTER (kind = 1) AS permission_denied FROM lst WHERE kind > 0 GROUP BY 1, 2"),
    "agg_device_status": "SELECT (['device','unauthorized','offline'])[c_custkey % 3 + 1] AS status, count(*) AS n_devices FROM customer WHERE c_custkey > 0 AND c_custkey % 20 <> 19 GROUP BY 1",
    "agg_protected_roots": sql("inv prior", "SELECT '/library/objects' AS root WHERE EXISTS (SELECT 1 FROM prior) UNION SELECT '/' || substr(hash, 1, 1) || '/library/objects' FROM prior"),
    "agg_import_outcome": sql("inv prior ranked acts", "SELECT count(*) FILTER (action = 'copied') AS copied_files, count(*) AS occurrences_recorded, count(*) FILTER (action <> 'copied') AS already_had_copy FROM acts"),
    "win_keep_oldest": sql("inv", "SELECT content_hash, first(id ORDER BY coalesce(modified_unix, 9223372036854775807), id) AS keep_id FROM inv GROUP BY 1"),
    "win_keep_largest": sql("grids " + SIGN, "SELECT l.id, g.group_key, l.id = g.keep_id AS is_largest FROM look l JOIN lookgrp g USING (component)"),
    "win_auto_select": sql("inv", """SELECT id, content_hash, id <> first_value(id) OVER (PARTITION BY content_hash ORDER BY id % 2 = 0, coalesce(modified_unix, 9223372036854775807), id) AS preselected,
        id = first_value(id) OVER (PARTITION BY content_hash ORDER BY coalesce(modified_unix, 9223372036854775807), id) AS is_oldest
        FROM inv QUALIFY count(*) OVER (PARTITION BY content_hash) >= 2"""),
    "win_first_content": sql("inv prior ranked acts", "SELECT id, action FROM acts"),
    "win_last_index_row": sql("inv ranked", f"SELECT content_hash, relative_path, {category('extension', 'relative_path')} AS category FROM ranked WHERE rev = 1"),
    "win_pick_message_db": """SELECT device, folder || '/' || name AS remote_path, CASE WHEN name LIKE '%.crypt15' THEN 'crypt15' ELSE 'crypt14' END AS format FROM (
        SELECT *, row_number() OVER (PARTITION BY device ORDER BY f, name <> 'msgstore.db.crypt14', name DESC) AS rn FROM (
          SELECT 'dev' || o_custkey AS device, o_orderkey % 3 AS f, (['/storage/emulated/0/Android/media/com.whatsapp/WhatsApp/Databases','/sdcard/WhatsApp/Databases','/storage/emulated/0/WhatsApp/Databases'])[o_orderkey % 3 + 1] AS folder,
            CASE o_custkey % 6 WHEN 0 THEN 'msgstore.db.crypt14' ELSE 'msgstore-' || strftime(o_orderdate, '%Y-%m-%d') || '.1.db.crypt15' END AS name FROM orders WHERE o_custkey % 6 <> 1)) WHERE rn = 1""",
    "win_last_calendar_field": "SELECT '/k/' || o_orderkey || '.' || (['ics','VCS','dat'])[o_orderkey % 3 + 1] AS source_path, 'Order ' || o_orderkey AS summary, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ';TZID=UTC:' || strftime(o_orderdate, '%Y%m%d') END AS start FROM orders",
    "win_latest_source": sql("src", "SELECT id, adapter, label, seq FROM src QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1"),
    "win_tile_cap": sql("inv files", """SELECT category AS "group", CAST(row_number() OVER (PARTITION BY category ORDER BY coalesce(modified_unix, 9223372036854775807), id) AS INT) AS tile, id FROM files QUALIFY tile <= 24"""),
    "page_files": sql("inv files", "SELECT id, absolute_path, size_bytes, modified_unix FROM files WHERE category = 'photo' ORDER BY coalesce(modified_unix, 0) DESC, size_bytes DESC, id LIMIT 120 OFFSET 20"),
    "page_keyset": sql("inv", "SELECT id, size_bytes, modified_unix FROM inv WHERE coalesce(modified_unix, 0) < 1700500000 ORDER BY coalesce(modified_unix, 0) DESC, size_bytes DESC, id LIMIT 500"),
    "page_has_more": "SELECT least(count(*), 120) AS n_rows, count(*) >= 120 AS has_more FROM documents",
    "sort_groups": sql("inv files grp", "SELECT content_hash, reclaimable_bytes FROM grp ORDER BY reclaimable_bytes DESC, content_hash"),
    "top_messages": sql("msg", "SELECT * FROM msg ORDER BY timestamp, key_remote_jid, data LIMIT 100"),
    "top_item_metrics": sql("items", "SELECT * FROM items ORDER BY backup_id, item_type, size_bytes LIMIT 12"),
    "top_sub_sources": sql("inv", """SELECT 'all' AS backup_id, name, string_agg(sub, ', ' ORDER BY sub) AS sub_source_label FROM (
        SELECT DISTINCT split_part(relative_path, '/', 1) AS name, split_part(relative_path, '/', 2) AS sub FROM inv
        WHERE split_part(relative_path, '/', 1) <> 'Misc' QUALIFY dense_rank() OVER (PARTITION BY split_part(relative_path, '/', 1) ORDER BY split_part(relative_path, '/', 2)) <= 6) GROUP BY name"""),
    "category_sub_sources": sql("inv", "SELECT DISTINCT backup_id, split_part(relative_path, '/', 1) AS name, split_part(relative_path, '/', 2) AS sub_source FROM inv WHERE split_part(relative_path, '/', 1) <> 'Misc'"),
    "op_incremental_index": sql("inv files previous", """SELECT f.id, f.category, f.source, f.content_hash, p.id IS NOT NULL AS unchanged, p.id IS NULL AS rehashed FROM files f LEFT JOIN previous p
        ON p.absolute_path = f.absolute_path AND p.size_bytes = f.size_bytes AND p.modified_unix IS NOT DISTINCT FROM f.modified_unix"""),
    "op_exact_duplicates": sql("inv files grp member", "SELECT content_hash, id, absolute_path, size_bytes, n_files, reclaimable_bytes, is_oldest, preselected FROM member"),
    "op_similar_photos": sql("grids " + SIGN, "SELECT g.group_key, l.id, l.size_bytes, g.n_files, l.id = g.keep_id AS is_largest, false AS preselected FROM look l JOIN lookgrp g USING (component)"),
    "op_plan_consolidation": sql("inv prior outside", PLAN),
    "op_run_consolidation": sql("inv prior outside ranked acts", RUN),
    "op_backup_coverage": sql("inv prior cov", "SELECT * FROM cov ORDER BY imported_at DESC"),
    "op_purge_verdict": sql("inv files prior purge", "SELECT * FROM purge"),
    "op_sync": sql("inv synced syncact wish verdicts", """SELECT count(*) FILTER (action = 'copied') AS copied_files, count(*) FILTER (action = 'skipped') AS skipped_files,
        CAST(coalesce(sum(size_bytes) FILTER (action = 'copied'), 0) AS BIGINT) AS copied_bytes, CAST(coalesce(sum(size_bytes) FILTER (action = 'skipped'), 0) AS BIGINT) AS skipped_bytes,
        count(error) AS file_errors, (SELECT count(error) FROM verdicts) AS category_errors FROM syncact"""),
    "op_media_mapping": """SELECT conv_id, turn, folder, CASE folder WHEN 'WhatsApp Images' THEN 'Photo' WHEN 'WhatsApp Video' THEN 'Video' WHEN 'WhatsApp Video Notes' THEN 'Video'
        WHEN 'WhatsApp Audio' THEN 'Music' WHEN 'WhatsApp Voice Notes' THEN 'Music' ELSE folder END AS destination FROM (
        SELECT conv_id, turn, (['WhatsApp Images','WhatsApp Video','WhatsApp Video Notes','WhatsApp Audio','WhatsApp Voice Notes','Other folder'])[(conv_id + turn) % 6 + 1] AS folder FROM conversations)""",
    "rec_contacts": CONTACTS,
    "rec_browser_json": """SELECT 'b' || (page_id % 20) || ':browser:/b/SBROWSER/' || page_id || '.json:' || n AS id, 'browser' AS kind,
        CASE n WHEN 0 THEN 'Saved' ELSE url END AS title, CASE n WHEN 1 THEN url END AS subtitle, '/b/SBROWSER/' || page_id || '.json' AS source_path,
        'parsed_browser_json' AS parse_status FROM pages, (VALUES (0), (1)) v(n)""",
    "rec_browser_html": sql("a", f"""SELECT 'b' || (page_id % 20) || ':browser:/b/SBROWSER/' || page_id || '.html:' || (row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1) AS id,
        'browser' AS kind, CASE WHEN t <> '' THEN t ELSE coalesce(u, 'Browser record') END AS title, u AS subtitle, '/b/SBROWSER/' || page_id || '.html' AS source_path, 'parsed_browser_html' AS parse_status
        FROM (SELECT page_id, pos, {STRIP % "regexp_extract(el, '(?s)^<a[^>]*>(.*)</a>$', 1)"} AS t,
          CASE WHEN regexp_matches(split_part(el, '>', 1), 'href="[^"]*"') THEN regexp_extract(split_part(el, '>', 1), 'href="([^"]*)"', 1) END AS u FROM a) WHERE t <> '' OR u IS NOT NULL"""),
    "rec_calllog": CALLS,
    "rec_calendar": sql("calrec", f"SELECT {RECORD} FROM calrec"),
    "rec_notes": f"""SELECT source || ':note:' || p AS id, 'note' AS kind, CASE WHEN doc_id % 5 = 4 THEN doc_id || '.bin' ELSE coalesce(nullif({LINE80}, ''), 'Samsung note') END AS title,
        CASE WHEN doc_id % 5 < 3 THEN octet_length(encode(text)) || ' bytes' WHEN doc_id % 5 = 3 THEN length(text) || ' characters' END AS subtitle, p AS source_path,
        CASE WHEN doc_id % 5 < 3 THEN 'parsed_text_note' WHEN doc_id % 5 = 3 THEN 'parsed_sdocx_text' ELSE 'proprietary_note_payload' END AS parse_status
        FROM (SELECT *, '/s/' || doc_id || '.' || (['txt','md','html','sdocx','bin'])[doc_id % 5 + 1] AS p FROM documents)""",
    "rec_apps": sql("phone apprec", f"SELECT {RECORD} FROM apprec"),
    "rec_message_dbs": sql("phone dbrec", f"SELECT {RECORD} FROM dbrec"),
    "rec_messages": sql("msg top100 msgrec", f"SELECT {RECORD} FROM msgrec"),
    "rec_status": sql("phone", """SELECT DISTINCT backup_id || ':' || k || ':' || root_path || '/' || folder AS id, k AS kind, folder AS title, CAST(NULL AS VARCHAR) AS subtitle,
        root_path || '/' || folder AS source_path, CASE k WHEN 'contact' THEN 'encrypted_or_proprietary_payload' ELSE 'binary_or_proprietary_payload' END AS parse_status
        FROM (SELECT *, CASE top WHEN 'CONTACT' THEN 'CONTACT' ELSE 'CALLLOG' END AS folder, CASE top WHEN 'CONTACT' THEN 'contact' ELSE 'calllog' END AS k FROM phone WHERE top IN ('CONTACT', 'CALENDER'))
        WHERE backup_id NOT IN (SELECT 'p' || c_nationkey FROM customer WHERE k = 'contact' UNION ALL SELECT 'p' || (o_orderkey % 17 * 2 + 1) FROM orders WHERE k = 'calllog')"""),
    "rec_browser_status": sql("phone a", f"""SELECT DISTINCT backup_id || ':browser:' || root_path || '/SBROWSER' AS id, 'browser' AS kind, 'SBROWSER' AS title, CAST(NULL AS VARCHAR) AS subtitle, root_path || '/SBROWSER' AS source_path,
        'inventory_only_proprietary_payload' AS parse_status FROM phone WHERE top = 'SBROWSER' AND backup_id NOT IN (SELECT 'p' || (page_id % 20) FROM a)"""),
    "job_index": sql("inv files previous", f"""SELECT place + CASE WHEN old THEN 0 ELSE (SELECT count(*) FROM previous) END AS id, absolute_path, size_bytes, content_hash
        FROM (SELECT absolute_path, size_bytes, category, backup_id IN {IMPORTED} AS old, CASE WHEN id % 13 <> 0 THEN content_hash END AS content_hash,
          row_number() OVER (PARTITION BY backup_id IN {IMPORTED} ORDER BY absolute_path) AS place FROM files) WHERE category = 'documents'"""),
    "job_consolidation": sql("inv", "SELECT content_hash AS hash, size_bytes AS n_bytes, TRUE AS intact, count(*) AS n_files FROM inv GROUP BY 1, 2"),
    "job_import_summary": sql("inv prior outside ranked acts", RUN),
    "set_union_records": sql("phone apprec dbrec calrec", f"SELECT kind, parse_status, count(*) AS n_records FROM (SELECT {RECORD} FROM apprec UNION ALL SELECT {RECORD} FROM dbrec UNION ALL SELECT {RECORD} FROM calrec) GROUP BY 1, 2"),
    "set_prepend_messages": sql("msg top100 msgrec phone dbrec", "SELECT 0 AS part, id, title FROM msgrec UNION ALL SELECT 1, id, title FROM dbrec"),
    "set_remove_selected": sql("inv files grp member", "SELECT content_hash, id, n_left FROM (SELECT content_hash, id, count(*) OVER (PARTITION BY content_hash) AS n_left FROM member WHERE NOT (category = 'photo' AND preselected)) WHERE n_left >= 2"),
    "set_deletable_selection": sql("inv files grp member", "SELECT content_hash, count(*) AS n_files, count(*) FILTER (category = 'photo') AS n_selected, count(*) FILTER (category = 'photo') BETWEEN 1 AND count(*) - 1 AS deletable FROM member GROUP BY 1"),
    "stream_incremental_index": "SELECT '/backups/' || source || '/Documents/' || source || '/' || doc_id || '.txt' AS absolute_path, 'documents' AS category, source, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, sha256(text) AS content_hash FROM documents",
    "stream_dedup_ingest": """SELECT original_path, content_hash, CASE WHEN row_number() OVER (PARTITION BY content_hash ORDER BY original_path, absolute_path) = 1 THEN 'copied' ELSE 'duplicate' END AS action, size_bytes FROM (
        SELECT 'Documents/' || source || '/' || doc_id || '.txt' AS original_path, '/backups/' || source || '/Documents/' || source || '/' || doc_id || '.txt' AS absolute_path, sha256(text) AS content_hash, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes FROM documents)""",
}
