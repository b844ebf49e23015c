"""Explicit schemas of the library tables (never inferred)."""

FILE_INVENTORY = (
    "root_path STRING, absolute_path STRING, relative_path STRING, size_bytes LONG, "
    "modified_unix LONG, extension STRING"
)
FILES = (
    "id LONG, root_path STRING, absolute_path STRING, relative_path STRING, category STRING, "
    "source STRING, extension STRING, size_bytes LONG, modified_unix LONG, content_hash STRING, "
    "aspect_q INT, sig ARRAY<LONG>, indexed_at TIMESTAMP"
)
SCAN_RUNS = (
    "root_path STRING, scanned_files LONG, indexed_files LONG, total_bytes LONG, created_at TIMESTAMP"
)
CONTENTS = (
    "hash STRING, size_bytes LONG, extension STRING, storage_path STRING, first_seen_at TIMESTAMP"
)
BACKUPS = (
    "id STRING, adapter STRING, label STRING, source_path STRING, device_id STRING, "
    "imported_at TIMESTAMP"
)
OCCURRENCES = "content_hash STRING, backup_id STRING, original_path STRING, original_mtime LONG"
IMPORT_RUNS = (
    "id STRING, source_path STRING, destination_path STRING, status STRING, started_at TIMESTAMP, "
    "finished_at TIMESTAMP"
)
IMPORT_RUN_ENTRIES = (
    "run_id STRING, original_path STRING, content_hash STRING, action STRING, size_bytes LONG, "
    "created_at TIMESTAMP"
)
UNREAD_FILES = "run_id STRING, absolute_path STRING, relative_path STRING, size_bytes LONG, found_at TIMESTAMP"
OBJECTS = "hash STRING, chunk LONG, data BINARY, run_id STRING, shard STRING"
DEVICES = (
    "id STRING, label STRING, manufacturer STRING, model STRING, android_version STRING, "
    "created_at TIMESTAMP"
)
BACKUP_SOURCES = (
    "id STRING, adapter STRING, label STRING, path STRING, "
    "device STRUCT<id: STRING, model: STRING, manufacturer: STRING, android_version: STRING, "
    "connection: STRING>, created_at STRING"
)
STRUCTURED_RECORD = [
    "id", "kind", "title", "subtitle", "source_path", "parse_status",
]
ITEM_METRICS_JSON = (
    "ListItems ARRAY<STRUCT<ViewCount: LONG, ContentCount: LONG, Type: STRING, Size: LONG>>"
)
