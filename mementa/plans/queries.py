"""One query per operator, each over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from mementa import constants as K
from mementa import schemas
from mementa.functions import paths as P
from mementa.functions import signature as S
from mementa.functions import text as X
from mementa.operators import consolidation as C
from mementa.operators import duplicates as D
from mementa.operators import index as I
from mementa.operators import inventories as V
from mementa.operators import listings as L
from mementa.operators import records as R
from mementa.operators import similarity as M
from mementa.operators import sync as Y
from mementa.operators.common import is_folder, upsert
from mementa.plans import bindings as B
from mementa.plans.library import Library, run_consolidation
from mementa.session import reliable_checkpoint, scratch_folder, tune
from mementa.sources import objects as O
from mementa.sources import registry as G

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(tune(spark), sf_dir)

    QUERIES[function.__name__] = run
    return function


def _documents(s, d):
    return B.table(s, d, "documents")


# ---------------------------------------------------------------- sources


@query
def src_inventory(s, d):
    return B.inventory(s, d).select(
        "absolute_path", "relative_path", "size_bytes", "modified_unix", "extension"
    )


@query
def src_content_hash(s, d):
    return B.inventory(s, d).select("id", "content_hash")


@query
def src_item_metrics(s, d):
    return V.item_metrics(B.item_documents(s, d))


@query
def src_archive_entries(s, d):
    return B.archive_entries(s, d).select(
        "archive_path", "entry_index", "entry_name", V.readable_xml("head").alias("readable")
    )


@query
def src_text_whole(s, d):
    return B.html_pages(s, d).select("source_path", F.octet_length("text").cast("long").alias("n_bytes"), "text")


@query
def src_text_lines(s, d):
    c = B.table(s, d, "conversations")
    return c.select("conv_id", "turn", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))


@query
def src_messages(s, d):
    return B.messages(s, d)


@query
def src_listing_lines(s, d):
    return B.listing_lines(s, d)


@query
def src_registry(s, d):
    used = B.backup_sources(s, d).groupBy("adapter").agg(F.count("*").alias("n_sources"))
    return G.registry(s).join(used, "adapter", "left").select(
        "adapter", "adapter_label", F.coalesce("n_sources", F.lit(0)).alias("n_sources")
    )


@query
def src_index(s, d):
    return I.category_filter(B.files(s, d), "documents").select("id", "absolute_path", "category")


# ---------------------------------------------------------------- sinks (as the rows they write)


def _marked_files(s, d):
    """A scan in which some files could not be read (NULL hash)."""
    unread = F.when(F.col("id") % 13 != 0, F.col("content_hash"))
    return B.files(s, d).withColumn("content_hash", unread)


@query
def sink_files_upsert(s, d):
    current = B.previous_index(s, d)
    vanished = current.withColumn("absolute_path", F.concat(F.lit("/gone"), "absolute_path"))
    snapshot = I.upsert_files(current.unionByName(vanished), _marked_files(s, d))
    return snapshot.select("absolute_path", "id", "size_bytes", "modified_unix", "category", "content_hash")


@query
def sink_scan_runs(s, d):
    return I.scan_run_rows(B.inventory(s, d))


@query
def sink_contents(s, d):
    return C.new_contents(B.inventory(s, d), B.prior_contents(s, d), B.DESTINATION)


@query
def sink_backups(s, d):
    fresh = B.backups(s, d)
    older = fresh.filter(F.col("id").isin(B.IMPORTED_SOURCES)).withColumn("adapter", F.lit("adb-generic")).withColumn(
        "label", F.lit("old")
    )
    return C.upsert_backups(older, fresh).select("id", "adapter", "label", "source_path", "imported_at")


@query
def sink_devices(s, d):
    old = B.table(s, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("label"),
        F.lit("maker").alias("manufacturer"), F.lit(None).cast("string").alias("model"),
        F.lit(None).cast("string").alias("android_version"), F.col("s_suppkey").alias("created_at"),
    )
    new = B.table(s, d, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("label"),
        F.lit(None).cast("string").alias("manufacturer"), F.lit(None).cast("string").alias("model"),
        F.lit(None).cast("string").alias("android_version"), (F.col("c_custkey") + 1000).alias("created_at"),
    )
    return C.upsert_devices(old, new).select("id", "label", "manufacturer", "created_at")


@query
def sink_occurrences(s, d):
    rows = B.occurrences(s, d)
    older = rows.filter(F.col("backup_id").isin(B.IMPORTED_SOURCES)).withColumn("original_mtime", F.lit(1).cast("long"))
    return C.upsert_occurrences(older, rows)


@query
def sink_manifest(s, d):
    actions = C.run_actions(B.inventory(s, d), B.prior_contents(s, d))
    return C.manifest_entries(actions, "run-1")


def _contents_after(s, d):
    before = B.prior_contents(s, d)
    return before.unionByName(C.new_contents(B.inventory(s, d), before, B.DESTINATION))


@query
def sink_imported_index(s, d):
    return C.imported_index(B.inventory(s, d), _contents_after(s, d), B.DESTINATION, "Import")


@query
def sink_objects(s, d):
    winners = C.copied_files(B.inventory(s, d), B.prior_contents(s, d))
    stored = winners.join(B.content_table(s, d), "absolute_path")
    return stored.select(
        F.col("content_hash").alias("hash"), F.substring("content_hash", 1, 2).alias("shard"),
        F.octet_length("content").cast("long").alias("n_bytes"),
    )


def _sync_parts(s, d):
    inv = B.inventory(s, d)
    verdicts = Y.requested_verdicts(B.requested_categories(s, d), inv, "/backups")
    return Y.sync_actions(inv, B.sync_target(s, d), verdicts, "/media"), verdicts


@query
def sink_category_sync(s, d):
    actions, _ = _sync_parts(s, d)
    return actions.filter("action = 'copied'").select("absolute_path", "destination", "inner_path", "size_bytes")


def _purge(s, d):
    existing = B.files(s, d).filter("modified_unix IS NOT NULL")  # a file without a time is gone
    return D.purge_verdict(B.purge_requests(s, d), D.protected_roots(B.prior_contents(s, d)), existing)


@query
def sink_delete_index(s, d):
    eligible = _purge(s, d).filter("verdict = 'eligible'")
    return I.delete_paths(B.files(s, d), eligible).select("id", "absolute_path")


@query
def sink_recategorize(s, d):
    stale = B.files(s, d).withColumn("category", F.col("source"))
    return I.recategorize(stale).select("id", "category")


@query
def sink_hash_backfill(s, d):
    partial = B.files(s, d).withColumn("content_hash", F.when(F.col("id") % 3 == 0, F.col("content_hash")))
    filled = I.backfill_hashes(partial, I.hash_from_table(B.content_table(s, d)))
    return filled.select("id", "content_hash")


# ---------------------------------------------------------------- functions


@query
def fn_relative_path(s, d):
    inv = B.inventory(s, d)
    return inv.select(
        "id",
        P.relative_path("absolute_path", "root_path").alias("below"),
        P.relative_path("absolute_path", F.substring("root_path", 1, 12)).alias("maybe_below"),
    )


@query
def fn_extension(s, d):
    url = F.col("url")
    return B.table(s, d, "pages").select("page_id", P.base_name(url).alias("name"), P.extension(url).alias("extension"))


@query
def fn_media_category(s, d):
    return B.inventory(s, d).select("id", P.media_category("extension").alias("category"))


@query
def fn_classify(s, d):
    return B.inventory(s, d).select("id", P.classify("relative_path", "extension").alias("category"))


@query
def fn_source(s, d):
    return B.inventory(s, d).select(
        "id", P.source_of("relative_path").alias("source"), P.source_of(P.base_name("relative_path")).alias("flat")
    )


@query
def fn_storage_path(s, d):
    inv = B.inventory(s, d)
    return inv.select("id", P.storage_path(F.lit(B.DESTINATION), "content_hash", "extension").alias("storage_path"))


@query
def fn_uuid5(s, d):
    return B.inventory(s, d).select("id", P.backup_id(F.lit("generic-folder"), "root_path").alias("backup_uuid"))


@query
def fn_run_id(s, d):
    return B.inventory(s, d).select("id", P.run_id("backup_id", "id").alias("run_uuid"))


@query
def fn_redact(s, d):
    return B.table(s, d, "customer").select(
        "c_custkey", P.redact("c_name").alias("name"), P.redact(F.col("c_custkey").cast("string")).alias("key")
    )


@query
def fn_backup_timestamp(s, d):
    stamp = F.concat(F.lit("SM-X_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 6, "0"))
    label = F.when(F.col("o_orderkey") % 5 == 0, F.concat(stamp, F.lit("x"))).otherwise(stamp)
    return B.table(s, d, "orders").select("o_orderkey", P.backup_timestamp(label).alias("stamp"))


@query
def fn_dup_named(s, d):
    named = F.concat(F.lit("Photo/"), F.when(F.col("id") % 3 == 0, F.lit("DUPLICATE_")).otherwise(F.lit("")), F.col("id").cast("string"))
    return B.inventory(s, d).select("id", P.is_duplicate_named(named).alias("dup_named"))


@query
def fn_shorten_path(s, d):
    inv = B.inventory(s, d)
    return inv.select(
        "id", P.shorten_path("absolute_path").alias("long_path"),
        P.shorten_path(F.when(F.col("id") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("a\\"), F.col("backup_id")))).alias("short_path"),
    )


@query
def fn_title80(s, d):
    return _documents(s, d).select("doc_id", X.first_line_title("text").alias("title"))


@query
def fn_title120(s, d):
    return B.messages(s, d).select("key_remote_jid", "timestamp", X.title120("data").alias("title"))


@query
def fn_first_string(s, d):
    nodes = R.json_objects(B.contact_payloads(s, d).withColumn("text", X.json_region("text")))
    return nodes.select(
        "entry_index",
        R.first_string("object", ["displayName", "name"]).alias("title"),
        R.first_string("object", ["phone", "email"]).alias("subtitle"),
    )


@query
def fn_strip_html(s, d):
    return B.table(s, d, "pages").select("page_id", X.strip_html("html").alias("plain"))


@query
def fn_href(s, d):
    tags = F.regexp_extract_all("html", F.lit("<a[^>]*"), F.lit(0))
    return B.table(s, d, "pages").select("page_id", F.posexplode(tags).alias("n", "tag")).select(
        "page_id", "n", X.href("tag").alias("href"), X.href(F.replace(F.col("tag"), F.lit("href"), F.lit("HREF"))).alias("upper_href")
    )


@query
def fn_json_region(s, d):
    return B.contact_payloads(s, d).select("entry_index", X.json_region("text").alias("region"))


@query
def fn_xml_region(s, d):
    return B.call_payloads(s, d).select("source_path", X.xml_region("text", "CallLogs").alias("region"))


@query
def fn_wa_format(s, d):
    return B.message_db_lines(s, d).select("device", "folder", "line", P.message_db_format(X.trim_unicode("line")).alias("format"))


@query
def fn_coverage_pct(s, d):
    return B.coverage(s, d).select("backup_id", "coverage_percent")


@query
def fn_kib_to_bytes(s, d):
    return B.listing_sizes(s, d).select("device", "folder", "size_text", X.kib_to_bytes("size_text").alias("n_bytes"))


@query
def fn_aspect_q(s, d):
    return B.table(s, d, "part").select(
        "p_partkey", S.aspect_q(F.col("p_size"), (F.col("p_partkey") % 40).cast("int")).alias("aspect_q")
    )


@query
def fn_dhash256(s, d):
    return B.signed_photos(s, d).select("id", S.bits_text("sig").alias("bits"))


@query
def fn_hamming(s, d):
    words = [F.get("sig", F.lit(i)) for i in range(4)]
    zero = [F.lit(0).cast("long")] * 4
    return B.signed_photos(s, d).select("id", S.hamming(words, zero).cast("long").alias("n_bits"))


@query
def fn_format_bytes(s, d):
    inv = B.inventory(s, d)
    size = F.col("size_bytes")
    return inv.select(
        "id", X.format_bytes(size).alias("small"), X.format_bytes(size * 1000).alias("medium"),
        X.format_bytes(size * 1000000000).alias("large"), X.format_bytes(size * 0).alias("none"),
    )


@query
def fn_format_count(s, d):
    return B.inventory(s, d).select("id", X.format_count(F.col("size_bytes") * 1001).alias("count_text"))


@query
def fn_format_date(s, d):
    return B.inventory(s, d).select("id", X.format_date("modified_unix").alias("date_text"))


@query
def fn_category_label(s, d):
    f = B.files(s, d)
    return f.select("id", X.category_label("category").alias("label"), X.category_label("source").alias("source_label"))


# ---------------------------------------------------------------- filters


@query
def flt_category(s, d):
    return I.category_filter(B.files(s, d), "photo").select("id", "category")


@query
def flt_path_within(s, d):
    inv = B.inventory(s, d)
    return inv.filter(P.path_within("absolute_path", F.lit("/backups/src1"))).select("id", "absolute_path")


@query
def flt_regular_file(s, d):
    entries = B.with_folders(B.inventory(s, d), "Music/empty", "Video")
    return entries.filter(~is_folder(entries)).select("id", "absolute_path")


@query
def flt_unchanged(s, d):
    state = I.with_previous(B.inventory(s, d), B.previous_index(s, d))
    return state.filter("unchanged").select("id", "absolute_path")


@query
def flt_similar(s, d):
    """Photos that look like the first photo: the test against one fixed signature."""
    photos = reliable_checkpoint(B.signed_photos(s, d)).filter("sig IS NOT NULL")
    anchor = photos.agg(F.min_by(F.struct("aspect_q", "sig"), "id").alias("anchor"))
    near = photos.withColumn("_one", F.lit(1)).join(F.broadcast(anchor.withColumn("_one", F.lit(1))), "_one")
    words = [[F.get(c, F.lit(i)) for i in range(4)] for c in ("sig", "anchor.sig")]
    return near.filter(S.similar(words[0], F.col("aspect_q"), words[1], F.col("anchor.aspect_q"))).select("id")


@query
def flt_selected_keys(s, d):
    return L.selected_folders(B.listing_lines(s, d), ["DCIM", "Music"], "folder").select("device", "folder", "line_no")


@query
def flt_supported_category(s, d):
    return Y.requested_verdicts(B.requested_categories(s, d), B.inventory(s, d), "/backups")


@query
def flt_message_db_file(s, d):
    inv = B.phone_inventory(s, d)
    return inv.filter(P.is_message_db_file(P.base_name("relative_path"))).select("seq", "relative_path")


@query
def flt_not_null_data(s, d):
    data = F.when(F.col("timestamp") != 1, F.col("data"))
    return B.messages(s, d).withColumn("data", data).filter("data IS NOT NULL").select("key_remote_jid", "timestamp")


@query
def flt_thumbnail_needed(s, d):
    raw = F.when(F.col("extension") == "png", F.lit("HEIC")).otherwise(F.col("extension"))
    return B.files(s, d).select("id", P.needs_thumbnail("category", raw).alias("needs_thumbnail"))


@query
def flt_takeout_root(s, d):
    folder = F.regexp_replace("relative_path", "^Misc/src1", "Takeout/src1")
    return V.takeout_roots(B.inventory(s, d).withColumn("relative_path", folder))


@query
def flt_source_kind(s, d):
    sources = B.backup_sources(s, d)
    phones = G.by_adapter(sources, "adb-generic").select("seq", F.lit("phone").alias("kind"))
    return phones.unionByName(G.with_path(sources).select("seq", F.lit("backup").alias("kind")))


# ---------------------------------------------------------------- joins


@query
def join_coverage(s, d):
    return B.coverage(s, d).select("backup_id", "total_files", "covered_files", "covered_bytes")


@query
def join_content_exists(s, d):
    hashes = B.inventory(s, d).select("content_hash").distinct()
    return hashes.join(B.prior_contents(s, d).select(F.col("hash").alias("content_hash")), "content_hash", "left_semi")


@query
def join_indexed_outside(s, d):
    outside = C.indexed_outside(_mixed_index(s, d), B.DESTINATION)
    hashes = B.inventory(s, d).select("content_hash").distinct()
    return hashes.join(outside, "content_hash", "left_semi")


def _mixed_index(s, d):
    """Index of the library objects and of the backup folders not imported yet."""
    stored = B.prior_contents(s, d).select(F.col("storage_path").alias("absolute_path"), F.col("hash").alias("content_hash"))
    waiting = B.inventory(s, d).filter(~F.col("backup_id").isin(B.IMPORTED_SOURCES))
    return stored.unionByName(waiting.select("absolute_path", "content_hash"))


@query
def join_reuse_hash(s, d):
    return I.with_previous(B.inventory(s, d), B.previous_index(s, d)).select("id", "unchanged", "reused_hash")


@query
def join_canonical_path(s, d):
    return C.imported_index(B.inventory(s, d), B.prior_contents(s, d), "/elsewhere", "x").select(
        "content_hash", "absolute_path"
    )


@query
def join_sync_target(s, d):
    actions, _ = _sync_parts(s, d)
    return actions.select("absolute_path", "action", "error")


@query
def join_similar_pairs(s, d):
    distinct = M.distinct_signatures(B.signed_photos(s, d))
    words = [F.get("signature.sig", F.lit(i)).alias(w) for i, w in enumerate(M.WORDS)]
    return M.signature_components(distinct.select("sid", F.col("signature.aspect_q").alias("aspect_q"), *words))


@query
def join_protected_roots(s, d):
    return _purge(s, d).filter("verdict = 'refused'").select("absolute_path", "error")


@query
def join_adapter_label(s, d):
    return G.with_adapter_label(B.backup_sources(s, d)).select("seq", "adapter", "adapter_label")


@query
def join_status_suppression(s, d):
    inv = B.phone_inventory(s, d)
    return R.missing_kind_status(inv, R.apps(inv)).select(*schemas.STRUCTURED_RECORD)


# ---------------------------------------------------------------- aggregations


@query
def agg_category_metrics(s, d):
    return I.category_metrics(B.files(s, d))


@query
def agg_library_totals(s, d):
    return I.library_totals(B.files(s, d), B.backup_sources(s, d))


@query
def agg_index_summary(s, d):
    return I.index_summary(B.inventory(s, d))


@query
def agg_coverage(s, d):
    return B.coverage(s, d)


@query
def agg_size_collision(s, d):
    return I.size_groups(B.files(s, d))


@query
def agg_duplicate_groups(s, d):
    return D.duplicate_groups(B.files(s, d))


@query
def agg_similar_groups(s, d):
    return M.similar_groups(M.similar_members(B.signed_photos(s, d))).drop("component")


@query
def agg_scan_summary(s, d):
    f = B.files(s, d)
    return D.scan_summary(D.duplicate_groups(f), D.candidate_count(f))


@query
def agg_plan(s, d):
    return C.plan_consolidation(
        B.inventory(s, d), B.prior_contents(s, d), C.indexed_outside(_mixed_index(s, d), B.DESTINATION)
    )


@query
def agg_category_scan(s, d):
    return Y.category_scan(B.with_folders(B.inventory(s, d), "Music/empty", "Video"))


@query
def agg_folder_inventory(s, d):
    return V.folder_inventory(B.with_folders(B.phone_inventory(s, d), "CALENDER/empty", "APK"), ["CALENDER", "APK"])


@query
def agg_archive_inventory(s, d):
    return V.archive_inventory(B.archive_entries(s, d))


@query
def agg_message_counts(s, d):
    m = B.messages(s, d)
    return R.message_counts(m, m.select("key_remote_jid").distinct())


@query
def agg_listing_preview(s, d):
    return L.listing_preview(B.listing_lines(s, d), B.listing_sizes(s, d))


@query
def agg_permission_denied(s, d):
    return L.listing_counts(B.listing_lines(s, d))


@query
def agg_device_status(s, d):
    return L.device_status(B.device_lines(s, d))


@query
def agg_protected_roots(s, d):
    c = B.prior_contents(s, d)
    nested = c.withColumn("storage_path", F.concat(F.lit("/"), F.substring("hash", 1, 1), F.col("storage_path")))
    return D.protected_roots(c.select("storage_path").unionByName(nested.select("storage_path")))


@query
def agg_import_outcome(s, d):
    return C.import_outcome(_run_summary(s, d)).select("copied_files", "occurrences_recorded", "already_had_copy")


# ---------------------------------------------------------------- rankings


@query
def win_keep_oldest(s, d):
    return D.oldest_per_hash(B.files(s, d)).select("content_hash", F.col("id").alias("keep_id"))


@query
def win_keep_largest(s, d):
    photos = B.signed_photos(s, d)
    members = M.similar_members(photos)
    return M.group_members(members, M.similar_groups(members)).select("id", "group_key", "is_largest")


@query
def win_auto_select(s, d):
    named = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Photo/DUPLICATE_"), F.col("id").cast("string"))).otherwise(F.col("relative_path"))
    f = B.files(s, d).withColumn("relative_path", named)
    return D.duplicate_members(f, D.duplicate_groups(f)).select("id", "content_hash", "preselected", "is_oldest")


@query
def win_first_content(s, d):
    return C.run_actions(B.inventory(s, d), B.prior_contents(s, d)).select("id", "action")


@query
def win_last_index_row(s, d):
    return C.imported_index(B.inventory(s, d), _contents_after(s, d), B.DESTINATION, "Import").select(
        "content_hash", "relative_path", "category"
    )


@query
def win_pick_message_db(s, d):
    return L.message_db_choice(B.message_db_lines(s, d))


@query
def win_last_calendar_field(s, d):
    return B.calendar_payloads(s, d).select(
        "source_path", R.last_field("text", "SUMMARY:").alias("summary"), R.last_field("text", "DTSTART").alias("start")
    )


@query
def win_latest_source(s, d):
    return G.latest_sources(B.backup_sources(s, d)).select("id", "adapter", "label", "seq")


@query
def win_tile_cap(s, d):
    f = B.files(s, d).withColumn("group", F.col("category"))
    return D.first_tiles(f, "group", D.keep_order()).select("group", "tile", "id")


# ---------------------------------------------------------------- sorts and limits


@query
def page_files(s, d):
    return I.page_files(B.files(s, d), "photo", 120, 20).select("id", "absolute_path", "size_bytes", "modified_unix")


@query
def page_keyset(s, d):
    return I.page_after(B.files(s, d), 1700500000, 0, -1, None, 600).select("id", "size_bytes", "modified_unix")


@query
def page_has_more(s, d):
    return I.page_has_more(B.files(s, d), None, 120, 0)


@query
def sort_groups(s, d):
    return D.sort_groups(D.duplicate_groups(B.files(s, d))).select("content_hash", "reclaimable_bytes")


@query
def top_messages(s, d):
    return R.message_sample(B.messages(s, d))


@query
def top_item_metrics(s, d):
    return V.top_item_metrics(V.item_metrics(B.item_documents(s, d)))


@query
def top_sub_sources(s, d):
    by_folder = B.inventory(s, d).withColumn("backup_id", F.lit("all"))
    return Y.top_sub_sources(Y.sub_sources(by_folder))


@query
def category_sub_sources(s, d):
    return Y.sub_sources(B.inventory(s, d))


# ---------------------------------------------------------------- composite operators


@query
def op_incremental_index(s, d):
    indexed = I.incremental_index(
        B.inventory(s, d).drop("content_hash"), B.previous_index(s, d), I.hash_from_table(B.content_table(s, d))
    )
    return indexed.select("id", "category", "source", "content_hash", "unchanged", "rehashed")


@query
def op_exact_duplicates(s, d):
    f = B.files(s, d)
    members = D.duplicate_members(f, D.duplicate_groups(f))
    return members.select(
        "content_hash", "id", "absolute_path", "size_bytes", "n_files", "reclaimable_bytes", "is_oldest", "preselected"
    )


@query
def op_similar_photos(s, d):
    members = M.similar_members(B.signed_photos(s, d))
    return M.group_members(members, M.similar_groups(members)).select(
        "group_key", "id", "size_bytes", "n_files", "is_largest", "preselected"
    )


@query
def op_plan_consolidation(s, d):
    return agg_plan(s, d)


def _run_summary(s, d):
    return C.run_summary(
        B.inventory(s, d), B.prior_contents(s, d), C.indexed_outside(_mixed_index(s, d), B.DESTINATION)
    )


@query
def op_run_consolidation(s, d):
    return _run_summary(s, d)


@query
def op_backup_coverage(s, d):
    return C.newest_first(B.coverage(s, d))


@query
def op_purge_verdict(s, d):
    return _purge(s, d)


@query
def op_sync(s, d):
    return Y.sync_summary(*_sync_parts(s, d))


@query
def op_media_mapping(s, d):
    names = [n for n, _ in K.MESSENGER_MEDIA_MAPPING] + ["Other folder"]
    c = B.table(s, d, "conversations")
    folder = B._pick(names, (F.col("conv_id") + F.col("turn")) % len(names))
    return Y.media_mapping(c.select("conv_id", "turn", folder.alias("folder")), "folder")


# ---------------------------------------------------------------- structured records


def _out(df: DataFrame) -> DataFrame:
    return df.select(*schemas.STRUCTURED_RECORD)


@query
def rec_contacts(s, d):
    return _out(R.contacts(B.contact_payloads(s, d)))


@query
def rec_browser_json(s, d):
    return _out(R.browser_json(B.browser_payloads(s, d)))


@query
def rec_browser_html(s, d):
    return _out(R.browser_html(B.html_pages(s, d)))


@query
def rec_calllog(s, d):
    return _out(R.call_logs(B.call_payloads(s, d)))


@query
def rec_calendar(s, d):
    return _out(R.calendar(B.calendar_payloads(s, d)))


@query
def rec_notes(s, d):
    return _out(R.notes(B.note_payloads(s, d)))


@query
def rec_apps(s, d):
    return _out(R.apps(B.phone_inventory(s, d)))


@query
def rec_message_dbs(s, d):
    return _out(R.message_databases(B.phone_inventory(s, d)))


@query
def rec_messages(s, d):
    return R.messages(B.messages(s, d), "/db/msgstore.db")


@query
def rec_status(s, d):
    """Phones with contact, call log and app folders, of which some were parsed."""
    phones = B.phone_inventory(s, d)
    moved = [F.regexp_replace(c, "(^|/)CALENDER/", "$1CALLLOG/").alias(c) for c in ("relative_path", "absolute_path")]
    inv = phones.select(*[c for c in phones.columns if c not in ("relative_path", "absolute_path")], *moved)
    contacts = B.contact_payloads(s, d).withColumn("backup_id", F.regexp_replace("backup_id", "^n", "p"))
    order = F.regexp_extract("source_path", r"/c/(\d+)/", 1).cast("long")
    calls = B.call_payloads(s, d).withColumn("backup_id", F.concat(F.lit("p"), (order % 17 * 2 + 1).cast("string")))
    parsed = R.contacts(contacts).unionByName(R.call_logs(calls)).unionByName(R.apps(inv))
    return _out(R.missing_kind_status(inv, parsed))


@query
def rec_browser_status(s, d):
    found = R.browser_html(B.html_pages(s, d)).withColumn("backup_id", F.regexp_replace("backup_id", "^b", "p"))
    return _out(R.browser_status(B.phone_inventory(s, d), found))


# ---------------------------------------------------------------- jobs over library tables


@query
def job_index(s, d):
    """Two scans into the partitioned index: an older one, then the present one with files that could not be read."""
    library = Library(s, scratch_folder(s, "job-index"))
    library.upsert_index(B.previous_index(s, d))
    library.upsert_index(_marked_files(s, d))
    return library.read("files").filter("category = 'documents'").select("id", "absolute_path", "size_bytes", "content_hash")


@query
def job_consolidation(s, d):
    """A whole import: the stored objects, read back in chunks, with the occurrences of each content."""
    library = Library(s, scratch_folder(s, "job-consolidation"))
    run_consolidation(
        library, B.inventory(s, d), "generic-folder", "Everything", "/backups", B.DESTINATION, "1",
        store=O.from_table(B.content_table(s, d)),
    )
    seen = library.read("occurrences").groupBy(F.col("content_hash").alias("hash")).agg(F.count("*").alias("n_files"))
    return O.read_back(library.read("objects")).join(seen, "hash")


@query
def job_import_summary(s, d):
    """The counters of a run, observed while its entries are written."""
    library = Library(s, scratch_folder(s, "job-summary"))
    library.replace("contents", B.prior_contents(s, d).withColumns({"run_id": F.lit("before"), "first_seen_at": F.current_timestamp()}))
    library.upsert_index(_mixed_index(s, d).withColumn("category", F.lit("other")))
    return run_consolidation(library, B.inventory(s, d), "generic-folder", "Import", "/backups", B.DESTINATION, "1", store=None)


# ---------------------------------------------------------------- set operations


@query
def set_union_records(s, d):
    parts = [R.apps(B.phone_inventory(s, d)), R.message_databases(B.phone_inventory(s, d)), R.calendar(B.calendar_payloads(s, d))]
    return R.union_records(parts).groupBy("kind", "parse_status").agg(F.count("*").alias("n_records"))


@query
def set_prepend_messages(s, d):
    fresh = R.messages(B.messages(s, d), "/db/msgstore.db")
    return R.prepend(fresh, _out(R.message_databases(B.phone_inventory(s, d)))).select("part", "id", "title")


@query
def set_remove_selected(s, d):
    f = B.files(s, d)
    members = D.duplicate_members(f, D.duplicate_groups(f))
    chosen = members.filter((F.col("category") == "photo") & F.col("preselected"))
    return D.remove_selected(members, chosen, "content_hash").select("content_hash", "id", "n_left")


@query
def set_deletable_selection(s, d):
    f = B.files(s, d)
    members = D.duplicate_members(f, D.duplicate_groups(f))
    chosen = members.filter(F.col("category") == "photo")
    return D.deletable_selection(members, chosen, "content_hash")


# ---------------------------------------------------------------- streaming


def _document_stream(s, d):
    """The documents table as a stream of inventory rows.

    The table is a file or a folder of files: a pattern finds both, while a stream takes no single file as its path.
    """
    schema = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
    raw = s.readStream.schema(schema).parquet(f"{d.rstrip('/')}/documents.parque[t]")
    relative = F.concat(F.lit("Documents/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return raw.select(
        F.concat(F.lit("/backups/"), "source").alias("root_path"),
        F.concat(F.lit("/backups/"), "source", F.lit("/"), relative).alias("absolute_path"),
        relative.alias("relative_path"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.col("doc_id").alias("modified_unix"),
        F.lit("txt").alias("extension"),
        F.sha2(F.col("text"), 256).alias("content_hash"),
    )


@query
def stream_incremental_index(s, d):
    from mementa.streaming import ingest

    folder = scratch_folder(s, "stream-index")
    library = Library(s, f"{folder}/library")
    table = B.table(s, d, "documents")
    relative = F.concat(F.lit("Documents/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    contents = table.select(
        F.concat(F.lit("/backups/"), "source", F.lit("/"), relative).alias("absolute_path"), F.col("text").alias("content")
    )
    stream = _document_stream(s, d).drop("content_hash")
    ingest.incremental_index(stream, library, I.hash_from_table(contents), f"{folder}/progress").awaitTermination()
    return library.read("files").select("absolute_path", "category", "source", "size_bytes", "content_hash")


@query
def stream_dedup_ingest(s, d):
    from mementa.streaming import ingest

    folder = scratch_folder(s, "stream-dedup")
    library = Library(s, f"{folder}/library")
    ingest.dedup_ingest(_document_stream(s, d), library, B.DESTINATION, f"{folder}/progress").awaitTermination()
    return library.read("import_run_entries").select("original_path", "content_hash", "action", "size_bytes")
