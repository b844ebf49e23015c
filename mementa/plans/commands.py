"""The user-facing jobs over one library: index, browse, deduplicate, consolidate, purge, sync."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mementa import constants as K
from mementa.operators import consolidation as C
from mementa.operators import duplicates as D
from mementa.operators import index as I
from mementa.operators import inventories as V
from mementa.operators import listings as L
from mementa.operators import records as R
from mementa.operators import similarity as M
from mementa.operators import sync as Y
from mementa.plans.library import Library, run_consolidation, run_index
from mementa.sources import images, inventory as walked, registry


class Commands:
    """Every method returns a DataFrame; those that change the library return the summary of the change."""

    def __init__(self, spark: SparkSession, library: Library):
        self.spark, self.library = spark, library

    def adapter_registry(self) -> DataFrame:
        return registry.registry(self.spark)

    def scan_sources(self, *parts: DataFrame) -> DataFrame:
        return registry.with_adapter_label(registry.all_sources(parts))

    def diagnose_devices(self, device_lines: DataFrame) -> DataFrame:
        return L.device_rows(device_lines)

    def preview_device_media(self, lines: DataFrame, sizes: DataFrame, keys: list[str] | None = None) -> DataFrame:
        return L.selected_folders(L.listing_preview(lines, sizes), keys)

    def choose_message_database(self, lines: DataFrame) -> DataFrame:
        return L.message_db_choice(lines)

    def category_metrics(self) -> DataFrame:
        return I.category_metrics(self.library.read("files"))

    def index_multimedia(self, inventory: DataFrame, hasher: I.Reader, signer: I.Reader | None = None,
                         outcomes: DataFrame | None = None) -> DataFrame:
        run_index(self.library, inventory, hasher, signer, outcomes)
        return I.index_summary(inventory)

    def index_folders(self, roots: DataFrame) -> DataFrame:
        """Walk and index folders; (root_path, outcome, scanned_files, indexed_files, total_bytes) per root.

        A missing root counts zero files and gets no run, an empty one does; the others go on.
        """
        scan = walked.walk_roots(roots)
        run_index(self.library, scan.files, walked.hash_files, images.sign_files, scan.outcomes)
        return I.root_summaries(scan.files, scan.outcomes)

    def list_indexed_files(self, category: str | None = None, limit: int = 120, offset: int = 0) -> DataFrame:
        return I.page_files(self.library.read("files"), category, limit, offset)

    def _refill(self, fill: I.Reader, column: str) -> None:
        """Upsert the index rows whose ``column`` was missing and that ``fill`` could read."""
        files = self.library.read("files").withColumn("_known", F.col(column).isNotNull())
        read = fill(files).filter(~F.col("_known") & F.col(column).isNotNull()).drop("_known", "id")
        self.library.upsert_index(read)

    def find_duplicate_files(self, category: str | None = None, hasher: I.Reader = walked.hash_files) -> DataFrame:
        """Files whose size collides are read first where they have no hash; the index keeps it."""
        self._refill(lambda files: I.backfill_hashes(files, hasher), "content_hash")
        return D.sort_groups(D.duplicate_groups(self.library.read("files"), category))

    def duplicate_summary(self, category: str | None = None) -> DataFrame:
        """Groups, reclaimable bytes and candidates of a scan."""
        files = I.category_filter(self.library.read("files"), category)
        return D.scan_summary(D.duplicate_groups(files), D.candidate_count(files))

    def duplicate_files(self, category: str | None = None) -> DataFrame:
        files = I.category_filter(self.library.read("files"), category)
        return D.duplicate_members(files, D.duplicate_groups(files))

    def find_similar_photos(self, signer: I.Reader = images.sign_files) -> DataFrame:
        """Photos without a signature (imported ones, too) are signed first; the index keeps it."""
        self._refill(lambda files: I.backfill_signatures(files, signer), "sig")
        groups = M.similar_groups(self._look_alikes())
        return groups.orderBy(F.col("reclaimable_bytes").desc(), "group_key")

    def similar_photos(self) -> DataFrame:
        members = self._look_alikes()
        return M.group_members(members, M.similar_groups(members))

    def _look_alikes(self) -> DataFrame:
        return M.similar_members(I.category_filter(self.library.read("files"), "photo"))

    def plan_consolidation(self, inventory: DataFrame, destination: str) -> DataFrame:
        outside = C.indexed_outside(self.library.read("files"), destination)
        return C.plan_consolidation(C.readable(inventory), self.library.read("contents"), outside)

    def run_consolidation(self, inventory: DataFrame, **options) -> DataFrame:
        return run_consolidation(self.library, inventory, **options)

    def backup_coverage(self) -> DataFrame:
        read = self.library.read
        return C.newest_first(C.backup_coverage(read("backups"), read("occurrences"), read("contents")))

    def purge(self, requests: DataFrame, existing: DataFrame, app_roots: list[str]) -> DataFrame:
        """Verdicts for the requested paths; eligible ones leave the index."""
        roots = D.protected_roots(self.library.read("contents"))
        if app_roots:
            roots = roots.unionByName(self.spark.createDataFrame([(r,) for r in app_roots], "root string"))
        verdicts = D.purge_verdict(requests, roots, existing)
        self.library.remove_index(D.eligible_paths(verdicts))
        return verdicts

    def scan_categories(self, inventory: DataFrame) -> DataFrame:
        return Y.category_scan(inventory)

    def run_sync(self, inventory: DataFrame, target: DataFrame, requested: DataFrame, source_root: str,
                 destination_root: str) -> tuple[DataFrame, DataFrame]:
        """(action per file, verdict per requested category)"""
        verdicts = Y.requested_verdicts(requested, inventory, source_root)
        return Y.sync_actions(inventory, target, verdicts, destination_root), verdicts

    def item_metrics(self, documents: DataFrame) -> DataFrame:
        return V.item_metrics(documents)

    def archive_inventory(self, entries: DataFrame, inventory: DataFrame) -> DataFrame:
        return V.archive_inventory(entries).unionByName(V.folder_inventory(inventory, ["CALENDER", "APK"]))

    def structured_records(self, inventory: DataFrame, payloads: DataFrame) -> DataFrame:
        return R.structured_records(inventory, payloads)

    def message_records(self, messages: DataFrame, database_path: str, limit: int = K.MESSAGE_SAMPLE) -> DataFrame:
        return R.messages(messages, database_path, limit)
