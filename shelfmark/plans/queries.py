"""Every registered query: (session, table folder) -> DataFrame."""

from __future__ import annotations

import mimetypes
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as C
from ..operators import by_need, changes, disks, duplicates, folders, hashing, intervals, ledger, maintained
from ..operators import name_index, report, search, snapshots, stats, zones
from ..operators.filters import SearchFilters
from ..schemas import FILE_KEY
from . import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# the moment at which the ledger and disk queries happen
AT = "2024-06-01 12:00:00"
# small limits so that documents fall on both sides of "large"
SMALL = hashing.HashPolicy(mode="sampled", large=4096, sample=1024)


def _at():
    return F.lit(AT).cast("timestamp_ntz")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _placed(rows: DataFrame) -> DataFrame:
    """A page of ordered rows with their place, so that a check sees the order."""
    marked = rows.withColumn("_at", F.monotonically_increasing_id())
    return marked.withColumn("position", F.row_number().over(Window.orderBy("_at")).cast("long")).drop("_at")


# -- search -------------------------------------------------------------------


@query
def search_name(spark, sf):
    return _placed(search.search_files(t.files(spark, sf), SearchFilters(name="OC_1%2")))


@query
def search_ext(spark, sf):
    return _placed(search.search_files(t.files(spark, sf), SearchFilters(extension="TXT")))


@query
def search_size(spark, sf):
    return _placed(search.search_files(t.files(spark, sf), SearchFilters(min_size=1000, max_size=4000)))


@query
def search_modified(spark, sf):
    return search.search_files(
        t.files(spark, sf),
        SearchFilters(modified_after="2024-01-02", modified_before="2024-01-20T06:00:00+02:00"),
    )


@query
def search_disk_scan(spark, sf):
    return search.search_files(t.files_orders(spark, sf), SearchFilters(disk_id=2, scan_id=14, limit=None))


@query
def search_combined(spark, sf):
    found = search.search_files(
        t.files_orders(spark, sf),
        SearchFilters(
            name="order_1", extension="pdf", min_size=1009, disk_id=3, modified_after="1996-01-01", limit=500
        ),
    )
    return _placed(found)


@query
def search_everything(spark, sf):
    return search.search_files(t.files_orders(spark, sf), SearchFilters(limit=-1))


@query
def search_listing(spark, sf):
    return _placed(search.search_listing(t.files(spark, sf), disk_id=2, query="doc_"))


@query
def category_filter(spark, sf):
    return search.filter_category(search.search_listing(t.files(spark, sf), limit=None), "Archive")


@query
def category_filter_other(spark, sf):
    return search.filter_category(search.search_listing(t.files(spark, sf), limit=None), "Other")


@query
def category_facets(spark, sf):
    return search.category_facets(t.files(spark, sf))


@query
def category_facets_search(spark, sf):
    return search.category_facets(search.search_listing(t.files(spark, sf), disk_id=1))


@query
def category_facets_single(spark, sf):
    return search.category_facets(t.files_orders(spark, sf))


@query
def path_known(spark, sf):
    return search.known_paths(t.requested_paths(spark, sf), t.files(spark, sf))


# -- duplicates ---------------------------------------------------------------


@query
def duplicates_found(spark, sf):
    return duplicates.find_duplicates(t.files_orders(spark, sf), 200)


@query
def duplicates_all(spark, sf):
    return duplicates.find_duplicates(t.files(spark, sf), None)


@query
def duplicate_members(spark, sf):
    return duplicates.duplicate_members(t.files_orders(spark, sf))


@query
def duplicate_members_top(spark, sf):
    return duplicates.duplicate_members(t.files(spark, sf), 50)


@query
def files_for_hash(spark, sf):
    files = t.files(spark, sf)
    largest = duplicates.find_duplicates(files, 1).select("hash").scalar()
    return search.files_for_hash(files, largest)


# -- statistics ---------------------------------------------------------------


@query
def catalog_totals(spark, sf):
    return stats.catalog_totals(t.files_orders(spark, sf))


@query
def disk_stats(spark, sf):
    return stats.disk_stats(t.disks(spark, sf), t.files_orders(spark, sf))


@query
def disk_list(spark, sf):
    return stats.list_disks(t.disks(spark, sf), t.files(spark, sf))


# -- folders ------------------------------------------------------------------


@query
def descendants(spark, sf):
    below = folders.descendants(t.files_orders(spark, sf), 4, "e:\\orders\\1996")
    return below.select("disk_id", "path", "size_bytes", "modified_date")


@query
def browse_folders(spark, sf):
    return folders.browse_folders(t.files_orders(spark, sf), 2, "e:\\ORDERS")


@query
def browse_files(spark, sf):
    return folders.browse_files(t.files(spark, sf), 1, "D:\\Archive\\src0\\en")


@query
def browse_root_folders(spark, sf):
    return folders.browse(t.files_orders(spark, sf), 1).folders


@query
def browse_root_files(spark, sf):
    return folders.browse(t.files_events(spark, sf), 1).files


@query
def browse_root_location(spark, sf):
    return folders.browse(t.files(spark, sf), 1).location


@query
def browse_top(spark, sf):
    return folders.browse_folders(t.prior_files(spark, sf), 1, "D:")


@query
def folder_rollup(spark, sf):
    return folders.folder_rollup(t.files_orders(spark, sf))


@query
def folder_rollup_documents(spark, sf):
    return folders.folder_rollup(t.files(spark, sf))


# -- scalar functions ---------------------------------------------------------


@query
def path_functions(spark, sf):
    folder = C.parent_folder("path")
    return t.files(spark, sf).select(
        "path",
        C.suffix("filename").alias("suffix"),
        folder.alias("folder"),
        F.size(C.path_segments("path")).cast("long").alias("depth"),
        F.get(C.path_segments("path"), F.lit(2)).alias("third"),
        C.parent_path(folder).alias("above"),
        C.parent_path(F.substring("path", 1, 2)).alias("above_drive"),
    )


@query
def ancestor_folders(spark, sf):
    rows = t.files_orders(spark, sf).select("path", F.posexplode(C.ancestors("path")).alias("level", "step"))
    return rows.select("path", F.col("level").cast("long"), "step.label", F.col("step.path").alias("folder"))


@query
def url_paths(spark, sf):
    url = F.col("url")
    return t.table(spark, sf, "pages").select(
        "url",
        C.suffix(url).alias("suffix"),
        F.size(C.path_segments(url, "/")).cast("long").alias("depth"),
        C.parent_folder(url, "/").alias("folder"),
        C.parent_path(url, "/").alias("above"),
    )


@query
def size_functions(spark, sf):
    size = F.col("size_bytes")
    # a million times a long may be beyond a long
    exact = size.cast("decimal(20,0)")
    return t.files_orders(spark, sf).select(
        "path",
        C.human_size(size).alias("as_is"),
        C.human_size(exact * 1000).alias("thousandfold"),
        C.human_size(exact * 1_000_000).alias("millionfold"),
        C.human_size(size % 3000).alias("below"),
    )


@query
def document_sizes(spark, sf):
    d = t.table(spark, sf, "documents")
    return d.select("doc_id", C.human_size(F.octet_length("text") * 128).alias("size_human"))


def type_names() -> list[str]:
    """Suffixes for the MIME query: known ones, packed ones, odd ones."""
    known = sorted(mimetypes.MimeTypes(filenames=()).types_map[True])
    odd = ["", ".", ".none", ".JPG", ".tar.gz", ".tgz", ".TGZ", ".svgz", ".txt.Z", ".txt.z", ".csv.bz2", ".gz", ".a.b.xz"]
    return known + odd


@query
def mime_types(spark, sf):
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), t.pick(tuple(type_names()), F.col("doc_id")))
    d = t.table(spark, sf, "documents").withColumn("filename", name)
    return d.select("doc_id", "filename", C.mime_type("filename").alias("mime_type"))


@query
def categories(spark, sf):
    return t.files(spark, sf).select(
        "path",
        C.categorize("extension").alias("category"),
        C.categorize(F.upper("extension")).alias("category_upper"),
        C.categorize(F.nullif("extension", F.lit(""))).alias("category_null"),
    )


@query
def display_functions(spark, sf):
    return t.files(spark, sf).select(
        "path",
        C.short_hash("hash").alias("short_hash"),
        C.display_ts("modified_date").alias("shown"),
        C.display_ts(F.when(F.col("hash").isNotNull(), F.col("created_date"))).alias("shown_or_blank"),
        C.blank_if_null("hash").alias("hash_or_blank"),
        C.iso_utc("modified_date").alias("iso"),
    )


@query
def strip_labels(spark, sf):
    return t.patches(spark, sf).select("seq", C.strip("label").alias("label"))


# -- rescans ------------------------------------------------------------------


@query
def change_kinds(spark, sf):
    rows = changes.classify_changes(t.rescanned_files(spark, sf), t.prior_files(spark, sf))
    return rows.select("disk_id", "path", "size_bytes", "change_kind", "hash", "hash_algo")


@query
def hash_reuse(spark, sf):
    def digest(content):
        return hashing.sha256_of(content, F.col("size_bytes"), SMALL)

    algo = SMALL.algo(F.col("size_bytes"), "sha256", "sha256-sampled")
    rows = changes.reuse_hashes(t.rescanned_files(spark, sf, content=True), t.prior_files(spark, sf), digest, algo)
    return rows.select("disk_id", "path", "change_kind", "hash", "hash_algo")


@query
def hash_reuse_blake2b(spark, sf):
    """The hashes themselves have no SQL: rows that share one are counted instead."""

    def digest(content):
        return hashing.blake2b_of(content, F.col("size_bytes"), SMALL)

    incoming, prior = t.rescanned_files(spark, sf, content=True), t.prior_files(spark, sf)
    rows = changes.reuse_hashes(incoming, prior, digest, SMALL.algo(F.col("size_bytes")))
    kept = F.when(F.col("change_kind") == changes.UNCHANGED, F.col("hash"))
    groups = rows.groupBy("hash", "change_kind", "hash_algo").agg(F.count("*").alias("files"), F.max(kept).alias("kept_hash"))
    return groups.drop("hash")


@query
def listing_match(spark, sf):
    rows = changes.match_listing(t.rescanned_files(spark, sf), t.prior_files(spark, sf))
    return rows.select(
        "disk_id",
        "path",
        "change_kind",
        "size_bytes",
        F.col("old.size_bytes").alias("old_size"),
        F.col("old.hash").alias("old_hash"),
    )


@query
def catalog_upsert(spark, sf):
    return changes.upsert_files(t.prior_files(spark, sf), t.rescanned_files(spark, sf))


@query
def upsert_batch(spark, sf):
    return changes.upsert_files(t.earlier_batch(spark, sf), t.incoming_batch(spark, sf))


@query
def upsert_last_wins(spark, sf):
    order = [F.col(c) for c in ("last_seen", "l_partkey", "l_suppkey", "l_extendedprice")]
    rows = changes.last_row_wins(t.batch_files(spark, sf), FILE_KEY, order)
    return rows.select("disk_id", "path", "size_bytes", "last_seen")


# -- kept up to date ----------------------------------------------------------


def _matched(spark, sf):
    return changes.match_listing(t.rescanned_files(spark, sf), t.prior_files(spark, sf))


@query
def rollup_maintained(spark, sf):
    """The folder totals after a rescan, from those before it and what changed."""
    stored = folders.folder_rollup(t.prior_files(spark, sf))
    more = maintained.rollup_changes(maintained.signed_changes(_matched(spark, sf)))
    return maintained.add_up_rollup(stored.unionByName(more))


@query
def rollup_after_moves(spark, sf):
    """The same where files that are gone leave the catalog."""
    stored = folders.folder_rollup(t.prior_files(spark, sf))
    more = maintained.rollup_changes(maintained.signed_changes(_matched(spark, sf), drop_unseen=True))
    return maintained.add_up_rollup(stored.unionByName(more))


def _hash_state(spark, sf):
    return maintained.hash_changes(maintained.signed(t.prior_files(spark, sf), 1))


@query
def duplicates_maintained(spark, sf):
    more = maintained.hash_changes(maintained.signed_changes(_matched(spark, sf), drop_unseen=True))
    return maintained.add_up_hashes(_hash_state(spark, sf).unionByName(more)).where("copies > 1")


@query
def duplicate_group_changes(spark, sf):
    more = maintained.hash_changes(maintained.signed_changes(_matched(spark, sf), drop_unseen=True))
    return maintained.group_changes(_hash_state(spark, sf), more)


@query
def folder_intervals(spark, sf):
    return intervals.folder_intervals(t.files_orders(spark, sf))


@query
def below_by_interval(spark, sf):
    files = t.files_orders(spark, sf)
    numbers = intervals.folder_intervals(files)
    found = intervals.below(intervals.numbered_files(files, numbers), numbers, 4, "E:\\Orders\\1996")
    return found.select("disk_id", "path", "size_bytes", "modified_date")


# -- searches that skip -------------------------------------------------------


def _months(spark, sf):
    """The files of orders with the folder they lie in as their zone or block."""
    return t.files_orders(spark, sf).withColumn("block", F.concat_ws(":", "disk_id", C.parent_folder("path")))


@query
def search_by_name_index(spark, sf):
    files = _months(spark, sf)
    found = name_index.search_by_index(files, name_index.postings(files, "block"), "block", "R_123")
    return found.select("disk_id", "path", "filename")


@query
def search_by_name_index_pieces(spark, sf):
    files = t.files(spark, sf).withColumn("block", C.parent_folder("path"))
    found = name_index.search_by_index(files, name_index.postings(files, "block"), "block", "9.TXT")
    return found.select("disk_id", "path", "filename")


@query
def newest_page(spark, sf):
    files = _months(spark, sf)
    page = zones.newest_page(files, zones.zone_bounds(files, "block"), "block", 300)
    return _placed(page.select("disk_id", "path", "modified_date"))


@query
def newest_page_after(spark, sf):
    files = _months(spark, sf)
    bounds = zones.zone_bounds(files, "block")
    key = (F.lit("1996-07-01").cast("timestamp_ntz"), "E:\\Orders\\1996\\07\\order_2", 2)
    page = zones.newest_page(files, bounds, "block", 250, key)
    return _placed(page.select("disk_id", "path", "modified_date"))


@query
def equal_by_need(spark, sf):
    rows = t.files(spark, sf, content=True).drop("hash", "hash_algo")
    found = by_need.equal_content(rows, lambda content: F.sha2(content, 256), 16)
    return found.select("doc_id", "disk_id", "path", "size_bytes", "hash")


# -- disks, scans, errors -----------------------------------------------------


@query
def disk_upsert(spark, sf):
    return disks.upsert_disks(t.disks(spark, sf), t.volumes(spark, sf), _at())


@query
def disk_patch(spark, sf):
    return disks.patch_disks(t.disks(spark, sf), t.patches(spark, sf))


@query
def disk_patch_unknown(spark, sf):
    return disks.unknown_patches(t.disks(spark, sf), t.patches(spark, sf))


@query
def disks_v1_as_v2(spark, sf):
    return disks.read_disks(t.disks_v1(spark, sf))


@query
def scan_close_stale(spark, sf):
    return ledger.close_stale(t.scans(spark, sf), 7, _at())


@query
def scan_close_stale_disks(spark, sf):
    return ledger.close_stale_disks(t.scans(spark, sf), t.disks(spark, sf), _at())


@query
def scan_open(spark, sf):
    scans = t.scans(spark, sf)
    return ledger.open_scan(ledger.close_stale(scans, 7, _at()), 0, 7, "E:\\Orders", _at())


@query
def scan_finish(spark, sf):
    return ledger.finish_scan(t.scans(spark, sf), 12, 345, 6, _at())


@query
def scan_counts(spark, sf):
    _, errors = ledger.split_errors(t.listing_events(spark, sf))
    return ledger.scan_counts(t.files_orders(spark, sf), errors)


@query
def scan_errors(spark, sf):
    return ledger.split_errors(t.listing_events(spark, sf))[1]


@query
def scan_listed(spark, sf):
    return ledger.split_errors(t.listing_events(spark, sf))[0]


# -- hashes -------------------------------------------------------------------


@query
def hash_modes(spark, sf):
    size = F.col("size_bytes")
    rows = t.files(spark, sf, content=True)
    whole, none = hashing.HashPolicy("full", 4096, 1024), hashing.HashPolicy("none")
    return rows.select(
        "doc_id",
        hashing.sha256_of(F.col("content"), size, SMALL).alias("sampled_hash"),
        SMALL.algo(size, "sha256", "sha256-sampled").alias("sampled_algo"),
        hashing.sha256_of(F.col("content"), size, whole).alias("full_hash"),
        whole.algo(size, "sha256", "sha256-sampled").alias("full_algo"),
        hashing.sha256_of(F.col("content"), size, none).alias("no_hash"),
        none.algo(size).alias("no_algo"),
    )


@query
def blake2b_groups(spark, sf):
    whole = hashing.HashPolicy("full")
    rows = t.files(spark, sf, content=True)
    hashed = rows.select(
        "size_bytes", hashing.blake2b_of(F.col("content"), F.col("size_bytes"), whole).alias("hash")
    )
    groups = duplicates.find_duplicates(hashed, None)
    return groups.select("copies", "total_bytes")


@query
def blake2b_sampled_groups(spark, sf):
    rows = t.files(spark, sf, content=True)
    hashed = rows.select(
        "size_bytes", hashing.blake2b_of(F.col("content"), F.col("size_bytes"), SMALL).alias("hash")
    )
    return duplicates.find_duplicates(hashed, None).select("copies", "total_bytes")


# -- report and snapshots -----------------------------------------------------


@query
def export_rows(spark, sf):
    return report.export_rows(t.files(spark, sf), t.disks(spark, sf))


@query
def export_disk(spark, sf):
    return report.export_rows(
        t.files_orders(spark, sf), t.disks(spark, sf), SearchFilters(disk_id=4, extension=".PDF")
    )


@query
def export_filtered(spark, sf):
    return report.export_rows(t.files_orders(spark, sf), t.disks(spark, sf), SearchFilters(name="order_", min_size=1))


@query
def export_first(spark, sf):
    return _placed(report.export_rows(t.files(spark, sf), t.disks(spark, sf), limit=150))


@query
def report_rows(spark, sf):
    return report.report(report.export_rows(t.files(spark, sf), t.disks(spark, sf)))


@query
def report_widths(spark, sf):
    return report.report_widths(report.report(report.export_rows(t.files(spark, sf), t.disks(spark, sf))))


@query
def snapshot_keep(spark, sf):
    daily = t.table(spark, sf, "events").withColumn("snapshot", F.date_format("ts", "yyyyMMdd"))
    return snapshots.newest_snapshots(daily, "snapshot", 7).select("snapshot", "event_id", "event_type", "value")
