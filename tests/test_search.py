import datetime as dt

import pytest
from conftest import at, plan_of
from pyspark.sql import functions as F

from shelfmark.operators import duplicates, search, stats
from shelfmark.operators.filters import SearchFilters, apply_filters


@pytest.fixture
def small(make_files):
    return make_files(
        (1, r"C:\docs\Report 100%.TXT", 10, "aa"),
        (1, r"C:\docs\report_2.txt", 20, "aa"),
        (1, r"C:\pics\šuma.JPG", 3000, "bb"),
        (2, r"C:\pics\ŠUMA.jpg", 3000, None),
        {"disk_id": 2, "path": r"C:\x!y", "size_bytes": 7, "scan_id": 9, "modified_date": at("2024-06-01T00:00:00")},
    )


def names(df):
    return sorted(r["filename"] for r in df.collect())


def test_no_filter_gives_everything(small):
    assert search.search_files(small).count() == 5
    assert apply_filters(small, None).count() == 5
    assert search.search_files(small, SearchFilters(name="", extension="", modified_after="")).count() == 5


def test_name_folds_ascii_only(small):
    assert names(search.search_files(small, SearchFilters(name="REPORT"))) == ["Report 100%.TXT", "report_2.txt"]
    assert names(search.search_files(small, SearchFilters(name="šuma"))) == ["šuma.JPG"]


def test_name_wildcards_stay_wildcards(small):
    assert names(search.search_files(small, SearchFilters(name="t%2"))) == ["report_2.txt"]
    assert names(search.search_files(small, SearchFilters(name="r_port"))) == ["Report 100%.TXT", "report_2.txt"]


def test_name_special_characters_are_ordinary(small, make_files):
    assert names(search.search_files(small, SearchFilters(name="X!Y"))) == ["x!y"]
    odd = make_files({"disk_id": 1, "path": "p", "filename": "a\\b!c"}, {"disk_id": 1, "path": "q", "filename": "ab"})
    assert names(search.search_files(odd, SearchFilters(name="A\\B"))) == ["a\\b!c"]
    assert names(search.search_files(odd, SearchFilters(name="\\b!"))) == ["a\\b!c"]


def test_extension_with_or_without_dot(small):
    for ext in ("txt", ".TXT"):
        assert names(search.search_files(small, SearchFilters(extension=ext))) == ["Report 100%.TXT", "report_2.txt"]


def test_sizes_are_inclusive_and_zero_counts_as_given(small):
    assert names(search.search_files(small, SearchFilters(min_size=10, max_size=20))) == ["Report 100%.TXT", "report_2.txt"]
    assert search.search_files(small, SearchFilters(max_size=0)).count() == 0


def test_disk_and_scan(small):
    assert names(search.search_files(small, SearchFilters(disk_id=2, scan_id=9))) == ["x!y"]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_date_bounds(spark, small, kind):
    zone = spark.conf.get("spark.sql.session.timeZone")
    files = small.withColumn("modified_date", F.col("modified_date").cast(kind))
    assert names(search.search_files(files, SearchFilters(modified_after="2024-06-01"))) == ["x!y"]
    assert search.search_files(files, SearchFilters(modified_before="2024-05-01")).count() == 4
    assert search.search_files(files, SearchFilters(modified_before="2024-05-01T01:59:59+02:00")).count() == 0
    assert search.search_files(files, SearchFilters(modified_after=dt.datetime(2024, 6, 1, 0, 0, 1))).count() == 0
    assert spark.conf.get("spark.sql.session.timeZone") == zone


def test_newest_first_with_limit(small):
    first = search.search_files(small, SearchFilters(limit=2)).collect()
    assert [r["path"] for r in first] == [r"C:\x!y", r"C:\docs\Report 100%.TXT"]
    assert search.search_files(small, SearchFilters(limit=0)).count() == 0
    for unlimited in (None, -1):
        assert search.search_files(small, SearchFilters(limit=unlimited)).count() == 5


def test_default_limit_is_200(spark, make_files):
    many = make_files(*[(1, f"p{i}", i, None) for i in range(250)])
    assert search.search_files(many).count() == 200


def test_filters_reach_the_scan(small, tmp_path):
    small.write.parquet(str(tmp_path / "f"))
    stored = small.sparkSession.read.parquet(str(tmp_path / "f"))
    wanted = SearchFilters(extension="txt", min_size=5, disk_id=1, modified_after="2024-01-01")
    plan = plan_of(search.search_files(stored, wanted))
    assert "EqualTo(extension,.txt)" in plan and "GreaterThanOrEqual(size_bytes,5)" in plan
    assert "EqualTo(disk_id,1)" in plan and "GreaterThanOrEqual(modified_date," in plan
    assert "mime_type" not in plan and "TakeOrderedAndProject" in plan


def test_listing_and_categories(small):
    rows = search.search_listing(small, 1, "suma").collect()
    assert rows == []
    rows = search.search_listing(small, 1, "uma").collect()
    assert [(r.name, r.category, r.size_human) for r in rows] == [("šuma.JPG", "Image", "2.9 KB")]
    listing = search.search_listing(small)
    assert search.filter_category(listing, "Image").count() == 2
    assert search.filter_category(listing, None).count() == 5


def test_facets(small):
    listing = search.search_listing(small)
    got = [(r.category, r.file_count) for r in search.category_facets(listing).orderBy("position").collect()]
    assert got == [("All", 5), ("Document", 2), ("Image", 2), ("Other", 1)]
    assert search.category_facets(search.filter_category(listing, "Image")).count() == 0
    assert search.category_facets(listing.where("false")).count() == 0


def test_duplicates(small):
    got = [tuple(r) for r in duplicates.find_duplicates(small).collect()]
    assert got == [("aa", 2, 30)]
    assert duplicates.find_duplicates(small, 0).count() == 0
    assert [r.path for r in search.files_for_hash(small, "aa").collect()] == [r"C:\docs\Report 100%.TXT", r"C:\docs\report_2.txt"]


@pytest.mark.parametrize("limit", [None, 3, 20_000])
def test_duplicate_members_with_a_hot_hash(make_files, limit):
    rows = [(1 + i % 2, f"p{i}", 1, "hot") for i in range(400)]
    rows += [(1, f"q{i}", 5, f"pair{i // 2}") for i in range(100)] + [(1, f"s{i}", 9, f"one{i}") for i in range(50)]
    rows += [(1, f"n{i}", 9, None) for i in range(50)]
    files = make_files(*rows)
    got = {(r.hash, r.copies, r.total_bytes, r.disk_id, r.path) for r in duplicates.duplicate_members(files, limit).collect()}
    groups = {}
    for disk, path, size, digest in rows:
        groups.setdefault(digest, []).append((disk, path, size))
    kept = [(sum(s for *_, s in g), h, g) for h, g in groups.items() if h and len(g) > 1]
    kept.sort(key=lambda k: (-k[0], k[1]))
    expected = {(h, len(g), total, d, p) for total, h, g in kept[:limit] for d, p, _ in g}
    assert got == expected


def test_totals(small, make_disks):
    assert tuple(stats.catalog_totals(small).first()) == (5, 6037)
    assert tuple(stats.catalog_totals(small.where("false")).first()) == (0, 0)
    disks = make_disks(
        {"disk_id": 1, "volume_serial": "S1", "label": "one", "description": "d"},
        {"disk_id": 2, "volume_serial": "S2", "label": ""},
        {"disk_id": 3, "volume_serial": "S3"},
    )
    got = [tuple(r) for r in stats.disk_stats(disks, small).collect()]
    assert got == [(1, "one", "S1", 3, 3030), (2, "", "S2", 2, 3007), (3, None, "S3", 0, 0)]
    got = [(r.label, r.description, r.size_human) for r in stats.list_disks(disks, small).collect()]
    assert got == [("one", "d", "3.0 KB"), ("(unlabeled)", "", "2.9 KB"), ("(unlabeled)", "", "0 B")]


def test_catalog_of_more_bytes_than_a_long(make_files):
    files = make_files((1, "a", 2**63 - 1, None), (1, "b", 2**63 - 1, None), (2, "c", 3, None))
    assert tuple(stats.catalog_totals(files).first()) == (3, 2**64 + 1)
    # all sizes together just fit, or just do not
    for more, kind in ((0, "bigint"), (1, "decimal(38,0)")):
        found = stats.catalog_totals(make_files((1, "a", 2**62, None), (1, "b", 2**62 - 1 + more, None)))
        assert (dict(found.dtypes)["total_bytes"], found.first()["total_bytes"]) == (kind, 2**63 - 1 + more)


def test_disk_of_more_bytes_than_a_long(make_files, make_disks):
    files = make_files((1, "a", 2**63 - 1, None), (1, "b", 2**63 - 1, None), (2, "c", 3, None))
    disks = make_disks(*[{"disk_id": n, "volume_serial": f"S{n}"} for n in (1, 2, 3)])
    assert [tuple(r)[3:] for r in stats.disk_stats(disks, files).collect()] == [(2, 2**64 - 2), (1, 3), (0, 0)]
    got = [(r.total_bytes, r.size_human) for r in stats.list_disks(disks, files).collect()]
    assert got == [(2**64 - 2, "16384.0 PB"), (3, "3 B"), (0, "0 B")]


def test_known_paths(spark, small):
    asked = spark.createDataFrame([(r"C:\x!y", 1), ("nope", 2), (r"C:\x!y", 3)], "path string, nr int")
    got = {(r.nr, r.known) for r in search.known_paths(asked, small).collect()}
    assert got == {(1, True), (2, False), (3, True)}
