import csv
import glob

import pytest
from conftest import at
from pyspark.sql import functions as F

from shelfmark.operators import report, snapshots
from shelfmark.operators.filters import SearchFilters


@pytest.fixture
def tables(make_files, make_disks):
    files = make_files(
        {"disk_id": 1, "path": r"C:\books\b.epub", "size_bytes": 2048, "hash": "hh", "modified_date": at("2024-05-01T10:00:00.25")},
        {"disk_id": 2, "path": r"D:\a.jpg", "size_bytes": 0, "created_date": None, "modified_date": None},
        {"disk_id": 3, "path": r"C:\notes", "size_bytes": 5},
        {"disk_id": 9, "path": r"C:\orphan.txt"},
    )
    disks = make_disks(
        {"disk_id": 1, "volume_serial": "S1", "label": "Shelf"},
        {"disk_id": 2, "volume_serial": "S2", "label": ""},
        {"disk_id": 3, "volume_serial": "S3"},
    )
    return files, disks


def test_export_is_whole_and_by_path(tables):
    files, disks = tables
    rows = report.export_rows(files, disks).collect()
    assert [r.path for r in rows] == [r"C:\books\b.epub", r"C:\notes", r"D:\a.jpg"]
    assert [r.disk_label for r in rows] == ["Shelf", None, ""]


def test_export_of_one_disk(tables):
    files, disks = tables
    assert [r.disk_id for r in report.export_rows(files, disks, SearchFilters(disk_id=2)).collect()] == [2]
    assert report.export_rows(files, disks, limit=1).count() == 1


def test_an_export_is_not_a_page(make_files, make_disks):
    files = make_files(*[(1, f"C:\\f{n:03d}.pdf", n, None) for n in range(300)])
    disks = make_disks({"disk_id": 1, "volume_serial": "S1"})
    assert report.export_rows(files, disks, SearchFilters(disk_id=1)).count() == 300
    assert report.export_rows(files, disks, SearchFilters(extension="pdf", limit=1)).count() == 300


def test_report_rows(tables):
    out = report.report(report.export_rows(*tables))
    assert tuple(out.columns) == report.HEADERS
    assert [tuple(r) for r in out.collect()] == [
        ("Shelf", r"C:\books", "b.epub", ".epub", "Book", 2048, "2.0 KB", "2024-05-01T00:00:00+00:00", "2024-05-01T10:00:00.250000+00:00", "hh"),
        ("3", "C:\\", "notes", "", "Other", 5, "5 B", "2024-05-01T00:00:00+00:00", "2024-05-01T00:00:00+00:00", ""),
        ("2", "D:\\", "a.jpg", ".jpg", "Image", 0, "0 B", "", "", ""),
    ]


def test_widths(tables, make_files):
    files, disks = tables
    got = [tuple(r) for r in report.report_widths(report.report(report.export_rows(files, disks))).collect()]
    rows = report.report(report.export_rows(files, disks)).collect()
    longest = [max(len(h), *(len(str(r[i])) for r in rows)) for i, h in enumerate(report.HEADERS)]
    assert got == [(i, h, min(max(n + 2, 10), 80)) for i, (h, n) in enumerate(zip(report.HEADERS, longest))]
    long = make_files((1, "C:\\" + "x" * 300 + "\\f", 1, None))
    wide = {r.heading: r.width for r in report.report_widths(report.report(report.export_rows(long, disks))).collect()}
    assert wide["Folder"] == 80 and wide["Hash"] == 10
    empty = report.report_widths(report.report(report.export_rows(files.where("false"), disks)))
    assert {r.heading: r.width for r in empty.collect()}["Size (bytes)"] == 14


def test_written_report(tables, tmp_path):
    report.write_report(report.export_rows(*tables), str(tmp_path / "out"))
    lines = []
    for part in sorted(glob.glob(str(tmp_path / "out" / "part-*.csv"))):
        with open(part, newline="", encoding="utf-8") as f:
            got = list(csv.reader(f))
        assert tuple(got[0]) == report.HEADERS
        lines += got[1:]
    assert [line[2] for line in lines] == ["b.epub", "notes", "a.jpg"]
    assert [line[1] for line in lines] == [r"C:\books", "C:\\", "D:\\"]


def test_newest_snapshots(spark):
    days = spark.range(100).select(F.format_string("202401%02d", F.col("id") % 20 + 1).alias("day"), "id")
    kept = snapshots.newest_snapshots(days, "day", 3)
    assert {r.day for r in kept.select("day").distinct().collect()} == {"20240118", "20240119", "20240120"}
    assert kept.count() == 15
    with pytest.raises(ValueError):
        snapshots.newest_snapshots(days, "day", 0)
