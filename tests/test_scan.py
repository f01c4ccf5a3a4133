import hashlib
import os
import stat
import subprocess
import sys
import threading
from pathlib import Path

import pytest
from conftest import at, plan_of
from pyspark.sql import functions as F

from shelfmark.operators import duplicates, search
from shelfmark.operators.folders import browse
from shelfmark.plans import scan as scan_plan
from shelfmark.plans.scan import Volume, scan
from shelfmark.sources import catalog as cat
from shelfmark.sources import filetree
from shelfmark.sources.catalog import Catalog
from shelfmark.sources.locks import Busy, Lock

DISK = Volume("S-1", "Shelf", "ext4", 1000)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "sub" / "deep").mkdir(parents=True)
    (root / "a.TXT").write_text("same")
    (root / "sub" / "b.txt").write_text("same")
    (root / "sub" / "deep" / "c.tar.gz").write_bytes(b"\0" * 5000)
    return root


@pytest.fixture
def odd(tree):
    """Everything a reader of ordinary data files would leave out."""
    (tree / ".hidden").write_text("x")
    (tree / "_under").write_text("x")
    (tree / "empty").touch()
    (tree / "broken").symlink_to(tree / "nowhere")
    (tree / "link").symlink_to(tree / "a.TXT")
    (tree / "folder").symlink_to(tree / "sub")
    (tree / "no files").mkdir()
    with open(os.path.join(os.fsencode(tree), b"bad\xff.txt"), "wb"):
        pass
    return tree


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "catalog"))


def walked(root):
    """What one walk over the tree finds."""
    found, failed = {}, set()
    for folder, _, names in os.walk(root):
        for name in names:
            path = os.path.join(folder, name)
            try:
                name.encode()
                found[path] = os.stat(path).st_size
            except (OSError, UnicodeEncodeError):
                failed.add(path.encode("utf-8", "surrogateescape").decode("utf-8", "backslashreplace"))
    return found, failed


def listed(rows):
    rows = rows.collect()
    good = {r.path: r.size_bytes for r in rows if r.error_message is None}
    return good, {r.path for r in rows if r.error_message is not None}, rows


# -- listing ------------------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 2, 3, 64])
def test_source_lists_like_a_walk(spark, odd, parts):
    filetree.register(spark)
    good, failed, rows = listed(spark.read.format("filetree").option("parts", parts).load(str(odd)))
    assert (good, failed) == walked(odd)
    assert len(rows) == len(good) + len(failed) == 9
    row = next(r for r in rows if r.filename == "a.TXT")
    assert row.extension == ".txt"
    moment = at().fromtimestamp((odd / "a.TXT").stat().st_mtime, at().tzinfo).replace(tzinfo=None)
    assert row.modified_date == moment


@pytest.mark.parametrize("budget", [1, 2, 1000])
def test_budgeted_listing_lists_like_a_walk(spark, odd, tmp_path, budget, monkeypatch):
    for n in range(12):
        (odd / "sub" / f"d{n}" / "e").mkdir(parents=True)
        (odd / "sub" / f"d{n}" / "e" / f"f{n}").write_text("x")
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 1)
    good, failed, rows = listed(filetree.list_tree(spark, str(odd), str(tmp_path / "walk"), budget, per_task=4))
    assert (good, failed) == walked(odd)
    assert len(rows) == len(good) + len(failed)


def test_missing_root(spark, tmp_path, catalog):
    with pytest.raises(FileNotFoundError):
        scan(catalog, str(tmp_path / "nowhere"), DISK)
    assert catalog.scans().count() == 0
    with pytest.raises(ValueError):
        scan(catalog, str(tmp_path), DISK, mode="quick")


def test_folder_that_cannot_be_listed_is_reported(spark, tree, tmp_path):
    # permissions do not bind the superuser, a file in place of a folder does
    rows = listed(filetree.list_tree(spark, str(tree / "a.TXT"), str(tmp_path / "w")))[2]
    assert len(rows) == 1 and rows[0].path == str(tree / "a.TXT") and "Not a directory" in rows[0].error_message


# -- scans --------------------------------------------------------------------


def digest(path):
    return hashlib.blake2b(path.read_bytes()).hexdigest()


def test_scan_then_search(catalog, odd):
    result = scan(catalog, str(odd), DISK)
    good, failed = walked(odd)
    assert (result.files_scanned, result.files_failed) == (len(good), len(failed))
    rows = {r.path: r for r in catalog.files().collect()}
    assert set(rows) == set(good)
    row = rows[str(odd / "a.TXT")]
    assert (row.hash, row.hash_algo, row.mime_type, row.extension) == (digest(odd / "a.TXT"), "blake2b", "text/plain", ".txt")
    assert {r.path for r in catalog.errors().collect()} == failed
    last = catalog.scans().first()
    assert (last.status, last.files_scanned, last.files_failed, last.root_path) == ("completed", len(good), len(failed), str(odd))
    disk = catalog.disks().first()
    assert (disk.disk_id, disk.label, disk.volume_serial) == (1, "Shelf", "S-1")
    groups = duplicates.find_duplicates(catalog.files()).collect()
    assert (groups[0].hash, groups[0].copies) == (digest(odd / "a.TXT"), 3)
    assert search.search_files(catalog.files()).count() == len(good)
    shown = browse(catalog.files(), 1, sep="/")
    assert "/" + shown.location.first().current_path == str(odd)
    assert [r.name for r in shown.folders.collect()] == ["sub"]


def test_rescan_hashes_only_what_changed(catalog, tree, monkeypatch):
    scan(catalog, str(tree), DISK)
    before = {r.path: r for r in catalog.files().collect()}
    (tree / "a.TXT").write_text("other content")
    (tree / "new.bin").write_text("new")
    (tree / "sub" / "b.txt").unlink()
    hashed = []
    real = scan_plan.hash_files

    def spy(rows, policy):
        hashed.extend(r.path for r in rows.collect())
        return real(rows, policy)

    monkeypatch.setattr(scan_plan, "hash_files", spy)
    result = scan(catalog, str(tree), Volume("S-1", "renamed", "xfs", 7))
    assert sorted(hashed) == [str(tree / "a.TXT"), str(tree / "new.bin")]
    assert result.files_scanned == 3 and result.scan_id == 2
    after = {r.path: r for r in catalog.files().collect()}
    assert set(after) == set(before) | {str(tree / "new.bin")}
    gone = str(tree / "sub" / "b.txt")
    assert after[gone] == before[gone] and after[gone].scan_id == 1
    assert after[str(tree / "a.TXT")].hash == digest(tree / "a.TXT")
    kept = str(tree / "sub" / "deep" / "c.tar.gz")
    assert after[kept].hash == before[kept].hash and after[kept].scan_id == 2
    disk = catalog.disks().first()
    assert (disk.label, disk.filesystem, disk.total_bytes) == ("Shelf", "xfs", 7)


def test_mode_none_then_full_keeps_null_hashes(catalog, tree):
    scan(catalog, str(tree), DISK, mode="none")
    assert {(r.hash, r.hash_algo) for r in catalog.files().collect()} == {(None, None)}
    scan(catalog, str(tree), DISK, mode="full")
    assert {r.hash for r in catalog.files().collect()} == {None}


def test_two_disks_do_not_touch_each_other(catalog, tree, tmp_path):
    scan(catalog, str(tree), DISK)
    other = tmp_path / "other"
    other.mkdir()
    (other / "z").write_text("z")
    assert scan(catalog, str(other), Volume("S-2")).disk_id == 2
    assert catalog.files(1).count() == 3 and catalog.files(2).count() == 1 and catalog.files().count() == 4
    plan = plan_of(catalog.files().where(F.col("disk_id") == 2))
    assert "PartitionFilters: [isnotnull(disk_id" in plan


def test_file_that_fails_to_hash_is_an_error(catalog, tree, monkeypatch):
    os.mkfifo(tree / "pipe")
    result = scan(catalog, str(tree), DISK)
    assert (result.files_scanned, result.files_failed) == (3, 1)
    assert "not a regular file" in catalog.errors().first().error_message
    assert stat.S_ISFIFO((tree / "pipe").stat().st_mode)


def test_changed_file_that_fails_keeps_its_row(catalog, tree):
    scan(catalog, str(tree), DISK)
    before = {r.path: r for r in catalog.files().collect()}
    os.unlink(tree / "a.TXT")
    os.mkfifo(tree / "a.TXT")
    result = scan(catalog, str(tree), DISK)
    after = {r.path: r for r in catalog.files().collect()}
    assert (result.files_scanned, result.files_failed) == (2, 1) and set(after) == set(before)
    assert after[str(tree / "a.TXT")] == before[str(tree / "a.TXT")]
    assert [r.path for r in catalog.errors().collect()] == [str(tree / "a.TXT")]


def test_stopped_rescan_leaves_unhashed_rows_as_they_were(catalog, tree, monkeypatch):
    scan(catalog, str(tree), DISK)
    before = {r.path: r for r in catalog.files().collect()}
    (tree / "a.TXT").write_text("changed")
    (tree / "new").write_text("n")
    (tree / "sub" / "b.txt").unlink()

    def stopping(rows, policy):
        raise RuntimeError

    monkeypatch.setattr(scan_plan, "hash_files", stopping)
    with pytest.raises(RuntimeError):
        scan(catalog, str(tree), DISK)
    after = {r.path: r for r in catalog.files().collect()}
    assert set(after) == set(before)
    for name in ("a.TXT", "sub/b.txt"):
        assert after[str(tree / name)] == before[str(tree / name)]
    assert after[str(tree / "sub" / "deep" / "c.tar.gz")].scan_id == 2


def test_staged_tables_are_dropped(catalog, tree):
    scan(catalog, str(tree), DISK)
    mine = scan_plan._Run(catalog, 1, 1, None).staging
    assert mine.startswith(catalog.root)
    assert not catalog.folders.matching(mine) and not catalog.folders.matching(f"{catalog.root}/_locks/*")


# -- several writers ----------------------------------------------------------


def at_once(*jobs):
    """Runs functions in threads; gives what each returned or raised."""
    out = [None] * len(jobs)

    def run(n):
        try:
            out[n] = jobs[n]()
        except Exception as exc:
            out[n] = exc

    threads = [threading.Thread(target=run, args=(n,)) for n in range(len(jobs))]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    return out


def test_scans_of_two_disks_at_once(catalog, tree, tmp_path):
    other = tmp_path / "other"
    other.mkdir()
    (other / "z").write_text("z")
    one, two = at_once(lambda: scan(catalog, str(tree), DISK), lambda: scan(catalog, str(other), Volume("S-2")))
    assert {one.scan_id, two.scan_id} == {1, 2} and {one.disk_id, two.disk_id} == {1, 2}
    assert (one.files_scanned, two.files_scanned) == (3, 1)
    assert catalog.files().count() == 4 and catalog.disks().count() == 2
    assert {r.status for r in catalog.scans().collect()} == {"completed"}


def test_a_live_scan_is_left_alone(catalog, tree, spark, monkeypatch):
    real, seen = scan_plan._Run.hash, []

    def meanwhile(self, *args):
        if not seen:
            seen.append(None)
            with pytest.raises(Busy):
                scan(catalog, str(tree), DISK)
            edit = spark.createDataFrame([(1, 1, "edited", None)], "seq long, disk_id long, label string, description string")
            catalog.patch_disks(edit)
        return real(self, *args)

    monkeypatch.setattr(scan_plan._Run, "hash", meanwhile)
    assert scan(catalog, str(tree), DISK).files_scanned == 3
    assert catalog.scans().count() == 1 and catalog.files().count() == 3
    assert catalog.disks().first().label == "edited"


def test_edits_at_once_are_all_kept(catalog, tree, spark):
    scan(catalog, str(tree), DISK, mode="none")
    scan(catalog, str(tree), Volume("S-2"), mode="none")
    edits = [(1, 1, "a", None), (1, 1, None, "b"), (1, 2, "c", None), (1, 2, None, "d")]
    rows = [spark.createDataFrame([e], "seq long, disk_id long, label string, description string") for e in edits]
    at_once(*[lambda r=r: catalog.patch_disks(r) for r in rows])
    assert sorted((d.label, d.description) for d in catalog.disks().collect()) == [("a", "b"), ("c", "d")]


_DIES = """
import os, sys
sys.path.insert(0, sys.argv[1])
from shelfmark.plans import scan as plan
from shelfmark.session import local_session
from shelfmark.sources.catalog import Catalog
from shelfmark.sources.locks import Busy, Lock
plan._Run.settle = lambda self: os._exit(9)
plan.scan(Catalog(local_session("dies", "1", "1g"), sys.argv[2]), sys.argv[3], plan.Volume("S-1", "Shelf", "ext4", 1000))
"""


def test_crashed_scan_is_picked_up_by_another_process(catalog, tree, monkeypatch):
    top = str(Path(__file__).resolve().parents[1])
    died = subprocess.run([sys.executable, "-c", _DIES, top, catalog.root, str(tree)], timeout=300, capture_output=True)
    assert died.returncode == 9
    assert catalog.scans().first().status == "running" and catalog.files().count() == 0
    with pytest.raises(Busy):  # it might still be alive
        scan(catalog, str(tree), DISK)
    monkeypatch.setattr(Lock, "dead_after", 0.0)
    again = []
    hash_files = scan_plan.hash_files
    monkeypatch.setattr(scan_plan, "hash_files", lambda rows, policy: (again.extend(rows.collect()), hash_files(rows, policy))[1])
    with pytest.raises(Busy):  # the first try clears the dead owner's lock away
        scan(catalog, str(tree), DISK)
    assert scan(catalog, str(tree), DISK).files_scanned == 3 and again == []
    assert {r.scan_id: r.status for r in catalog.scans().collect()} == {1: "interrupted", 2: "completed"}


def test_lock_is_renewed_and_lost_when_taken(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Lock, "every", 0.2)
    monkeypatch.setattr(Lock, "dead_after", 1.0)
    path = str(tmp_path / "locks" / "x")
    with Lock(spark, path) as first:
        with pytest.raises(Busy), Lock(spark, path, wait=2.5):
            pass
        assert first.held()
        first._ended.set()  # as if it had died
        with Lock(spark, path, wait=5.0) as second:
            assert second.held() and not first.held()


def test_failed_entry_marks_the_scan(catalog, tree, monkeypatch):
    monkeypatch.setattr(Catalog, "replace_files", lambda *a: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError, match="full"):
        scan(catalog, str(tree), DISK)
    assert catalog.scans().first().status == "failed"


def test_a_portion_reads_its_own_folder(catalog, tree, monkeypatch):
    for n in range(20):
        (tree / f"more{n}").write_text("x" * 100)
    plans, real = [], scan_plan.spread_by_bytes
    monkeypatch.setattr(scan_plan, "spread_by_bytes", lambda rows, *a: (plans.append(rows.inputFiles()), real(rows, *a))[1])
    scan(catalog, str(tree), DISK, portion_bytes=1000)
    assert len(plans) > 2
    folders = [{f.rsplit("/", 2)[1] for f in files} for files in plans]
    assert all(len(f) == 1 for f in folders) and len(set().union(*folders)) == len(plans)


def test_errors_are_packed(catalog, tree):
    os.mkfifo(tree / "pipe")
    for _ in range(3):
        scan(catalog, str(tree), DISK, mode="full")
    before = sorted((r.scan_id, r.path) for r in catalog.errors().collect())
    assert [s for s, _ in before] == [1, 2, 3]
    catalog.pack_errors(folders=2)
    catalog.pack_errors(folders=2)
    assert not catalog.folders.matching(f"{catalog.root}/scan_errors/scan_id=*")
    assert sorted((r.scan_id, r.path) for r in catalog.errors().collect()) == before
    scan(catalog, str(tree), DISK)
    assert catalog.errors().count() == 4


@pytest.mark.parametrize("folders, files", [(5, 20_000), (100_000, 3)])
def test_source_shares_out_a_wide_folder(spark, odd, monkeypatch, folders, files):
    for n in range(30):
        (odd / f"w{n}").mkdir()
        (odd / f"w{n}" / "f").write_text("x")
    monkeypatch.setattr(filetree, "_MOST_FOLDERS", folders)
    monkeypatch.setattr(filetree, "_WIDE", files)
    reader = filetree._Reader(str(odd), 8)
    parts = reader.partitions()
    assert len([p for p in parts if p.folders == [str(odd)]]) > 2
    rows = [row for part in parts for row in reader._rows(part)]
    assert len(rows) == len({row[0] for row in rows}) == sum(map(len, walked(odd)))
    whole = list(reader._rows(filetree._Part([str(odd)], True)))
    assert sorted(map(str, whole)) == sorted(map(str, rows))


def test_source_takes_filters_over(spark, odd, monkeypatch):
    for n in range(4):
        (odd / "sub" / f"d{n}").mkdir()
        (odd / "sub" / f"d{n}" / f"f{n}.TXT").write_text("x" * n)
    filetree.register(spark)
    every = spark.read.format("filetree").load(str(odd))
    rows = every.collect()
    size, path = F.col("size_bytes"), F.col("path")
    for test in (
        path.startswith(f"{odd}/sub/d"),
        (size >= 2) & (F.col("extension") == ".txt"),
        F.col("filename").contains("a") & (size < 5),
        F.col("extension").isin(".txt", ".gz") & path.endswith("gz"),
        path == str(odd / "sub" / "d1" / "f1.TXT"),
        F.col("modified_date") > F.lit("2001-01-01").cast("timestamp"),
        F.col("error_message").isNull() & (F.upper("filename") == "F2.TXT"),
        (size > 1) | F.col("filename").startswith("f"),
        ~F.col("filename").startswith("f"),
    ):
        want = spark.createDataFrame(rows, every.schema).where(test).collect()
        assert sorted(map(str, every.where(test).collect())) == sorted(map(str, want))
    plan = plan_of(every.where(path.startswith(f"{odd}/sub/d1/") & (size > 3) & (F.col("extension") == ".txt")))
    assert "Filter (" not in plan  # nothing is left for Spark to test

    # only folders a wanted path can lie in are opened, and only files that may pass examined
    opened, examined = [], []
    real, look = filetree._entries, filetree._file_row
    monkeypatch.setattr(filetree, "_entries", lambda folder: (opened.append(os.path.relpath(folder, odd)), real(folder))[1])
    monkeypatch.setattr(filetree, "_file_row", lambda folder, name: (examined.append(name), look(folder, name))[1])
    reader = filetree._Reader(str(odd), 1)
    from pyspark.sql.datasource import EqualTo, Not, StringStartsWith

    given = [StringStartsWith(("path",), f"{odd}/sub/d1/"), EqualTo(("extension",), ".txt"), Not(EqualTo(("filename",), "x"))]
    assert list(reader.pushFilters(given)) == given[2:]
    got = [row for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]
    assert [r["filename"] for r in got] == examined == ["f1.TXT"]
    assert set(opened) == {".", "sub", "sub/d1"}


def test_source_of_names_alone_examines_nothing(spark, odd):
    filetree.register(spark)
    reader = filetree._Reader(str(odd), 4, ["filename", "path"])
    assert not reader.examine
    names = spark.read.format("filetree").schema("filename string, path string, error_message string").load(str(odd))
    good, failed = walked(odd)
    got = names.collect()
    # a link to nowhere is a name like others
    assert {r.path for r in got if r.error_message is None} == set(good) | {str(odd / "broken")}
    assert len(got) == len(good) + len(failed)


@pytest.mark.parametrize("stop,status", [(KeyboardInterrupt, "interrupted"), (RuntimeError, "failed")])
def test_stopped_scan_keeps_finished_portions(catalog, tree, monkeypatch, stop, status):
    for n in range(20):
        (tree / f"more{n}").write_text(f"{n}" * 100)
    real, calls = scan_plan.hash_files, []

    def stopping(rows, policy):
        calls.append(rows)
        if len(calls) == 3:
            raise stop()
        return real(rows, policy)

    monkeypatch.setattr(scan_plan, "hash_files", stopping)
    with pytest.raises(stop):
        scan(catalog, str(tree), DISK, portion_bytes=1000)
    first = catalog.scans().first()
    kept = {r.path: r.hash for r in catalog.files().collect()}
    assert first.status == status and first.files_scanned == len(kept)
    assert 0 < len(kept) < 23

    again = []
    monkeypatch.setattr(scan_plan, "hash_files", lambda rows, policy: (again.extend(r.path for r in rows.collect()), real(rows, policy))[1])
    assert scan(catalog, str(tree), DISK).files_scanned == 23
    assert len(again) == 23 - len(kept) and not set(again) & set(kept)


def test_crashed_scan_is_picked_up(catalog, tree, monkeypatch):
    real = scan_plan._Run.settle
    monkeypatch.setattr(scan_plan._Run, "settle", lambda self: (_ for _ in ()).throw(SystemExit()))
    with pytest.raises(SystemExit):
        scan(catalog, str(tree), DISK)
    monkeypatch.setattr(scan_plan._Run, "settle", real)
    assert catalog.scans().first().status == "running" and catalog.files().count() == 0
    again = []
    hash_files = scan_plan.hash_files
    monkeypatch.setattr(scan_plan, "hash_files", lambda rows, policy: (again.extend(rows.collect()), hash_files(rows, policy))[1])
    result = scan(catalog, str(tree), DISK)
    assert result.files_scanned == 3 and again == []
    assert {r.scan_id: r.status for r in catalog.scans().collect()} == {1: "interrupted", 2: "completed"}


# -- stored tables ------------------------------------------------------------


def test_unfinished_version_is_ignored(catalog, tree):
    scan(catalog, str(tree), DISK)
    half = f"{catalog.root}/files/disk_id=1/version=00000099"
    catalog.files().drop("disk_id").limit(1).write.parquet(half)
    os.remove(f"{half}/_SUCCESS")
    assert catalog.files().count() == 3


def test_old_versions_go(catalog, tree, monkeypatch):
    monkeypatch.setattr(cat, "_MOST_MARKS", 0)  # a new base at every scan
    for _ in range(3):
        scan(catalog, str(tree), DISK)
    assert len(catalog.folders.matching(f"{catalog.root}/files/disk_id=1/version=*")) == 2
    removed = catalog.drop_old_versions(keep=1)
    assert len([r for r in removed if "/files/" in r]) == 1
    assert catalog.files().count() == 3 and catalog.scans().count() == 3 and catalog.disks().count() == 1


def test_hash_lookup_has_a_bloom_filter(catalog, tree, spark):
    import pyarrow.parquet as pq

    scan(catalog, str(tree), DISK)
    stored = catalog.folders.matching(f"{catalog.root}/files/disk_id=1/version=*/part-*.parquet")
    assert stored and all(pq.ParquetFile(f.removeprefix("file:")).metadata.num_row_groups for f in stored)
    assert "PushedFilters: [IsNotNull(hash), EqualTo(hash,abc)]" in plan_of(search.files_for_hash(catalog.files(), "abc"))


def test_snapshots(catalog, tree, tmp_path, monkeypatch):
    scan(catalog, str(tree), DISK)
    target = str(tmp_path / "copies")
    made = cat.snapshot_if_needed(catalog, target, stamp="20240101_000000")
    assert made.endswith("snapshot=20240101_000000")
    assert catalog.spark.read.parquet(f"{made}/files").count() == 3
    assert cat.snapshot_if_needed(catalog, target, stamp="20240101_235959") is None
    assert cat.snapshot_now(catalog, target, stamp="20240101_235959")
    assert cat.snapshot_if_needed(catalog, target, stamp="20240102_000000")
    assert cat.snapshot_now(catalog, target, keep=2)
    left = sorted(f for f in os.listdir(target) if f[0] != "_")
    assert len(left) == 2 and left[0] == "snapshot=20240102_000000"


def test_newest_thirty_copies_stay(catalog, tmp_path):
    target = str(tmp_path / "copies")
    for n in range(35):
        folder = tmp_path / "copies" / f"snapshot=20240101_0000{n:02d}" / "files"
        folder.mkdir(parents=True)
        (folder / "_SUCCESS").touch()
    removed = cat.drop_old_snapshots(catalog, target)
    assert [r[-2:] for r in removed] == ["00", "01", "02", "03", "04"]
    assert len(catalog.folders.matching(f"{target}/snapshot=*")) == 30
    (tmp_path / "copies" / "snapshot=20240102_000000" / "disks").mkdir(parents=True)
    assert [r[-15:] for r in cat.drop_old_snapshots(catalog, target)] == ["20240102_000000"]
