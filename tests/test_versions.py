"""Changes, marks, manifests and what is kept beside the files of a stored catalog."""

import datetime as dt
import os
import random
import threading

import pytest
from conftest import at, plan_of
from pyspark.sql import functions as F

from shelfmark.operators import by_need, duplicates, folders, intervals, maintained, name_index, search, zones
from shelfmark.operators.filters import SearchFilters
from shelfmark.plans.scan import Volume, scan
from shelfmark.schemas import FILES
from shelfmark.sources import catalog as cat
from shelfmark.sources import copies, manifests, pages
from shelfmark.sources.catalog import Catalog, Seen
from shelfmark.sources.locks import Busy

DISK = Volume("S-1", "Shelf", "ext4", 1000)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for folder in ("a", "b/deep", "c"):
        (root / folder).mkdir(parents=True)
        for n in range(4):
            (root / folder / f"f{n}.txt").write_text(f"{folder} {n % 2}")
    return root


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "catalog"))


def rows_of(files):
    return {tuple(r) for r in files.select(*FILES.fieldNames()).collect()}


def written(catalog):
    return catalog.folders.matching(f"{catalog.root}/files/disk_id=*/version=*")


def moment(n):
    return dt.datetime(2024, 5, n, tzinfo=dt.timezone.utc)


# -- changes and marks --------------------------------------------------------


def test_changes_give_what_full_rewrites_give(spark, tree, tmp_path, monkeypatch):
    lean, full = Catalog(spark, str(tmp_path / "lean")), Catalog(spark, str(tmp_path / "full"))
    monkeypatch.setattr(cat, "_CHANGED_SHARE", 10.0)

    def step(n, root):
        monkeypatch.setattr(cat, "_MOST_MARKS", 16)
        one = scan(lean, str(root), DISK, now=moment(n))
        monkeypatch.setattr(cat, "_MOST_MARKS", 0)  # a new base each time
        two = scan(full, str(root), DISK, now=moment(n))
        assert (one.files_scanned, one.files_failed) == (two.files_scanned, two.files_failed)
        assert rows_of(lean.files()) == rows_of(full.files())
        return {r.path.removeprefix(f"{tree}/"): r for r in lean.files().collect()}

    step(1, tree)
    lean.keep_totals(1, "/")
    (tree / "a" / "f0.txt").write_text("longer than before")
    (tree / "a" / "f1.txt").unlink()
    (tree / "new.bin").write_text("b/deep 1")
    (tree / "c" / "f2.txt").unlink()
    os.mkfifo(tree / "c" / "f2.txt")  # listed, but not hashed: its row stays
    rows = step(2, tree)
    assert rows["a/f1.txt"].scan_id == rows["c/f2.txt"].scan_id == 1 and rows["b/deep/f0.txt"].scan_id == 2
    assert len(written(lean)) == 2
    second = lean.manifests.newest()["disks"]["1"]
    assert second["changes"][0]["rows"] == 4  # two hashed, two frozen

    rows = step(3, tree / "b")  # a part of the disk
    assert {p: r.scan_id for p, r in rows.items()}["b/deep/f3.txt"] == 3 and rows["new.bin"].scan_id == 2
    assert len(written(lean)) == 2  # nothing changed there: a mark only
    (tree / "a" / "f1.txt").write_text("a 1")  # back again
    os.unlink(tree / "c" / "f2.txt")
    (tree / "b" / "deep" / "f0.txt").rename(tree / "moved")
    rows = step(4, tree)
    assert rows["a/f1.txt"].scan_id == 4 and rows["b/deep/f0.txt"].scan_id == 3 and rows["c/f2.txt"].scan_id == 1
    marks = lean.manifests.newest()["disks"]["1"]["marks"]
    assert [m["version"] for m in marks] == [4]  # earlier marks lay below the last one's root

    # totals kept by four scans are those of the table
    def plain(rows):
        return sorted(map(tuple, rows.collect()))

    assert plain(lean.folder_totals()) == plain(folders.folder_rollup(lean.files(), "/"))
    kept = lean.hash_counts().where("copies > 1")
    assert plain(kept) == plain(duplicates.find_duplicates(lean.files(), None))
    assert len(lean.manifests.newest()["disks"]["1"]["totals"]["rollup"]) == 4


def test_a_part_of_a_disk_is_read_and_written_in_part(spark, catalog, make_files, monkeypatch):
    monkeypatch.setattr(cat, "_PART_ROWS", 10)
    rows = make_files(*[(1, f"/d{n // 10}/f{n:03d}", n, f"h{n}") for n in range(100)], sep="/")
    catalog.replace_files(1, 1, rows, 100)
    bounds = catalog.manifests.newest()["disks"]["1"]["base"]["files"]
    assert len(bounds) > 5 and sum(f["rows"] for f in bounds) == 100
    assert all(a["high"] < b["low"] for a, b in zip(bounds, bounds[1:]))
    changed = make_files((1, "/d3/f031", 999, "other"), (1, "/d3/x", 5, None), sep="/").withColumn("frozen", F.lit(False))
    catalog.add_changes(1, changed, Seen(2, "/d3/", moment(2)))
    state = {1: catalog.manifests.newest()["disks"]["1"]}
    apart, near = catalog._by_range(state)
    assert len(near) <= 2 and len(apart) + len(near) == len(bounds)
    got = {r.path: r for r in catalog.files().collect()}
    assert len(got) == 101 and got["/d3/f031"].size_bytes == 999
    assert got["/d3/f032"].scan_id == 2 and got["/d3/f032"].last_seen == moment(2).replace(tzinfo=None)
    assert got["/d4/f040"].scan_id == 1
    # what a scan of /d3 reads of the disk
    plan = plan_of(catalog.stored_files(1).where(F.startswith("path", F.lit("/d3/"))))
    assert plan.count("StringStartsWith(path,/d3/)") >= 2


def test_many_changes_become_a_base(catalog, make_files, monkeypatch):
    monkeypatch.setattr(cat, "_MOST_CHANGES", 2)
    catalog.replace_files(1, 1, make_files(*[(1, f"/f{n}", n, None) for n in range(20)], sep="/"), 20)
    for version in (2, 3, 4):
        row = make_files((1, f"/f{version}", 1000 + version, None), sep="/").withColumn("frozen", F.lit(version == 3))
        catalog.add_changes(1, row, Seen(version, "/", moment(version)))
        catalog.add_changes(1, row, Seen(version, "/", moment(version)))  # again, as after a crash
    state = catalog.manifests.newest()["disks"]["1"]
    assert state["changes"] == state["marks"] == [] and state["base"]["rows"] == 20
    got = {r.path: (r.size_bytes, r.scan_id) for r in catalog.files().collect()}
    assert got["/f2"] == (1002, 4) and got["/f3"] == (1003, 1) and got["/f4"] == (1004, 1) and got["/f9"] == (9, 4)
    removed = catalog.drop_old_versions(keep=1)
    assert len(removed) == 3 and catalog.files().count() == 20


# -- manifests ----------------------------------------------------------------


def test_a_writer_that_lost_its_disk_cannot_enter(catalog, make_files):
    rows = make_files((1, "/a", 1, None), sep="/")
    mine = catalog.take_over(1)
    catalog.replace_files(1, 1, rows, 1, mine)
    theirs = catalog.take_over(1)
    late = make_files((1, "/late", 1, None), sep="/").withColumn("frozen", F.lit(False))
    with pytest.raises(Busy):
        catalog.replace_files(1, 2, late, 1, mine)
    with pytest.raises(Busy):
        catalog.add_changes(1, late, Seen(2, "/", moment(2)), mine)
    assert [r.path for r in catalog.files().collect()] == ["/a"]
    catalog.add_changes(1, late, Seen(3, "/", moment(3)), theirs)
    assert catalog.files().count() == 2


def test_commits_at_once_are_all_kept(spark, tmp_path):
    log = manifests.Manifests(spark, str(tmp_path / "log"))
    threads = [threading.Thread(target=lambda d=d: [log.raise_fence(d) for _ in range(6)]) for d in range(4)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    newest = log.newest()
    assert newest["fences"] == {str(d): 6 for d in range(4)} and newest["number"] == 24
    assert len(log.numbers()) == manifests.KEEP and not [n for n in os.listdir(tmp_path / "log") if ".json" not in n]


# -- copies -------------------------------------------------------------------


def test_copies_share_what_has_not_changed(spark, catalog, make_files, tmp_path, monkeypatch):
    target = str(tmp_path / "copies")
    catalog.replace_files(1, 1, make_files(*[(1, f"/f{n}", n, f"h{n % 3}") for n in range(20)], sep="/"), 20)
    catalog.replace_files(2, 1, make_files((2, "/z", 1, None), sep="/"), 1)
    catalog.keep_totals(1, "/")

    def folders_():
        return {f.removeprefix("file:") for f in catalog.folders.matching(f"{target}/files/*/*/*")}

    states = {}
    copies.copy_shared(catalog, target, stamp="20240101_000000")
    states["20240101_000000"], one = rows_of(catalog.files()), folders_()
    assert len(one) == 2
    copies.copy_shared(catalog, target, stamp="20240102_000000")
    states["20240102_000000"] = rows_of(catalog.files())
    assert folders_() == one  # nothing had changed: no row of a file was written
    row = make_files((1, "/f3", 99, "h"), sep="/").withColumn("frozen", F.lit(False))
    catalog.add_changes(1, row, Seen(2, "/", moment(2)))
    copies.copy_shared(catalog, target, stamp="20240103_000000")
    states["20240103_000000"] = rows_of(catalog.files())
    assert len(folders_()) == 3
    monkeypatch.setattr(cat, "_MOST_MARKS", 0)
    catalog.add_changes(1, row, Seen(3, "/", moment(3)))  # a new base
    copies.copy_shared(catalog, target, stamp="20240104_000000")
    states["20240104_000000"] = rows_of(catalog.files())
    catalog.drop_old_versions(keep=1)

    def check(stamps):
        assert copies.copies(spark, target) == stamps
        for stamp in stamps:
            assert rows_of(copies.files_of_copy(spark, target, stamp)) == states[stamp]

    check(sorted(states))
    (tmp_path / "copies" / "copies" / "20240105_000000").mkdir()  # one that was never finished
    assert copies.drop_old_copies(catalog, target, keep=2) == ["20240101_000000", "20240102_000000", "20240105_000000"]
    check(sorted(states)[2:])  # the oldest base is still named by the third copy
    copies.drop_old_copies(catalog, target, keep=1)
    check(sorted(states)[3:])
    assert len(folders_()) == 2


# -- searches of a stored catalog ---------------------------------------------


@pytest.fixture
def stored(spark, catalog, make_files, monkeypatch):
    monkeypatch.setattr(cat, "_PART_ROWS", 25)
    rng = random.Random(4)
    for disk in (1, 2):
        rows = []
        for n in range(200):
            time = at() + dt.timedelta(hours=n // 25 * 10 + rng.randrange(12))
            rows.append({"disk_id": disk, "path": f"/d{n // 25}/{'Foto' if n % 50 < 3 else 'x'}_{n}.jpg", "size_bytes": n, "modified_date": time})
        catalog.replace_files(disk, 1, make_files(*rows, sep="/"), 200)
    new = {"disk_id": 2, "path": "/d0/late Foto.jpg", "size_bytes": 1, "modified_date": at("2030-01-01T00:00:00")}
    catalog.add_changes(2, make_files(new, sep="/").withColumn("frozen", F.lit(False)), Seen(2, "/", moment(20)))
    return catalog


def test_pages_are_those_of_a_full_search(stored):
    everything = stored.files().cache()
    whole = [tuple(r) for r in search.search_files(everything, SearchFilters(limit=None)).collect()]
    key, got = None, []
    while True:
        page = pages.search_stored(stored, SearchFilters(limit=60), key)
        rows = page.collect()
        if not got:
            assert len(page.inputFiles()) < 10  # of sixteen and one
        if not rows:
            break
        got += [tuple(r) for r in rows]
        key = (rows[-1].modified_date, rows[-1].path, rows[-1].disk_id)
    assert got == whole and len(got) == 401
    for filters in (
        SearchFilters(min_size=170, limit=7),
        SearchFilters(max_size=5, disk_id=2, limit=None),
        SearchFilters(modified_after="2024-05-02", modified_before="2024-05-03T01:00:00", limit=500),
        SearchFilters(name="foto", limit=4),
        SearchFilters(scan_id=2, limit=5),
        SearchFilters(limit=0),
    ):
        want = [tuple(r) for r in search.search_files(everything, filters).collect()]
        assert [tuple(r) for r in pages.search_stored(stored, filters).collect()] == want
    everything.unpersist()


def test_name_index_opens_blocks_that_can_hold_a_hit(stored):
    stored.index_names(1)
    stored.index_names(2)
    for text in ("FOTO_", "foto_1", "oto", "o%o", "fo", "late", "none at all", "_100.jpg"):
        filters = SearchFilters(name=text, limit=None)
        page = pages.search_stored(stored, filters)
        assert sorted(map(tuple, page.collect())) == sorted(map(tuple, search.search_files(stored.files(), filters).collect()))
    assert len(pages.search_stored(stored, SearchFilters(name="Foto", limit=None)).inputFiles()) <= 9
    assert len(pages.search_stored(stored, SearchFilters(name="zzz", limit=None)).inputFiles()) <= 1


# -- operators on tables ------------------------------------------------------


def test_name_index_tables(make_files):
    names = ["invoice.pdf", "INVOICE", "in", "", "Ünvoice", "voice%", "a_b_c"]
    files = make_files(*[(1, f"/{n % 3}/{name}", 1, None) for n, name in enumerate(names)], sep="/").withColumn("block", F.col("path"))
    index = name_index.postings(files, "block")
    for text in ("voice", "VOI", "ü", "Ünv", "in", "%", "_b_", "pdf", "", "ICE.P"):
        got = name_index.search_by_index(files, index, "block", text).count()
        assert got == search.search_files(files, SearchFilters(name=text or "%", limit=None)).count()


def test_zone_pages_with_missing_times(make_files):
    rng = random.Random(1)
    rows = [{"disk_id": 1, "path": f"/{n:03d}", "modified_date": None if n % 7 == 0 else at() + dt.timedelta(hours=rng.randrange(30))} for n in range(90)]
    files = make_files(*rows, sep="/").withColumn("zone", F.substring("path", 2, 2))
    bounds = zones.zone_bounds(files, "zone")
    whole = [r.path for r in files.orderBy(*zones.newest_first()).collect()]
    for limit in (1, 10, 77, 90, 200):
        assert [r.path for r in zones.newest_page(files, bounds, "zone", limit).collect()] == whole[:limit]
    first = zones.newest_page(files, bounds, "zone", 20).collect()[-1]
    key = (F.lit(first.modified_date.replace(tzinfo=dt.timezone.utc).isoformat()).cast("timestamp"), first.path, 1)
    assert [r.path for r in zones.newest_page(files, bounds, "zone", 20, key).collect()] == whole[20:40]


def test_intervals_of_odd_folders(make_files):
    paths = ["a/x", "a b/x", "a/b/c/x", "a/b/y", "a!/x", "top", "//a//b/z", "ab/x", "a/b\U0001f600/x", "z/z/z/z"]
    files = make_files(*[(1 + n % 2, p, n, None) for n, p in enumerate(paths * 2)], sep="/")
    found = intervals.folder_intervals(files, "/")
    want = {(r.disk_id, r.folder): (r.file_count, r.total_bytes) for r in folders.folder_rollup(files, "/").collect()}
    rows = found.collect()
    assert {(r.disk_id, r.folder): (r.file_count, r.total_bytes) for r in rows} == want
    assert sorted(r.first for r in rows) == list(range(1, len(rows) + 1))
    numbered = intervals.numbered_files(files, found, "/")
    for r in rows:
        below = {s.folder for s in rows if s.disk_id == r.disk_id and r.first <= s.first <= r.last}
        assert below == {f for d, f in want if d == r.disk_id and f"{f}/".startswith(f"{r.folder}/")}
    got = intervals.below(numbered, found, 1, "a").count()
    assert got == folders.descendants(files, 1, "a", "/").count()
    assert intervals.folder_intervals(files.limit(0), "/").count() == 0


def test_intervals_of_more_bytes_than_a_long(make_files):
    files = make_files((1, "a/x", 2**62, None), (1, "a/b/y", 2**62, None), (2, "a/z", 2**62, None), (2, "c/z", 0, None), sep="/")
    got = {(r.disk_id, r.folder): tuple(r)[2:] for r in intervals.folder_intervals(files, "/").collect()}
    assert got == {(1, "a"): (1, 2, 2, 2**63), (1, "a/b"): (2, 2, 1, 2**62), (2, "a"): (3, 3, 1, 2**62), (2, "c"): (4, 4, 1, 0)}


def test_signed_sums_after_moves_of_a_hot_hash(make_files):
    before = make_files(*[(1, f"/old/{n}", 5, "hot" if n % 3 == 0 else f"h{n}") for n in range(30)], sep="/")
    after = make_files(*[(1, f"/new/{n}", 5, "hot" if n % 3 else f"h{n}") for n in range(1, 31)], (1, "/new/none", None or 0, None), sep="/")
    changes = maintained.signed(after, 1).unionByName(maintained.signed(before, -1))
    state = maintained.hash_changes(maintained.signed(before, 1))
    more = maintained.hash_changes(changes)
    kept = maintained.add_up_hashes(state.unionByName(more)).where("copies > 1")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, duplicates.find_duplicates(after, None).collect()))
    assert {tuple(r) for r in maintained.group_changes(state, more).collect()} == {("hot", "grew", 10, 20)}
    stored = folders.folder_rollup(before, "/").unionByName(maintained.rollup_changes(changes, "/"))
    assert sorted(map(tuple, maintained.add_up_rollup(stored).collect())) == sorted(map(tuple, folders.folder_rollup(after, "/").collect()))


def test_equal_files_read_no_more_than_needed(spark, tmp_path):
    contents = {"one": b"a" * 9000, "two": b"a" * 9000, "ends": b"a" * 4000 + b"b" + b"a" * 4999, "head": b"b" * 9000, "size": b"c" * 12, "e1": b"", "e2": b""}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    rows = [(str(tmp_path / n), len(c)) for n, c in contents.items()] + [(str(tmp_path / "gone"), 9000)]
    files = spark.createDataFrame(rows, "path string, size_bytes long")
    got = by_need.equal_files(files, sample=1000).collect()
    assert sorted(os.path.basename(r.path) for r in got) == ["e1", "e2", "one", "two"]
    assert len({r.hash for r in got}) == 2
    assert by_need.equal_files(files.limit(0)).count() == 0
