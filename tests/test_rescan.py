import datetime as dt
import hashlib
import random

import pytest
from conftest import at, plan_of
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.operators import changes, disks, hashing, ledger
from shelfmark.operators.numbering import number_rows

def now():
    return F.lit("2024-07-01 00:00:00").cast("timestamp")


def later():
    return at("2024-07-01T00:00:00").replace(tzinfo=None)


# -- hashes -------------------------------------------------------------------


def test_bad_mode():
    with pytest.raises(ValueError):
        hashing.HashPolicy("quick")


def test_blake2b_of_columns(spark):
    rng = random.Random(2)
    contents = [b"", b"a", rng.randbytes(10), rng.randbytes(11), rng.randbytes(40), None]
    rows = spark.createDataFrame([(i, c, len(c or b"")) for i, c in enumerate(contents)], "i int, c binary, n long")

    def digests(policy):
        got = rows.select("i", hashing.blake2b_of(F.col("c"), F.col("n"), policy)).orderBy("i").collect()
        return [r[1] for r in got]

    def whole(c):
        return None if c is None else hashlib.blake2b(c).hexdigest()

    def sampled(c):
        tail = c[-4:] if len(c) > 4 else b""
        return hashlib.blake2b(len(c).to_bytes(8, "big") + c[:4] + tail).hexdigest()

    assert digests(hashing.HashPolicy("full", 10, 4)) == [whole(c) for c in contents]
    expected = [whole(c) if c is None or len(c) <= 10 else sampled(c) for c in contents]
    assert digests(hashing.HashPolicy("sampled", 10, 4)) == expected
    assert digests(hashing.HashPolicy("none")) == [None] * 6


@pytest.mark.parametrize("sizes", [[5] * 400, [1] * 200 + [900, 5000, 40], [0, 0, 0], [10_000]])
def test_tasks_are_even_in_bytes(spark, sizes):
    rows = spark.createDataFrame([(f"f{i}", n) for i, n in enumerate(sizes)], "path string, n long")
    dealt = hashing.spread_by_bytes(rows, F.col("n"), 100).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.path, r.n) for r in dealt) == sorted((f"f{i}", n) for i, n in enumerate(sizes))
    tasks = {}
    for r in dealt:
        tasks.setdefault(r.task, []).append(r.n)
    assert all(sum(t) <= 200 or len(t) == 1 for t in tasks.values())


def test_hash_files_by_path(spark, tmp_path):
    big, twin, other, small = (tmp_path / n for n in ("big", "twin", "other", "small"))
    head, tail = b"h" * 1024 * 1024, b"t" * 1024 * 1024
    for path, middle in ((big, b"1"), (twin, b"2")):
        with open(path, "wb") as f:
            f.write(head)
            f.seek(51 * 1024 * 1024)
            f.write(middle + tail)
    other.write_bytes(b"x" * 3_000_000)
    small.write_bytes(b"")
    paths = [big, twin, other, small]
    rows = [(str(p), p.stat().st_size) for p in paths] + [(str(tmp_path / "gone"), 5), (str(tmp_path), 5)]
    listed = spark.createDataFrame(rows, "path string, size_bytes long")

    def run(mode):
        got = hashing.hash_files(listed, hashing.HashPolicy(mode)).collect()
        return {r.path: (r.hash, r.hash_algo, r.error_message) for r in got}

    full = run("full")
    for p in paths:
        assert full[str(p)] == (hashlib.blake2b(p.read_bytes()).hexdigest(), "blake2b", None)
    assert full[str(big)] != full[str(twin)]
    sampled = run("sampled")
    size = big.stat().st_size.to_bytes(8, "big")
    assert sampled[str(big)] == (hashlib.blake2b(size + head + tail).hexdigest(), "blake2b-sampled", None)
    assert sampled[str(big)] == sampled[str(twin)]
    assert sampled[str(other)] == full[str(other)]
    gone = sampled[str(tmp_path / "gone")]
    assert gone[:2] == (None, None) and "gone" in gone[2]
    assert "not a regular file" in sampled[str(tmp_path)][2]
    assert set(run("none").values()) == {(None, None, None)}


# -- changes ------------------------------------------------------------------


def test_change_kinds_and_kept_hashes(make_files):
    catalog = make_files((1, "same", 5, "h1"), (1, "grown", 5, "h2"), (1, "touched", 5, "h3"), (1, "gone", 5, "h4"), (2, "new", 5, "h5"), (1, "unhashed", 5, None))
    listing = make_files(
        (1, "same", 5, None), (1, "grown", 6, None), (1, "new", 5, None), (1, "unhashed", 5, None),
        {"disk_id": 1, "path": "touched", "size_bytes": 5, "modified_date": at("2024-05-02T00:00:00")},
    )
    got = changes.reuse_hashes(listing, catalog, lambda c: F.lit("fresh"), F.lit("algo"), "path").collect()
    assert {r.path: (r.change_kind, r.hash) for r in got} == {
        "same": ("unchanged", "h1"), "grown": ("changed", "fresh"), "touched": ("changed", "fresh"),
        "new": ("new", "fresh"), "unhashed": ("unchanged", None),
    }


def test_match_listing_holds_both_sides(make_files):
    catalog = make_files((1, "same", 5, "h1"), (1, "grown", 5, "h2"), (1, "gone", 5, "h4"))
    listing = make_files((1, "same", 5, None), (1, "grown", 6, None), (1, "new", 7, None)).drop("hash", "hash_algo")
    got = changes.match_listing(listing, catalog).collect()
    assert {(r.path, r.change_kind, r.size_bytes, r.old and r.old.hash) for r in got} == {
        ("same", "unchanged", 5, "h1"), ("grown", "changed", 6, "h2"), ("new", "new", 7, None), ("gone", "unseen", None, "h4"),
    }


def test_unchanged_rows_are_never_hashed(make_files):
    catalog = make_files((1, "same", 5, "h1"))
    def bomb(content):
        return F.raise_error(F.concat(F.lit("hashed "), content)).cast("string")

    kept = changes.reuse_hashes(make_files((1, "same", 5, None)), catalog, bomb, F.lit("a"), "path")
    assert kept.first()["hash"] == "h1"


def test_python_digests_see_changed_rows_only(spark, make_files):
    catalog = make_files(*[(1, f"p{n}", 5, "kept") for n in range(50)])
    listing = make_files(*[(1, f"p{n}", 5 + (n < 3), None) for n in range(52)])
    seen = spark.sparkContext.accumulator(0)

    def count(content):
        seen.add(sum(c is not None for c in content.to_pylist()))
        return content

    def digest(content):
        counted = F.arrow_udf(count, "binary").asNondeterministic()
        return hashing.blake2b_of(counted(content), F.col("size_bytes"), hashing.HashPolicy("full"))

    rows = changes.reuse_hashes(listing.withColumn("content", F.encode("path", "UTF-8")), catalog, digest, F.lit("blake2b"))
    got = {r.path: r.hash for r in rows.collect()}
    assert seen.value == 5
    assert got["p7"] == "kept" and got["p51"] == hashlib.blake2b(b"p51").hexdigest()


def test_upsert(make_files):
    catalog = make_files((1, "a", 1, "old"), (1, "b", 2, "old"), (2, "a", 3, "old"))
    incoming = make_files(
        {"disk_id": 1, "path": "a", "size_bytes": 9, "hash": None, "scan_id": 2},
        {"disk_id": 2, "path": "c", "size_bytes": 4, "hash": "new", "scan_id": 2},
    )
    got = {(r.disk_id, r.path): (r.size_bytes, r.hash, r.scan_id) for r in changes.upsert_files(catalog, incoming).collect()}
    assert got == {(1, "a"): (9, None, 2), (1, "b"): (2, "old", 1), (2, "a"): (3, "old", 1), (2, "c"): (4, "new", 2)}
    assert changes.upsert_files(catalog, incoming).schema.names == schemas.FILES.names


def test_upsert_of_repeated_keys(make_files):
    catalog = make_files((1, "a", 1, "old"), (1, "b", 2, "old"))
    last = {"disk_id": 1, "path": "a", "size_bytes": 7, "last_seen": at("2024-06-02T00:00:00")}
    incoming = make_files({**last, "size_bytes": 3, "last_seen": at("2024-06-01T00:00:00")}, last, last, {"disk_id": 1, "path": "c"}, {"disk_id": 1, "path": "c"})
    got = sorted((r.path, r.size_bytes) for r in changes.upsert_files(catalog, incoming).collect())
    assert got == [("a", 7), ("b", 2), ("c", 0)]


def test_last_row_wins(spark):
    rng = random.Random(4)
    rows = [(0 if n % 3 else rng.randrange(20), rng.choice([None, *range(50)]), n) for n in range(500)]
    df = spark.createDataFrame(rows, "k int, o int, n int").repartition(7)
    got = {r.k: r.n for r in changes.last_row_wins(df, ["k"], [F.col("o"), F.col("n")]).collect()}
    best = {}
    for k, o, n in rows:
        best[k] = max(best.get(k, (-2, -1)), (-1 if o is None else o, n))
    assert got == {k: n for k, (_, n) in best.items()}


def test_last_row_wins_reduces_before_the_shuffle(make_files, tmp_path):
    make_files((1, "a", 1, None)).write.parquet(str(tmp_path / "f"))
    stored = make_files((1, "a", 1, None)).sparkSession.read.parquet(str(tmp_path / "f"))
    plan = plan_of(changes.last_row_wins(stored, schemas.FILE_KEY, [F.col("last_seen")]))
    tree = plan.split("\n\n")[0]
    exchange = tree.index("Exchange")
    assert tree.count("WindowGroupLimit") == 2 and tree.index("WindowGroupLimit") < exchange < tree.rindex("WindowGroupLimit")


def test_keys_of_different_integer_types_meet(make_files):
    files = make_files((1, "a", 1, "h"))
    narrow = files.withColumn("disk_id", F.col("disk_id").cast("int"))
    assert changes.classify_changes(narrow, files).first()["change_kind"] == "unchanged"
    assert changes.upsert_files(files, narrow).count() == 1


# -- disks and scans ----------------------------------------------------------


def test_number_rows_is_dense_and_ordered(spark):
    keys = [f"k{n}" for n in range(3000)]
    got = number_rows(spark.createDataFrame([(k,) for k in keys], "k string"), "k", F.lit(10), "n").collect()
    order = sorted(keys, key=lambda k: (hashlib.md5(k.encode()).hexdigest(), k))
    assert {r.k: r.n for r in got} == {k: 11 + n for n, k in enumerate(order)}


def test_disk_upsert_keeps_what_people_set(spark, make_disks):
    known = make_disks({"disk_id": 4, "volume_serial": "S4", "label": "mine", "description": "d", "filesystem": "NTFS", "total_bytes": 1})
    met = spark.createDataFrame(
        [("S4", "theirs", None, 9), ("S9", "new", "exFAT", 5), ("S9", "new", "exFAT", 5)],
        "volume_serial string, label string, filesystem string, total_bytes long",
    )
    got = {r.volume_serial: r for r in disks.upsert_disks(known, met, now()).collect()}
    assert len(got) == 2
    old, new = got["S4"], got["S9"]
    assert (old.disk_id, old.label, old.description, old.filesystem, old.total_bytes) == (4, "mine", "d", None, 9)
    assert old.first_seen == at().replace(tzinfo=None) and old.last_scanned == later()
    assert (new.disk_id, new.label, new.description, new.first_seen) == (5, "new", None, later())
    empty = known.where("false")
    assert sorted(r.disk_id for r in disks.upsert_disks(empty, met, now()).collect()) == [1, 2]


def test_patches_in_order(spark, make_disks):
    known = make_disks(*[{"disk_id": n, "volume_serial": f"S{n}", "label": f"l{n}", "description": f"d{n}"} for n in range(1, 5)])
    edits = spark.createDataFrame(
        [(1, 1, "\u00a0 x\t", None), (2, 2, None, " y "), (3, 3, "", ""), (4, 1, None, "z"), (5, 1, "last", None), (6, 99, "q", None)],
        "seq long, disk_id long, label string, description string",
    )
    got = {r.disk_id: (r.label, r.description) for r in disks.patch_disks(known, edits).collect()}
    assert got == {1: ("last", "z"), 2: ("l2", "y"), 3: ("", ""), 4: ("l4", "d4")}
    assert [r.disk_id for r in disks.unknown_patches(known, edits).collect()] == [99]


def test_v1_disks_read_as_v2(spark, make_disks, tmp_path):
    v1 = make_disks({"disk_id": 1, "volume_serial": "S", "label": "kept"}).drop("description")
    v1.write.parquet(str(tmp_path / "disks"))
    row = disks.read_disks(spark.read.parquet(str(tmp_path / "disks"))).first()
    assert (row.label, row.description) == ("kept", None)


@pytest.fixture
def scans(spark):
    rows = [
        (1, 1, "r", at(), at(), "completed", 3, 0), (2, 1, "r", at(), None, "running", 0, 0),
        (3, 2, "r", at(), None, "running", 0, 0), (4, 1, "r", at(), at(), "failed", 1, 1),
    ]
    return spark.createDataFrame(rows, schemas.SCANS)


def test_ledger(spark, scans):
    closed = ledger.close_stale(scans, 1, now())
    got = {r.scan_id: (r.status, r.finished_at) for r in closed.collect()}
    assert got[2] == ("interrupted", later()) and got[3] == ("running", None)
    assert got[1][0] == "completed" and got[4][0] == "failed"
    both = ledger.close_stale_disks(scans, spark.createDataFrame([(1,), (2,), (2,)], "disk_id long"), now())
    assert sorted((r.scan_id, r.status) for r in both.collect()) == [(1, "completed"), (2, "interrupted"), (3, "interrupted"), (4, "failed")]
    opened = ledger.open_scan(closed, 5, 1, "root", now())
    row = opened.where("scan_id = 5").first()
    assert (row.status, row.finished_at, row.files_scanned, row.started_at) == ("running", None, 0, later())
    done = ledger.finish_scan(opened, 5, 7, 2, now()).where("scan_id = 5").first()
    assert (done.status, done.files_scanned, done.files_failed, done.finished_at) == ("completed", 7, 2, later())


def test_scan_counts(spark, make_files):
    errors = spark.createDataFrame([(1, "p", "e", at()), (8, None, "e", at())], schemas.SCAN_ERRORS)
    got = ledger.scan_counts(make_files((1, "a", 1, None), (1, "b", 1, None)), errors)
    assert {tuple(r) for r in got.collect()} == {(1, 2, 1), (8, 0, 1)}
