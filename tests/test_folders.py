import random

import pytest
from conftest import plan_of

from shelfmark.operators import folders

TREE = [
    (1, r"C:\data\photos\a.jpg", 10, "h"),
    (1, r"C:\data\photos\Old\b.jpg", 20, None),
    (1, r"C:\data\music\c.mp3", 5, None),
    (1, r"C:\data\readme.txt", 1, None),
    (2, r"C:\other\x.bin", 9, None),
]


def split(path, sep="\\"):
    return [p for p in path.split(sep) if p]


def one_level(paths, head):
    """Folders and files right below a list of segments, by brute force."""
    inside, direct = {}, []
    for path, size in paths:
        parts = split(path)
        if parts[: len(head)] != head or len(parts) <= len(head):
            continue
        if len(parts) == len(head) + 1:
            direct.append(parts[-1])
        else:
            n, b = inside.get(parts[len(head)], (0, 0))
            inside[parts[len(head)]] = (n + 1, b + size)
    return inside, sorted(direct)


def descend(paths):
    head = []
    while True:
        inside, direct = one_level(paths, head)
        if len(inside) != 1 or direct:
            return head
        head = head + list(inside)


def shown(result):
    got = {r["name"]: (r["file_count"], r["total_bytes"]) for r in result.folders.collect()}
    return got, sorted(r["name"] for r in result.files.collect())


def test_root_starts_at_first_branching(make_files):
    result = folders.browse(make_files(*TREE), 1)
    assert tuple(result.location.first()) == (1, r"C:\data", "C:")
    assert [r["name"] for r in result.folders.collect()] == ["music", "photos"]
    assert [(r["path"], r["size_human"]) for r in result.folders.collect()] == [
        (r"C:\data\music", "5 B"), (r"C:\data\photos", "30 B"),
    ]
    row = result.files.first()
    assert (row["name"], row["path"], row["category"]) == ("readme.txt", r"C:\data\readme.txt", "Document")


def test_chosen_folder_is_not_descended(make_files):
    files = make_files(*TREE)
    result = folders.browse(files, 1, "C:")
    assert tuple(result.location.first()) == (1, "C:", None)
    assert [r["name"] for r in result.folders.collect()] == ["data"]
    result = folders.browse(files, 1, r"c:\DATA\Photos")
    assert shown(result) == ({"Old": (1, 20)}, ["a.jpg"])
    assert result.location.first()["parent_path"] == r"c:\DATA"
    assert shown(folders.browse(files, 1, "")) == ({"C:": (4, 36)}, [])


def test_disk_without_files(make_files):
    result = folders.browse(make_files(*TREE), 7)
    assert tuple(result.location.first()) == (7, "", None)
    assert shown(result) == ({}, [])


def test_names_sorted_without_case_but_grouped_with_it(make_files):
    files = make_files((1, r"C:\b\1", 1, None), (1, r"C:\B\2", 1, None), (1, r"C:\a\3", 1, None), (1, r"C:\C\4", 1, None))
    assert [r["name"] for r in folders.browse_folders(files, 1, "C:").collect()] == ["a", "B", "b", "C"]


@pytest.mark.parametrize("seed", range(6))
def test_random_trees(make_files, seed):
    rng = random.Random(seed)
    start = ["\\\\srv", "C:", "\\\\srv\\one"][seed % 3]
    depth = rng.randint(0, 3)
    stem = start + "".join("\\" + rng.choice("pq") for _ in range(depth))
    paths = {}
    for n in range(rng.choice([1, 2, 30])):
        path = stem + "".join("\\" + rng.choice(["x", "x y", "x!", "z"]) for _ in range(rng.randint(0, 3))) + f"\\f{n}"
        paths[path] = rng.randrange(100)
    files = make_files(*[(1, p, s, None) for p, s in paths.items()], (2, "Q:\\z\\f", 1, None))
    head = descend(paths.items())
    result = folders.browse(files, 1)
    assert result.location.first()["current_path"] == "\\".join(head)
    assert shown(result) == one_level(paths.items(), head)
    for r in result.folders.collect():
        below = folders.browse(files, 1, r["path"])
        assert shown(below) == one_level(paths.items(), split(r["path"]))


@pytest.mark.parametrize("sep", ["\\", "/"])
def test_rollup_covers_every_folder(make_files, sep):
    rng = random.Random(5)
    rows = [(1 + n % 2, sep + sep.join(rng.choice("abc") for _ in range(rng.randint(0, 4))) + f"{sep}f{n}", n, None) for n in range(200)]
    expected = {}
    for disk, path, size, _ in rows:
        parts = split(path, sep)
        for n in range(1, len(parts)):
            key = (disk, sep.join(parts[:n]))
            count, total = expected.get(key, (0, 0))
            expected[key] = (count + 1, total + size)
    got = folders.folder_rollup(make_files(*rows, sep=sep), sep).collect()
    assert {(r.disk_id, r.folder): (r.file_count, r.total_bytes) for r in got} == expected


def test_prefix_range_reaches_the_scan(make_files, tmp_path):
    make_files(*TREE).write.parquet(str(tmp_path / "f"))
    stored = make_files(*TREE).sparkSession.read.parquet(str(tmp_path / "f"))
    plan = plan_of(folders.browse_folders(stored, 1, r"c:\Data"))
    assert "GreaterThanOrEqual(path,C:\\DATA\\)" in plan and "LessThan(path,c:\\data])" in plan
    assert shown(folders.browse(stored, 1, r"c:\Data"))[1] == ["readme.txt"]


# more bytes than a long holds
HUGE = [(1, r"C:\data\a\x", 2**62, None), (1, r"C:\data\a\y", 2**62, None), (1, r"C:\data\b\z", 2**62 + 1, None), (2, r"C:\q\w", 5, None)]


def test_browsed_folders_of_more_bytes_than_a_long(make_files):
    got = folders.browse_folders(make_files(*HUGE), 1, "C:").collect()
    assert [(r["name"], r["file_count"], r["total_bytes"], r["size_human"]) for r in got] == [("data", 3, 3 * 2**62 + 1, "12288.0 PB")]


def test_first_branching_of_more_bytes_than_a_long(make_files):
    files = make_files(*HUGE)
    assert shown(folders.browse(files, 1))[0] == {"a": (2, 2**63), "b": (1, 2**62 + 1)}
    assert shown(folders.browse(files, 1, r"C:\data"))[0] == {"a": (2, 2**63), "b": (1, 2**62 + 1)}
    # a disk's totals stay longs as long as its sizes allow it
    assert dict(folders.browse(files, 2).folders.dtypes)["total_bytes"] == "bigint"


def test_rollup_of_more_bytes_than_a_long(make_files):
    got = {(r.disk_id, r.folder): r.total_bytes for r in folders.folder_rollup(make_files(*HUGE)).collect()}
    whole = 3 * 2**62 + 1
    assert got == {(1, "C:"): whole, (1, r"C:\data"): whole, (1, r"C:\data\a"): 2**63, (1, r"C:\data\b"): 2**62 + 1, (2, "C:"): 5, (2, r"C:\q"): 5}
