import datetime as dt
import itertools
import mimetypes
import random
from decimal import Decimal
from pathlib import PurePosixPath, PureWindowsPath

from pyspark.sql import functions as F

from shelfmark import functions as C
from shelfmark.functions.kinds import CATEGORIES, MIME
from shelfmark.functions.paths import folder_of, split_folder
from shelfmark.plans.queries import QUERIES


def column(spark, values, kind, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(rows.select("i", expr(F.col("v"))).collect())]


def python_size(n):
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    k = 0
    x = float(n)
    while x >= 1024 and k < 5:
        x, k = x / 1024, k + 1
    return f"{int(x)} B" if k == 0 else f"{x:.1f} {units[k]}"


def test_human_size_equals_python_formatting(spark):
    rng = random.Random(1)
    values = list(range(3000)) + [1024**k + d for k in range(1, 7) for d in (-1, 0, 1)]
    values += [rng.randrange(1024**k) for k in range(1, 6) for _ in range(2000)]
    # exact halves of a tenth, which go to the even digit
    values += [1024**k * n // 20 for k in range(1, 5) for n in range(20, 400)]
    assert column(spark, values, "long", C.human_size) == [python_size(v) for v in values]


def test_human_size_of_null(spark):
    assert column(spark, [None, 0], "long", C.human_size) == [None, "0 B"]


def test_human_size_beyond_a_long(spark):
    values = [10**n * k for n in range(17, 26) for k in (1, 7)] + [2**63 - 1, 2**63, 899_999**2 * 1009 * 10**6]
    assert column(spark, [Decimal(v) for v in values], "decimal(38,0)", C.human_size) == [python_size(v) for v in values]


def test_million_times_a_large_size(spark, tmp_path):
    """``size_functions`` over an order whose size times a million is beyond a long."""
    order = (1, 899_999, "O", 1.0, dt.datetime(1996, 1, 2), "1-URGENT")
    kinds = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame([order], kinds).write.parquet(str(tmp_path / "orders.parquet"))
    size = 899_999**2 * 1009
    got = QUERIES["size_functions"](spark, str(tmp_path)).first()
    assert tuple(got)[1:] == (*[python_size(size * n) for n in (1, 1000, 10**6)], python_size(size % 3000))


def test_suffix(spark):
    names = {
        "a.TXT": ".txt", ".bashrc": "", "a.": "", "..foo": ".foo", "x.tar.gz": ".gz", "noext": "",
        "": "", ".": "", "a..b": ".b", ".a.b": ".b", "šuma.PŠ": ".pš",
    }
    assert column(spark, list(names), "string", C.suffix) == list(names.values())


def test_mime_type_equals_stdlib(spark):
    table = mimetypes.MimeTypes(filenames=())
    parts = sorted(MIME.types) + sorted(MIME.short) + MIME.packed + [".TXT", ".none", ".", "", ".JPEG"]
    names = [f"f{a}" for a in parts] + [f"f{a}{b}" for a in parts for b in MIME.packed + [".tgz", ".Z"]]
    names += [p for p in parts] + [f"..{p}" for p in parts[:20]] + [".tar.gz", "..gz", "a.b.c.txt.gz"]
    assert column(spark, names, "string", C.mime_type) == [table.guess_type(n)[0] for n in names]


def test_categories(spark):
    assert sum(len(e) for e in CATEGORIES.values()) == 80
    known = {".JPG": "Image", ".ts": "Code", ".csv": "Spreadsheet", ".md": "Document", ".Epub": "Book"}
    known |= {"": "Other", None: "Other", ".xyz": "Other", "jpg": "Other"}
    assert column(spark, list(known), "string", C.categorize) == list(known.values())
    for name in [*CATEGORIES, "Other"]:
        inside = column(spark, list(known), "string", lambda c: C.in_category(c, name))
        assert inside == [v == name for v in known.values()]


def test_parent_folder(spark):
    paths = [r"C:\a\b.txt", r"C:\b.txt", r"\\srv\share\b.txt", r"\\srv\share\d\b.txt", "b.txt", r"d\b.txt"]
    expected = [str(PureWindowsPath(p).parent) for p in paths]
    assert column(spark, paths, "string", C.parent_folder) == expected
    paths = ["/a/b", "/b", "b", "/a/b/c.d"]
    expected = [str(PurePosixPath(p).parent) for p in paths]
    assert column(spark, paths, "string", lambda c: C.parent_folder(c, "/")) == expected


def test_segments_tidy_and_parents(spark):
    paths = [r"C:\a\b", r"C:\\a\\\b\\", "\\", "", r"\\srv\s\x", "a"]
    split = [[p for p in path.split("\\") if p] for path in paths]
    assert column(spark, paths, "string", C.path_segments) == split
    assert column(spark, paths, "string", C.tidy_path) == ["\\".join(s) for s in split]
    up = ["\\".join(s[:-1]) if len(s) > 1 else None for s in split]
    assert column(spark, paths, "string", C.parent_path) == up
    above = column(spark, paths, "string", lambda c: folder_of(C.tidy_path(c)))
    assert above == ["\\".join(s[:-1]) for s in split]
    slashed = [p.replace("\\", "/") for p in paths]
    assert column(spark, slashed, "string", lambda c: C.tidy_path(c, "/")) == ["/".join(s) for s in split]


def test_ancestors(spark):
    got = column(spark, [r"C:\a\b", ""], "string", C.ancestors)
    assert [tuple(step) for step in got[0]] == [("C:", "C:"), ("a", r"C:\a"), ("b", r"C:\a\b")]
    assert got[1] == []


def test_under_folder_matches_brute_force(spark):
    rng = random.Random(3)
    names = ["a", "A", "b!", "b%", "b_", "Š", "š", "[", "a b", "Z"]
    paths = [
        rng.choice(["", "", "", "\\", "\\\\"]) + "\\".join(rng.choice(names) for _ in range(rng.randint(1, 5)))
        for _ in range(400)
    ]
    folders = [None, "", "\\", "a", r"A\b!", r"b%\a", "b_", "Š", r"\\a\Z", "[", r"z\a b"]

    def fold(text):
        return "".join(ch.lower() if ch.isascii() else ch for ch in text)

    for folder in folders:
        wanted = split_folder(folder)
        prefix = fold("\\".join(wanted) + "\\") if wanted else ""
        expected = [fold(p.lstrip("\\")).startswith(prefix) for p in paths]
        assert column(spark, paths, "string", lambda c: C.under_folder(c, folder)) == expected, folder


def test_strip_takes_every_white_space(spark):
    blanks = [chr(n) for n in range(0x3001) if chr(n).isspace()]
    values = [b + "a" + b + "b" + b for b in blanks] + ["", "  ", "x", "\u200bx"]
    assert column(spark, values, "string", C.strip) == [v.strip() for v in values]


def test_times_shown_in_utc_whatever_the_session(spark):
    rows = spark.sql("SELECT timestamp'2024-01-02 03:04:05Z' t, timestamp'2024-01-02 03:04:05.000700Z' u")
    kind = rows.schema["t"].dataType
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", other)
            shown = rows.select(C.iso_utc("t", kind), C.iso_utc("u", kind), C.display_ts("t", kind)).first()
            assert tuple(shown) == (
                "2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05.000700+00:00", "2024-01-02 03:04:05",
            )
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_short_hash_and_blank(spark):
    digest = "".join(itertools.islice(itertools.cycle("0123456789abcdef"), 40))
    assert column(spark, [digest, "ab", None], "string", C.short_hash) == [digest[:16], "ab", None]
    assert column(spark, [None, "x"], "string", C.blank_if_null) == ["", "x"]
