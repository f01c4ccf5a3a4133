"""Directory trees as a table: one row per file, or per thing that failed.

Directories reached through a symbolic link are not entered; a link to a file is
listed with the size and times of its target.  Hidden and empty files count like
any other.  What cannot be listed or examined becomes a row with an
``error_message``, and the listing goes on.  Executors must see the tree under
the same path as the driver.

Two ways in:

* ``spark.read.format("filetree").load(root)`` reads a tree in one go, split into
  sub-trees on the driver.  Filters on path, name, extension, size and times are taken
  over: folders that no wanted path lies in are never opened, and files whose name rules
  them out are not examined.  Nor is any file if the reader's schema has no sizes and
  times.  A folder with very many entries is shared out by the hash of their names;
* ``list_tree`` is for trees of any size and shape.  Tasks hand back directories
  beyond a budget, which are spread again over all tasks, and examining files is
  a step of its own.  So neither a deep sub-tree nor a directory holding most of
  the files falls to one task.
"""

from __future__ import annotations

import operator
import os
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

SCHEMA = (
    "path string, filename string, extension string, size_bytes long, "
    "created_date timestamp, modified_date timestamp, error_message string"
)
_FOUND = "kind string, folder string, name string, error_message string"
_BATCH = 4096
# entries of a folder that one task of the source examines
_WIDE = 20_000
# names of sub-folders that the source holds at once
_MOST_FOLDERS = 100_000

_UTC = pa.timestamp("us", tz="UTC")
_ROWS = pa.schema(
    [
        ("path", pa.string()),
        ("filename", pa.string()),
        ("extension", pa.string()),
        ("size_bytes", pa.int64()),
        ("created_date", _UTC),
        ("modified_date", _UTC),
        ("error_message", pa.string()),
    ]
)
_FOUND_ROWS = pa.schema([(c.split()[0], pa.string()) for c in _FOUND.split(", ")])

FILE, FOLDER, ERROR = "file", "folder", "error"


def existing_root(root: str) -> str:
    """Absolute form of a root that must exist."""
    full = os.path.realpath(root)
    if not os.path.exists(full):
        raise FileNotFoundError(full)
    return full


def _entries(folder: str) -> Iterator[tuple]:
    """Files and sub-folders directly in ``folder``, streamed."""
    try:
        with os.scandir(folder) as found:
            for entry in found:
                kind = _kind(entry)
                if kind is not None:
                    yield kind, folder, entry.name, None
    except OSError as exc:
        yield ERROR, folder, None, str(exc)


def _kind(entry: os.DirEntry) -> str | None:
    try:
        if not entry.is_dir():
            return FILE
        return None if entry.is_symlink() or entry.is_junction() else FOLDER
    except OSError:
        return FILE


def _file_row(folder: str, name: str) -> tuple:
    path = os.path.join(folder, name)
    try:
        name.encode()
        folder.encode()
        st = os.stat(path)
        made, changed = (datetime.fromtimestamp(s, timezone.utc) for s in (st.st_ctime, st.st_mtime))
    except (OSError, OverflowError, ValueError) as exc:
        return _error_row(path, str(exc))
    return path, name, _suffix(name), st.st_size, made, changed, None


def _name_row(folder: str, name: str) -> tuple:
    """A file that is not examined."""
    path = os.path.join(folder, name)
    try:
        path.encode()
    except ValueError as exc:
        return _error_row(path, str(exc))
    return path, name, _suffix(name), None, None, None, None


def _suffix(name: str) -> str:
    dot = name.rfind(".")
    return name[dot:].lower() if 0 < dot < len(name) - 1 else ""


def _error_row(path: str, message: str) -> tuple:
    return _text(path), None, None, None, None, None, _text(message)


def _text(name: str | None) -> str | None:
    """A name that is not valid text, made readable (it is only reported)."""
    return None if name is None else name.encode("utf-8", "surrogateescape").decode("utf-8", "backslashreplace")


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    waiting: list[tuple] = []
    for row in rows:
        waiting.append(row)
        if len(waiting) == _BATCH:
            yield _batch(waiting, schema)
            waiting = []
    if waiting:
        yield _batch(waiting, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


# -- spark.read.format("filetree") -------------------------------------------


class _Part(InputPartition):
    """Directories, with everything below them or on their own.

    With ``of`` above 1 only the entries whose name hashes to ``share`` count."""

    def __init__(self, folders: list[str], deep: bool, share: int = 0, of: int = 1) -> None:
        super().__init__((folders, deep, share, of))
        self.folders, self.deep, self.share, self.of = folders, deep, share, of

    def has(self, name: str | None) -> bool:
        return self.of == 1 or zlib.crc32(os.fsencode(name or "")) % self.of == self.share


_COLUMNS = _ROWS.names
_FROM_NAME = ("path", "filename", "extension")


class _Wanted:
    """The filters a reader has taken over."""

    def __init__(self) -> None:
        self.tests: list[tuple[str, Callable]] = []
        self.prefixes: list[str] = []

    def take(self, given: Filter) -> bool:
        """Is it one the reader applies exactly?"""
        if isinstance(given, IsNotNull):
            column, test = given.attribute, lambda value: True
        elif type(given) in _COMPARED:
            column, value = given.attribute, given.value
            if value is None:
                return False
            compare = _COMPARED[type(given)]
            test = lambda have: compare(have, value)
        else:
            return False
        if len(column) != 1 or column[0] not in _COLUMNS:
            return False
        self.tests.append((column[0], test))
        if column[0] == "path" and isinstance(given, (StringStartsWith, EqualTo)):
            self.prefixes.append(given.value)
        return True

    def enters(self, folder: str) -> bool:
        """Can a wanted path lie in a folder, or below it?"""
        inside = os.path.join(folder, "")
        return all(inside.startswith(p) or p.startswith(inside) or p == folder for p in self.prefixes)

    def by_name(self, folder: str, name: str) -> bool:
        """Does a file pass what its name alone decides?"""
        row = None
        for column, test in self.tests:
            if column in _FROM_NAME:
                row = row or dict(zip(_FROM_NAME, (os.path.join(folder, name), name, _suffix(name))))
                if not test(row[column]):
                    return False
        return True

    def passes(self, row: tuple) -> bool:
        for column, test in self.tests:
            value = row[_COLUMNS.index(column)]
            if value is None or not test(value):
                return False
        return True


_COMPARED = {
    EqualTo: operator.eq,
    GreaterThan: operator.gt,
    GreaterThanOrEqual: operator.ge,
    LessThan: operator.lt,
    LessThanOrEqual: operator.le,
    In: lambda have, values: have in values,
    StringStartsWith: str.startswith,
    StringEndsWith: str.endswith,
    StringContains: operator.contains,
}


class _Reader(DataSourceReader):
    def __init__(self, root: str, parts: int, columns: list[str] = _COLUMNS) -> None:
        self.root, self.parts, self.columns, self.wanted = root, parts, columns, _Wanted()
        # sizes and times are looked up only if they are asked for
        self.examine = any(c in columns for c in ("size_bytes", "created_date", "modified_date"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for given in filters:
            if not self.wanted.take(given):
                yield given

    def partitions(self) -> list[InputPartition]:
        """Opens directories breadth first until there are enough of them.

        The files of an opened directory form a part apart from its sub-trees, or several
        parts if they are many.  Many sub-trees share the parts there are.  The driver
        holds a bounded number of names: a directory with more than ``_MOST_FOLDERS``
        sub-folders is left unopened, and shared out by the names of its entries.
        """
        found: list[InputPartition] = []
        waiting = deque([self.root] if self.wanted.enters(self.root) else [])
        while waiting and len(found) + len(waiting) < self.parts:
            folder = waiting.popleft()
            below, files = [], 0
            for kind, where, name, _ in _entries(folder):
                if kind != FOLDER:
                    files += 1
                elif self.wanted.enters(os.path.join(where, name)):
                    below.append(os.path.join(where, name))
                    if len(below) > _MOST_FOLDERS:
                        break
            if len(below) > _MOST_FOLDERS:
                found += [_Part([folder], True, n, self.parts) for n in range(self.parts)]
            else:
                shares = max(1, -(-files // _WIDE))
                found += [_Part([folder], False, n, shares) for n in range(shares)]
                waiting.extend(below)
        trees = list(waiting)
        shares = [trees[n :: self.parts] for n in range(min(self.parts, len(trees)))]
        return found + [_Part(share, True) for share in shares]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([_ROWS.field(c) for c in self.columns])
        at = [_COLUMNS.index(c) for c in self.columns]
        rows = (row for row in self._rows(partition) if self.wanted.passes(row))
        return _batches((tuple(row[k] for k in at) for row in rows), schema)

    def _rows(self, part: _Part) -> Iterator[tuple]:
        first = set(part.folders)
        waiting = list(part.folders)
        while waiting:
            top = waiting.pop()
            for kind, folder, name, message in _entries(top):
                # only the entries of the part's own folders are shared out
                if top in first and not part.has(name):
                    continue
                if kind == FILE:
                    if self.wanted.by_name(folder, name):
                        yield _file_row(folder, name) if self.examine else _name_row(folder, name)
                elif kind == ERROR:
                    yield _error_row(folder, message)
                elif part.deep and self.wanted.enters(os.path.join(folder, name)):
                    if len(waiting) < _MOST_FOLDERS:
                        waiting.append(os.path.join(folder, name))
                    else:  # never piled up: entered at once
                        yield from self._rows(_Part([os.path.join(folder, name)], True))


class FileTree(DataSource):
    """Data source ``filetree``; option ``parts``: how many parts to aim for."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(existing_root(self.options["path"]), int(self.options.get("parts", 64)), schema.fieldNames())


def register(spark: SparkSession) -> None:
    """Makes the source known; filters reach Python sources only where that is set."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileTree)


# -- trees of any size --------------------------------------------------------


def _walk(budget: int) -> Callable:
    """Lists up to ``budget`` directories per task; the others come back as rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        left = budget
        for batch in batches:
            waiting = [_unpacked(folder) for folder in batch.column("folder").to_pylist()]
            while waiting and left:
                left -= 1
                for kind, folder, name, message in _entries(waiting.pop()):
                    if kind != FOLDER:
                        yield kind, folder, name, message
                    elif len(waiting) < left:
                        waiting.append(os.path.join(folder, name))
                    else:  # more than this task will open: never piled up in memory
                        yield FOLDER, os.path.join(folder, name), None, None
            for folder in waiting:
                yield FOLDER, folder, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(((k, *map(_packed, rest)) for k, *rest in rows(batches)), _FOUND_ROWS)

    return run


def _packed(name: str | None) -> str | None:
    """Names travel with undecodable bytes written out, behind a NUL mark."""
    if name is None:
        return None
    try:
        name.encode()
        return name
    except UnicodeEncodeError:
        return "\0" + os.fsencode(name).hex()


def _unpacked(name: str | None) -> str | None:
    return os.fsdecode(bytes.fromhex(name[1:])) if name and name[0] == "\0" else name


def _examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for kind, folder, name, message in zip(*(batch.column(c).to_pylist() for c in _FOUND_ROWS.names)):
                if kind == ERROR:
                    yield _error_row(_unpacked(folder), _unpacked(message))
                else:
                    yield _file_row(_unpacked(folder), _unpacked(name))

    return _batches(rows(), _ROWS)


def list_tree(spark: SparkSession, root: str, staging: str, budget: int = 20_000, per_task: int = 50_000) -> DataFrame:
    """The rows of the ``filetree`` source for a tree of any size.

    ``staging`` is a fresh folder all executors share.  Every round is written
    there, so a lost executor repeats one task and a listing is made only once.
    """
    width = spark.sparkContext.defaultParallelism
    folders = spark.createDataFrame([(_packed(existing_root(root)),)], "folder string")
    this_round = 0
    while True:
        # the first round only fans out
        limit = budget if this_round else 4 * width
        out = f"{staging}/round={this_round}"
        folders.mapInArrow(_walk(limit), _FOUND).write.parquet(out)
        pending = spark.read.schema(_FOUND).parquet(out).where(F.col("kind") == FOLDER).select("folder")
        if pending.isEmpty():
            break
        folders = pending.repartition(4 * width)
        this_round += 1
    found = spark.read.schema(_FOUND).parquet(*[f"{staging}/round={n}" for n in range(this_round + 1)])
    found = found.where(F.col("kind") != FOLDER)
    tasks = max(width, -(-found.count() // per_task))
    return found.repartition(tasks).mapInArrow(_examine, SCHEMA)
