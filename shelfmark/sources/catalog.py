"""The catalog's four tables as Parquet folders.

A table is never changed in place::

    disks/version=N   scans/version=N   scan_errors/scan_id=S   files/disk_id=D/version=S
    packed_errors/version=S: the errors of all scans up to S
    _manifests/N.json: which folders of files count (``manifests``)

A new version of ``disks`` or ``scans`` is made from the current one under a lock, so
changes of several writers follow each other and none is lost; it counts once its
``_SUCCESS`` marker is there.

A disk's files are a base, sorted by path, and what changed since: a scan writes the
rows that are new or differ, and one *mark* for all others: "files below this root were
seen by scan S at that time".  Rows the scan did not see again are written once with
``frozen`` set, which marks pass over, until a scan sees the file again.  So a rescan
writes in proportion to what changed, and a scan of a sub-folder reads and writes that
part of the disk only.  Readers take each path's last row and its last mark.  Once the
changes are many, a scan writes a new base.

A disk's files are changed only by who holds the disk's newest fence.  Staged tables of
scans are kept beside the catalog, where the next process finds them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import DISKS, FILE_KEY, FILES, SCAN_ERRORS, SCANS, conform
from ..operators import maintained, name_index
from ..operators.changes import last_row_wins
from ..operators.disks import patch_disks
from ..operators.snapshots import KEEP
from .locks import Busy, Lock
from .manifests import Manifests

_SMALL = {"disks": DISKS, "scans": SCANS}
# rows per written part: some hundred MB, whatever the session's shuffle width
_PART_ROWS = 2_000_000
# error folders that are left to themselves before they are packed into one table
_ERROR_FOLDERS = 64
# a new base is written beyond so many folders of changes, marks, or this share of rows
_MOST_CHANGES, _MOST_MARKS, _CHANGED_SHARE = 16, 16, 0.25

#: files as stored; a frozen row was not seen by the last scan of its folder
STORED = T.StructType(FILES.fields + [T.StructField("frozen", T.BooleanType(), True)])


class Folders:
    """Folder operations on whatever file system a path names."""

    def __init__(self, spark: SparkSession) -> None:
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def matching(self, pattern: str) -> list[str]:
        path = self._jvm.org.apache.hadoop.fs.Path(pattern)
        found = path.getFileSystem(self._conf).globStatus(path)
        return sorted(status.getPath().toString() for status in (found or []))

    def remove(self, folder: str) -> None:
        path = self._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self._conf).delete(path, True)

    def committed(self, pattern: str) -> list[str]:
        """Folders that hold a finished job's output."""
        return [found.rsplit("/", 1)[0] for found in self.matching(f"{pattern}/_SUCCESS")]


def _name(folder: str) -> str:
    return folder.rsplit("=", 1)[1]


#: does a base file of a disk, with its bounds, have to be opened?
Wanted = Callable[[int, dict], bool]


def _cut_down(disk_id: int, state: dict, only: Wanted) -> dict:
    base = state["base"]
    files = [f for f in base["files"] if only(disk_id, f)]
    return state if len(files) == len(base["files"]) else {**state, "base": {**base, "files": files, "part": True}}


def _paths(base: dict) -> list[str]:
    """What to read of a base: its folder, or some of its files."""
    if base.get("part"):
        return [f"{base['folder']}/{f['name']}" for f in base["files"]]
    return [base["folder"]]


@dataclass(frozen=True)
class Seen:
    """A scan, the prefix of the paths it looked at, and when."""

    scan_id: int
    root: str
    at: datetime

    def mark(self) -> tuple[int, str, int, str]:
        return self.scan_id, self.root, self.scan_id, self.at.isoformat()


def _versions_of(state: dict) -> set[int]:
    """Scans whose rows or marks a disk holds."""
    folders = (state["base"], *state["changes"])
    return {int(_name(f["folder"])) for f in folders} | {m["version"] for m in state["marks"]}


def _many(state: dict, more: int) -> bool:
    """Would changes of ``more`` rows call for a new base?"""
    rows = more + sum(c["rows"] for c in state["changes"])
    full = len(state["changes"]) >= _MOST_CHANGES or len(state["marks"]) >= _MOST_MARKS
    return full or rows > _CHANGED_SHARE * state["base"]["rows"]


def _check(manifest: dict, disk_id: int, fence: int | None) -> None:
    """Raises ``Busy`` if the disk has been taken over by another."""
    if fence is not None and manifest["fences"].get(str(disk_id)) != fence:
        raise Busy(f"disk {disk_id} was taken over by another scan")


def _number(folder: str, key: str) -> int:
    return int(re.search(rf"{key}=(\d+)", folder).group(1))


class Catalog:
    """Reads and replaces the tables under ``root``, a folder all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.folders = spark, root.rstrip("/"), Folders(spark)
        self.manifests = Manifests(spark, f"{self.root}/_manifests")

    # -- reading ---------------------------------------------------------------

    def disks(self) -> DataFrame:
        return self._newest("disks")

    def scans(self) -> DataFrame:
        return self._newest("scans")

    def errors(self) -> DataFrame:
        upto, packed = self._packed()
        rest = [f for f in self._error_folders() if _number(f, "scan_id") > upto]
        return packed.unionByName(self._read("scan_errors", SCAN_ERRORS, rest))

    def _error_folders(self) -> list[str]:
        return self.folders.committed(f"{self.root}/scan_errors/scan_id=*")

    def _packed(self) -> tuple[int, DataFrame]:
        """The errors packed so far, and the last scan among them."""
        found = sorted(self.folders.committed(f"{self.root}/packed_errors/version=*"), key=lambda f: _number(f, "version"))
        rows = self._read("packed_errors", SCAN_ERRORS, found[-1:])
        return (_number(found[-1], "version") if found else 0), rows

    def files(self, disk_id: int | None = None, manifest: dict | None = None, only: Wanted | None = None) -> DataFrame:
        """Files of one disk or of all; other disks' folders are not touched.

        ``only`` picks the base files to open (by disk and entry in the manifest); it
        must not leave out a file with a row that is asked for."""
        return self.stored_files(disk_id, manifest, only).drop("frozen")

    def stored_files(self, disk_id: int | None = None, manifest: dict | None = None, only: Wanted | None = None) -> DataFrame:
        """``files`` with the column ``frozen``."""
        disks = (manifest or self.manifests.newest())["disks"]
        chosen = {int(d): state for d, state in disks.items() if disk_id is None or int(d) == disk_id}
        if only:
            chosen = {d: _cut_down(d, state, only) for d, state in chosen.items()}
        plain = [path for s in chosen.values() if not (s["changes"] or s["marks"]) for path in _paths(s["base"])]
        altered = {d: s for d, s in chosen.items() if s["changes"] or s["marks"]}
        rows = self._read("files", STORED, plain)
        return rows.unionByName(self._merged(altered)) if altered else rows

    def _merged(self, disks: dict[int, dict]) -> DataFrame:
        """Last rows and last marks of disks with changes."""
        folders = [c["folder"] for s in disks.values() for c in s["changes"]]
        # a base file outside the range of all changes of its disk needs no look-up
        apart, near = self._by_range(disks)
        rows = self._versions(apart)
        if folders:
            changes = self._versions(folders)
            last = last_row_wins(changes, FILE_KEY, [F.col("version")]) if self._several(disks) else changes
            kept = self._versions(near).join(changes.select(*FILE_KEY), FILE_KEY, "left_anti")
            rows = rows.unionByName(kept).unionByName(last)
        marks = [(d, m["version"], m["root"], m["scan_id"], m["seen"]) for d, s in disks.items() for m in s["marks"]]
        rows = self._marked(rows, marks) if marks else rows
        return rows.select(*STORED.fieldNames())

    @staticmethod
    def _several(disks: dict[int, dict]) -> bool:
        """Does a disk have several folders of changes, which may repeat a path?"""
        return any(len(s["changes"]) > 1 for s in disks.values())

    def _by_range(self, disks: dict[int, dict]) -> tuple[list[str], list[str]]:
        """Base files outside and inside the path range of their disk's changes: whole
        folders where there is nothing to tell apart."""
        apart, near = [], []
        for state in disks.values():
            base = state["base"]
            bounds = [f for c in state["changes"] for f in c["files"]]
            if not bounds:
                apart += _paths(base)
                continue
            low, high = min(f["low"] for f in bounds), max(f["high"] for f in bounds)
            inside = [f["name"] for f in base["files"] if f["high"] >= low and f["low"] <= high]
            if len(inside) == len(base["files"]):
                near += _paths(base)
            else:
                near += [f"{base['folder']}/{name}" for name in inside]
                apart += [f"{base['folder']}/{f['name']}" for f in base["files"] if f["name"] not in set(inside)]
        return apart, near

    def _versions(self, paths: list[str]) -> DataFrame:
        """Stored rows with the version they came with."""
        schema = T.StructType([*STORED.fields, T.StructField("version", T.LongType(), True)])
        return self._read("files", schema, paths)

    def _marked(self, rows: DataFrame, marks: list[tuple]) -> DataFrame:
        """Rows with the scan and time of the last mark that holds for them."""
        kind = "disk_id long, version long, root string, scan_id long, seen timestamp"
        given = [(*m[:4], datetime.fromisoformat(m[4])) for m in marks]
        fields = F.struct("version", "root", "scan_id", "seen")
        listed = self.spark.createDataFrame(given, kind).groupBy("disk_id").agg(F.array_sort(F.collect_list(fields)).alias("_marks"))
        # at most ``_MOST_MARKS`` marks a disk
        joined = rows.join(F.broadcast(listed), "disk_id", "left")
        holds = F.filter("_marks", lambda m: (m["version"] > F.col("version")) & F.startswith(F.col("path"), m["root"]))
        last = F.when(~F.coalesce("frozen", F.lit(False)), F.try_element_at(holds, F.lit(-1)))
        joined = joined.withColumn("_last", last)
        seen = {"scan_id": F.coalesce("_last.scan_id", "scan_id"), "last_seen": F.coalesce("_last.seen", "last_seen")}
        return joined.withColumns(seen).drop("_marks", "_last")

    def _newest(self, table: str) -> DataFrame:
        found = self.folders.committed(f"{self.root}/{table}/version=*")
        return self._read(table, _SMALL[table], sorted(found, key=lambda f: _number(f, "version"))[-1:])

    def _read(self, table: str, schema: T.StructType, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}")
        return conform(reader.parquet(*folders), schema)

    # -- writing ---------------------------------------------------------------

    def lock(self, name: str, wait: float = 600.0) -> Lock:
        """To be entered by whoever changes ``name``; waits, then raises ``Busy``."""
        return Lock(self.spark, f"{self.root}/_locks/{name}", wait)

    def update(self, table: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """New version of ``disks`` or ``scans``, made from the current one."""
        with self.lock(table):
            rows = conform(change(self._newest(table)), _SMALL[table])
            done = self.folders.matching(f"{self.root}/{table}/version=*")
            version = 1 + max((_number(f, "version") for f in done), default=0)
            rows.hint("rebalance").write.parquet(f"{self.root}/{table}/version={version:08d}")
            return self._newest(table)

    def patch_disks(self, patches: DataFrame) -> DataFrame:
        """Stores edits of labels and descriptions, also while scans run; gives the disks."""
        return self.update("disks", lambda disks: patch_disks(disks, patches))

    def take_over(self, disk_id: int) -> int:
        """A fence for who has just entered the disk's lock; earlier ones are void."""
        return self.manifests.raise_fence(disk_id)

    def replace_files(
        self, disk_id: int, version: int, rows: DataFrame, count: int, fence: int | None = None, totals: dict | None = None
    ) -> None:
        """New base of one disk's files, about ``count`` of them, sorted by path.

        Sorted row groups let folder browsing skip most of a disk; the Bloom filter
        does so for looking up a hash.  An index of names goes with the old base, and so
        do stored totals unless the new ones are given.
        """
        base = self._write_files(disk_id, version, rows, count)

        def entered(manifest: dict) -> None:
            _check(manifest, disk_id, fence)
            manifest["disks"][str(disk_id)] = {"base": base, "changes": [], "marks": [], "totals": totals, "names": None}

        self.manifests.commit(entered)

    def add_changes(self, disk_id: int, rows: DataFrame, seen: Seen, fence: int | None = None, signed: DataFrame | None = None) -> None:
        """Enters what a scan saw of a disk: changed rows, and a mark for all others.

        Writes a new base if the disk has none, or if its changes have become many.
        ``signed`` says what changes in the disk's totals; without it those are dropped.
        What a scan has entered before is not entered again."""
        state = self.manifests.newest()["disks"].get(str(disk_id))
        if state and seen.scan_id in _versions_of(state):
            return
        count = rows.count()
        totals = self._more_totals(disk_id, seen.scan_id, state, signed) if state and state.get("totals") and signed is not None else None
        if state is None or _many(state, count):
            if state:
                old = self.stored_files(disk_id).withColumn("version", F.lit(0).cast("long"))
                old = self._marked(old, [(disk_id, *seen.mark())]).drop("version")
                rows = old.join(rows.select(*FILE_KEY), FILE_KEY, "left_anti").unionByName(rows)
                count += sum(part["rows"] for part in (state["base"], *state["changes"]))
            self.replace_files(disk_id, seen.scan_id, rows, count, fence, totals)
            return
        change = self._write_files(disk_id, seen.scan_id, rows, count) if count else None

        def entered(manifest: dict) -> None:
            _check(manifest, disk_id, fence)
            state = manifest["disks"][str(disk_id)]
            state["changes"] += [change] if change else []
            # a mark is of no more use below a later one
            others = [m for m in state["marks"] if not m["root"].startswith(seen.root)]
            state["marks"] = [*others, dict(zip(("version", "root", "scan_id", "seen"), seen.mark()))]
            state["totals"] = totals

        self.manifests.commit(entered)

    # -- totals and names kept beside the files -----------------------------------

    def keep_totals(self, disk_id: int, sep: str) -> None:
        """Stores folder totals and hash counts of a disk; scans keep them up to date."""
        with self.lock(f"disk={disk_id}"):
            fence = self.take_over(disk_id)
            state = self.manifests.newest()["disks"][str(disk_id)]
            whole = maintained.signed(self.files(disk_id), 1)
            empty_ = {"sep": sep, "rollup": [], "hashes": []}
            totals = self._more_totals(disk_id, max(_versions_of(state)), {"totals": empty_}, whole)
            self._alter(disk_id, fence, "totals", totals)

    def folder_totals(self, disk_id: int | None = None) -> DataFrame:
        """Stored totals of every folder (see ``folder_rollup``) of disks that keep them."""
        return maintained.add_up_rollup(self._totals("rollup", maintained.ROLLUP, disk_id))

    def hash_counts(self, disk_id: int | None = None) -> DataFrame:
        """Stored count and bytes of every hash; those with two copies are the duplicates."""
        return maintained.add_up_hashes(self._totals("hashes", maintained.HASHES, disk_id))

    def _totals(self, kind: str, schema: str, disk_id: int | None) -> DataFrame:
        disks = self.manifests.newest()["disks"]
        some = [s["totals"] for d, s in disks.items() if s.get("totals") and disk_id in (None, int(d))]
        folders = [folder for totals in some for folder in totals[kind]]
        reader = self.spark.read.schema(schema)
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _more_totals(self, disk_id: int, version: int, state: dict, signed: DataFrame) -> dict:
        """Totals with those of some signed rows added; many parts become one."""
        totals = state["totals"]
        made = {"sep": totals["sep"]}
        steps = {
            "rollup": (maintained.rollup_changes(signed, totals["sep"]), maintained.add_up_rollup, maintained.ROLLUP),
            "hashes": (maintained.hash_changes(signed), maintained.add_up_hashes, maintained.HASHES),
        }
        for kind, (more, add_up, schema) in steps.items():
            parts = totals[kind]
            if len(parts) >= _MOST_CHANGES:
                more, parts = add_up(self.spark.read.schema(schema).parquet(*parts).unionByName(more)), []
            folder = f"{self.root}/{kind}/disk_id={disk_id}/version={version:08d}-{uuid.uuid4().hex}"
            more.write.parquet(folder)
            made[kind] = [*parts, folder]
        return made

    def index_names(self, disk_id: int) -> None:
        """Stores which base files hold which pieces of names (see ``name_index``).

        Holds until the disk gets a new base; changes since the base are few and always
        looked through."""
        with self.lock(f"disk={disk_id}"):
            fence = self.take_over(disk_id)
            base = self.manifests.newest()["disks"][str(disk_id)]["base"]
            rows = self.spark.read.schema(STORED).parquet(base["folder"])
            named = rows.select("filename", F.col("_metadata.file_name").alias("name"))
            folder = f"{self.root}/names/disk_id={disk_id}/version={_name(base['folder'])}-{uuid.uuid4().hex}"
            # sorted, so that a look-up skips all row groups but those of its pieces
            name_index.postings(named, "name").repartitionByRange("piece").sortWithinPartitions("piece", "block").write.parquet(folder)
            self._alter(disk_id, fence, "names", folder)

    def name_candidates(self, manifest: dict, disk_id: int | None, text: str) -> Wanted:
        """Which base files may hold ``text`` in a name."""
        found: dict[int, set[str]] = {}
        for disk, state in manifest["disks"].items():
            if state.get("names") and disk_id in (None, int(disk)):
                index = self.spark.read.schema("piece string, block string").parquet(state["names"])
                blocks = name_index.candidates(index, text)
                if blocks is not None:
                    # names of the disk's base files, at most
                    found[int(disk)] = {r[0] for r in blocks.collect()}
        return lambda disk, file: disk not in found or file["name"] in found[disk]

    def _alter(self, disk_id: int, fence: int, key: str, value) -> None:
        def entered(manifest: dict) -> None:
            _check(manifest, disk_id, fence)
            manifest["disks"][str(disk_id)][key] = value

        self.manifests.commit(entered)

    # -- folders of files -----------------------------------------------------------

    def _write_files(self, disk_id: int, version: int, rows: DataFrame, count: int) -> dict:
        """Writes a folder of files; gives its entry in a manifest, with the bounds of
        each file."""
        parts = max(1, -(-count // _PART_ROWS))
        folder = f"{self.root}/files/disk_id={disk_id}/version={version:08d}"
        (
            conform(rows, STORED)
            .drop("disk_id")
            .repartitionByRange(parts, "path")
            .sortWithinPartitions("path")
            .write.option("parquet.bloom.filter.enabled#hash", "true")
            .option("parquet.bloom.filter.expected.ndv#hash", "500000")
            .mode("overwrite")
            .parquet(folder)
        )
        return {"folder": folder, **self._bounds(folder)}

    def _bounds(self, folder: str) -> dict:
        """Rows and bounds of the files of a folder, one row for each of them."""
        stored = T.StructType([f for f in STORED.fields if f.name != "disk_id"])
        rows = self.spark.read.schema(stored).parquet(folder)
        time = F.unix_micros(F.col("modified_date"))
        found = rows.groupBy(F.col("_metadata.file_name").alias("name")).agg(
            F.count("*").alias("rows"),
            F.min("path").alias("low"),
            F.max("path").alias("high"),
            F.min(time).alias("oldest"),
            F.max(time).alias("newest"),
            F.min("size_bytes").alias("smallest"),
            F.max("size_bytes").alias("largest"),
        )
        files = [r.asDict() for r in found.orderBy("low", "name").collect()]
        return {"rows": sum(f["rows"] for f in files), "files": files}

    def replace_errors(self, scan_id: int, rows: DataFrame) -> None:
        rows = conform(rows, SCAN_ERRORS).drop("scan_id").hint("rebalance")
        rows.write.mode("overwrite").parquet(f"{self.root}/scan_errors/scan_id={scan_id}")

    def pack_errors(self, folders: int = _ERROR_FOLDERS) -> None:
        """Brings the errors of ended scans into one table once they fill ``folders``."""
        with self.lock("errors"):
            upto, packed = self._packed()
            running = self.scans().where("status = 'running'").agg(F.min("scan_id")).first()[0]
            ended = [f for f in self._error_folders() if running is None or _number(f, "scan_id") < running]
            fresh = [f for f in ended if _number(f, "scan_id") > upto]
            if len(fresh) >= folders:
                version = max(_number(f, "scan_id") for f in fresh)
                rows = packed.unionByName(self._read("scan_errors", SCAN_ERRORS, fresh))
                rows.hint("rebalance").write.parquet(f"{self.root}/packed_errors/version={version:08d}")
            else:  # those packed last time have had their readers
                for folder in ended:
                    if _number(folder, "scan_id") <= upto:
                        self.folders.remove(folder)

    def drop_old_versions(self, keep: int = 2, keep_small: int = 16) -> list[str]:
        """Removes all folders of files that no longer count but the newest of each disk
        (with ``keep`` 1: all of them), and all but ``keep_small`` versions of the small
        tables, which change more often while being read."""
        removed = []
        for parent in (f"{self.root}/{t}" for t in (*_SMALL, "packed_errors")):
            done = sorted(self.folders.committed(f"{parent}/version=*"), key=lambda f: _number(f, "version"))
            removed += done[:-keep_small] if keep_small > 0 else []
        disks = self.manifests.newest()["disks"]
        for disk, state in disks.items():
            current = {_name(f["folder"]) for f in (state["base"], *state["changes"])}
            # what a scan is writing has a higher number than all that counts
            last = max(_number(f"version={n}", "version") for n in current)
            done = self.folders.committed(f"{self.root}/files/disk_id={disk}/version=*")
            idle = [f for f in done if _name(f) not in current and _number(f, "version") < last]
            removed += idle[: len(idle) - (keep - 1)] if keep > 1 else idle
        for folder in removed:
            self.folders.remove(folder)
        return removed


# -- dated copies -------------------------------------------------------------

_STAMP = "yyyyMMdd_HHmmss"


def _stamp(spark: SparkSession) -> str:
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return spark.range(1).select(F.date_format(now, _STAMP)).first()[0]


def _complete(folders: Folders, target: str, day: str = "*") -> list[str]:
    # files are written last: with them the copy is whole
    return [f.rsplit("/", 1)[0] for f in folders.committed(f"{target}/snapshot={day}/files")]


def snapshot_now(catalog: Catalog, target: str, keep: int = KEEP, stamp: str | None = None) -> str:
    """Copies all tables to ``target``/snapshot=<UTC time>; keeps the newest ``keep``."""
    with Lock(catalog.spark, f"{target}/_locks/snapshots"):
        folder = f"{target}/snapshot={stamp or _stamp(catalog.spark)}"
        tables = {"disks": catalog.disks(), "scans": catalog.scans(), "scan_errors": catalog.errors(), "files": catalog.files()}
        for name, rows in tables.items():
            by_disk = ["disk_id"] if name == "files" else []
            rows.write.partitionBy(*by_disk).parquet(f"{folder}/{name}")
        _drop_old(catalog, target, keep)
        return folder


def has_snapshot(catalog: Catalog, target: str, day: str) -> bool:
    """Is there a copy of that UTC day (yyyymmdd)?"""
    return bool(_complete(catalog.folders, target, f"{day}_*"))


def snapshot_if_needed(catalog: Catalog, target: str, keep: int = KEEP, stamp: str | None = None) -> str | None:
    """``snapshot_now`` unless this UTC day has a copy already."""
    stamp = stamp or _stamp(catalog.spark)
    if has_snapshot(catalog, target, stamp[:8]):
        return None
    return snapshot_now(catalog, target, keep, stamp)


def drop_old_snapshots(catalog: Catalog, target: str, keep: int = KEEP) -> list[str]:
    """Removes all but the newest ``keep`` complete copies, and those that a process
    which died left unfinished; gives the folders removed."""
    with Lock(catalog.spark, f"{target}/_locks/snapshots"):
        return _drop_old(catalog, target, keep)


def _drop_old(catalog: Catalog, target: str, keep: int) -> list[str]:
    # whoever holds the lock is the only one to write: what is unfinished stays so
    done = sorted(_complete(catalog.folders, target), key=lambda f: f.rsplit("/", 1)[1])
    removed = [f for f in catalog.folders.matching(f"{target}/snapshot=*") if f not in done]
    removed += done[: max(len(done) - keep, 0)]
    for folder in removed:
        catalog.folders.remove(folder)
    return removed
