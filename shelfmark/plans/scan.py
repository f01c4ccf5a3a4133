"""A whole scan: list, compare, hash what changed, and renew the files table.

Every step ends in a written table, so nothing that could differ between two
runs (a listing, a digest, the time) is computed twice, and a lost executor
costs its tasks only.  Hashing is committed in portions.  What a scan had hashed
before it stopped enters the catalog all the same, so the next scan reads only
the rest: at once after an error, at the next scan of the disk after a crash, by
whatever process.  A scan holds its disk's lock; a second one meanwhile is refused.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mime_type
from ..operators import ledger
from ..operators.changes import CHANGED, NEW, UNCHANGED, UNSEEN, match_listing
from ..operators.disks import upsert_disks
from ..operators.maintained import signed
from ..operators.hashing import HashPolicy, hash_files, spread_by_bytes
from ..schemas import FILES, SCAN_ERRORS
from ..sources.catalog import Catalog, Seen
from ..sources.filetree import existing_root, list_tree

# bytes to read per hashing task, and per committed portion
_TASK_BYTES = 256 * 1024 * 1024
_PORTION_BYTES = 1024**4


@dataclass(frozen=True)
class Volume:
    """What the operating system says about a disk."""

    serial: str
    label: str | None = None
    filesystem: str | None = None
    total_bytes: int | None = None


@dataclass(frozen=True)
class ScanResult:
    scan_id: int
    disk_id: int
    files_scanned: int
    files_failed: int


def scan(
    catalog: Catalog,
    root: str,
    volume: Volume,
    mode: str = "sampled",
    policy: HashPolicy | None = None,
    portion_bytes: int = _PORTION_BYTES,
    now: datetime | None = None,
) -> ScanResult:
    """Brings the catalog up to date with the tree under ``root``.

    Raises ``Busy`` if another scan of the disk is at work.
    """
    policy = policy or HashPolicy(mode)
    root = existing_root(root)
    now = now or datetime.now(timezone.utc)

    disk_id = _known_disk(catalog, volume, _at(now))
    with catalog.lock(f"disk={disk_id}", wait=0.0):
        return _scan(catalog, root, disk_id, policy, portion_bytes, now, catalog.take_over(disk_id))


def _at(now: datetime) -> Column:
    return F.lit(now.isoformat()).cast("timestamp")


def _scan(catalog: Catalog, root: str, disk_id: int, policy: HashPolicy, portion_bytes: int, now: datetime, fence: int) -> ScanResult:
    # no live scan of the disk is left besides this one
    at = _at(now)
    stale = [_Run(catalog, scan_id, disk_id, now, below, fence) for scan_id, below in _running(catalog, disk_id)]
    for run in stale:
        run.settle()
    scan_id = _opened(catalog, disk_id, root, at)
    for run in stale:
        run.clear()
    run = _Run(catalog, scan_id, disk_id, now, root, fence)
    run.clear()  # left by a catalog that was here before, if anything
    try:
        run.list()
        run.hash(policy, portion_bytes)
        scanned, failed = run.settle()
    except BaseException as exc:
        status = ledger.INTERRUPTED if isinstance(exc, KeyboardInterrupt) else ledger.FAILED
        try:
            counts = run.settle()
        except Exception:  # what could not be entered does not hide what went wrong
            counts = 0, 0
        run.close(*counts, status)
        raise
    run.close(scanned, failed, ledger.COMPLETED)
    # the base before stays for whoever is still reading it
    catalog.drop_old_versions(keep=2)
    catalog.pack_errors()
    return ScanResult(scan_id, disk_id, scanned, failed)


def _opened(catalog: Catalog, disk_id: int, root: str, at: Column) -> int:
    """Enters a running scan under the next free id; scans that died become interrupted."""
    ids = []

    def opened(scans: DataFrame) -> DataFrame:
        ids.append(1 + (scans.agg(F.max("scan_id")).first()[0] or 0))
        return ledger.open_scan(ledger.close_stale(scans, disk_id, at), ids[0], disk_id, root, at)

    catalog.update("scans", opened)
    return ids[0]


def _known_disk(catalog: Catalog, volume: Volume, at) -> int:
    facts = catalog.spark.createDataFrame(
        [(volume.serial, volume.label, volume.filesystem, volume.total_bytes)],
        "volume_serial string, label string, filesystem string, total_bytes long",
    )
    disks = catalog.update("disks", lambda disks: upsert_disks(disks, facts, at))
    return disks.where(F.col("volume_serial") == volume.serial).first()["disk_id"]


def _running(catalog: Catalog, disk_id: int) -> list[tuple[int, str]]:
    """Scans of the disk that never ended, and their roots: one, unless several ran at once."""
    open_ = catalog.scans().where((F.col("disk_id") == disk_id) & (F.col("status") == ledger.RUNNING))
    return [tuple(row) for row in open_.select("scan_id", "root_path").orderBy("scan_id").collect()]


def _portion(portions: int) -> Column:
    return F.pmod(F.xxhash64("path"), F.lit(portions))


class _Run:
    """The staged tables of one scan."""

    def __init__(self, catalog: Catalog, scan_id: int, disk_id: int, now: datetime | None, root: str = "", fence: int | None = None) -> None:
        self.catalog, self.scan_id, self.disk_id, self.fence = catalog, scan_id, disk_id, fence
        self.root, self.now, self.at = root, now, None if now is None else _at(now)
        self.spark = catalog.spark
        self.staging = f"{catalog.root}/_staging/scan_id={scan_id}"

    @property
    def below(self) -> str:
        """What the paths of all files under the root begin with."""
        return self.root.rstrip(os.sep) + os.sep

    def list(self) -> None:
        """Stages the listing, and beside it the match with that part of the catalog."""
        found = list_tree(self.spark, self.root, f"{self.staging}/walk")
        found.write.parquet(f"{self.staging}/listing")
        listing = (
            self._staged("listing")
            .where(F.col("error_message").isNull())
            .drop("error_message")
            .withColumns(
                {
                    "disk_id": F.lit(self.disk_id).cast("long"),
                    "scan_id": F.lit(self.scan_id).cast("long"),
                    "mime_type": mime_type("filename"),
                    "last_seen": self.at,
                }
            )
        )
        known = self.catalog.stored_files(self.disk_id).where(F.startswith("path", F.lit(self.below)))
        matched = match_listing(listing, known)
        matched.write.parquet(f"{self.staging}/matched")

    def hash(self, policy: HashPolicy, portion_bytes: int) -> None:
        """Hashes new and changed files, portion by portion.

        What is to be hashed is written once, a folder for each portion, with only
        the columns of the new rows; a portion reads its own folder and is spread
        over tasks by the bytes to read.
        """
        kept = [c for c in FILES.fieldNames() if c not in ("hash", "hash_algo")]
        todo = self._staged("matched").where(F.col("change_kind").isin(NEW, CHANGED)).select(*kept)
        if policy.mode == "none":
            hash_files(todo, policy).write.parquet(f"{self.staging}/hashed/of=1/portion=000000")
            return
        to_read = policy.to_read(F.col("size_bytes"))
        total = todo.agg(F.sum(to_read)).first()[0]
        if total is None:
            return
        portions = max(1, -(-total // portion_bytes))
        of = todo.withColumn("portion", _portion(portions)).hint("rebalance", "portion")
        of.write.partitionBy("portion").parquet(f"{self.staging}/todo")
        task_bytes = max(1, min(_TASK_BYTES, -(-total // portions // self.spark.sparkContext.defaultParallelism)))
        for n in range(portions):
            folder = f"{self.staging}/todo/portion={n}"
            if self.catalog.folders.matching(folder):
                some = self.spark.read.schema(todo.schema).parquet(folder)
                spread = spread_by_bytes(some, to_read, task_bytes)
                hash_files(spread, policy).write.parquet(f"{self.staging}/hashed/of={portions}/portion={n:06d}")

    def settle(self) -> tuple[int, int]:
        """Enters what is staged into the catalog; gives files and errors.

        A file gets a new row if it was hashed, or is unchanged but for what the listing
        says of it otherwise.  Files that were seen and are as they were get a mark.  Of
        the others the row in the catalog, if there is one, stays as it is: frozen.
        """
        listing, matched = self._staged("listing"), self._staged("matched")
        hashed, undone = self._hashed()
        errors = [] if listing is None else [listing.where(F.col("error_message").isNotNull())]
        kind, names = F.col("change_kind"), FILES.fieldNames()
        fresh, kept = [], []
        if hashed is not None:
            good, bad = ledger.split_errors(hashed)
            fresh.append(good.select(*names))
            if matched is not None:
                kept.append(matched.where(kind.isin(NEW, CHANGED)).join(bad.select("path"), "path", "left_semi"))
            errors.append(bad)
        failed = self._enter_errors(errors)
        if matched is None:
            return 0, failed
        stored = {c: F.col(f"old.{c}") for c in ("hash", "hash_algo")}
        frozen = F.coalesce("old.frozen", F.lit(False))
        differs = [~F.col(c).eqNullSafe(F.col(f"old.{c}")) for c in ("filename", "extension", "created_date", "mime_type")]
        unchanged = matched.where(kind == UNCHANGED)
        fresh.append(unchanged.where(reduce(or_, differs, frozen)).withColumns(stored).select(*names))
        kept.append(matched.where((kind == UNSEEN) | (kind.isin(NEW, CHANGED) & undone)))
        rows = [r.withColumn("frozen", F.lit(False)) for r in fresh]
        rows += [k.where(F.col("old").isNotNull() & ~frozen).select("old.*").select(*names).withColumn("frozen", F.lit(True)) for k in kept]
        seen = Seen(self.scan_id, self.below, self.now)
        if hashed is not None:
            was = matched.where(kind == CHANGED).join(good.select("path"), "path", "left_semi").select("old.*")
            changes = signed(good, 1).unionByName(signed(was, -1))
        else:
            changes = signed(matched.limit(0).select("old.*"), 1)
        self.catalog.add_changes(self.disk_id, reduce(DataFrame.unionByName, rows), seen, self.fence, changes)
        return unchanged.count() + (0 if hashed is None else good.count()), failed

    def _hashed(self) -> tuple[DataFrame | None, Column]:
        """Rows of finished portions, and a test for rows of the others."""
        done = self.catalog.folders.committed(f"{self.staging}/hashed/of=*/portion=*")
        if not done:
            return None, F.lit(True)
        portions = int(re.search(r"of=(\d+)", done[0]).group(1))
        numbers = [int(folder.rsplit("=", 1)[1]) for folder in done]
        undone = F.lit(False) if len(numbers) == portions else ~_portion(portions).isin(numbers)
        return self.spark.read.parquet(*done), undone

    def _enter_errors(self, errors: list[DataFrame]) -> int:
        if not errors:
            return 0
        names = SCAN_ERRORS.fieldNames()
        extra = {"scan_id": F.lit(self.scan_id).cast("long"), "occurred_at": self.at}
        rows = errors[0].withColumns(extra).select(*names)
        for more in errors[1:]:
            rows = rows.unionByName(more.withColumns(extra).select(*names))
        self.catalog.replace_errors(self.scan_id, rows)
        return rows.count()

    def close(self, scanned: int, failed: int, status: str) -> None:
        self.catalog.update("scans", lambda scans: ledger.finish_scan(scans, self.scan_id, scanned, failed, self.at, status))
        self.clear()

    def clear(self) -> None:
        """Drops the staged tables, once the catalog and the ledger are written."""
        self.catalog.folders.remove(self.staging)

    def _staged(self, table: str) -> DataFrame | None:
        done = self.catalog.folders.committed(f"{self.staging}/{table}")
        return self.spark.read.parquet(*done) if done else None
