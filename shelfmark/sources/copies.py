"""Dated copies of a catalog that share what has not changed.

A folder of files never changes once it counts, so a copy is a list of folders.  A copy
brings over the folders that no earlier one has, and the small tables; of a catalog that
has not changed since the last copy it writes no row of a file.  A folder goes when the
last copy that names it goes::

    target/files/disk_id=D/mark=M/version=N   target/rollup/...   target/hashes/...
    target/copies/<stamp>/{disks,scans,scan_errors,manifest.json}

A copy counts once its manifest is there, which is written last.  Whoever copies or drops
holds the target's lock.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame, SparkSession

from ..operators.snapshots import KEEP
from .catalog import Catalog, Folders, _stamp
from .locks import Lock


def _mark(entry: dict) -> str:
    """Tells a folder from another of the same number: names of data files are unique."""
    return f"{zlib.crc32('/'.join(f['name'] for f in entry['files']).encode()):08x}"


def _data(disk: str, entry: dict) -> str:
    return f"files/disk_id={disk}/mark={_mark(entry)}/version={entry['folder'].rsplit('=', 1)[1]}"


def copy_shared(catalog: Catalog, target: str, keep: int = KEEP, stamp: str | None = None) -> str:
    """Adds a copy of all tables to ``target``; keeps the newest ``keep``.  Gives its stamp."""
    stamp = stamp or _stamp(catalog.spark)
    with Lock(catalog.spark, f"{target}/_locks/copies"):
        manifest = catalog.manifests.newest()
        for disk, state in manifest["disks"].items():
            # an index of names holds names of the original's data files
            state["names"] = None
            for entry in (state["base"], *state["changes"]):
                folder = _data(disk, entry)
                _bring(catalog, entry["folder"], f"{target}/{folder}")
                entry["folder"] = folder
            for kind in ("rollup", "hashes") if state.get("totals") else ():
                brought = []
                for source in state["totals"][kind]:
                    folder = "/".join([kind, *source.rsplit("/", 2)[1:]])
                    _bring(catalog, source, f"{target}/{folder}")
                    brought.append(folder)
                state["totals"][kind] = brought
        here = f"{target}/copies/{stamp}"
        for name, rows in {"disks": catalog.disks(), "scans": catalog.scans(), "scan_errors": catalog.errors()}.items():
            rows.write.mode("overwrite").parquet(f"{here}/{name}")
        _write(catalog.spark, f"{here}/manifest.json", manifest)
        _drop_old(catalog.folders, catalog.spark, target, keep)
    return stamp


def _bring(catalog: Catalog, source: str, folder: str) -> None:
    if not catalog.folders.committed(folder):
        # sorted as it is, part by part; what a copy that died left is written anew
        catalog.spark.read.parquet(source).write.mode("overwrite").parquet(folder)


def copies(spark: SparkSession, target: str) -> list[str]:
    """Stamps of the copies there are, oldest first."""
    return [f.rsplit("/", 2)[1] for f in Folders(spark).matching(f"{target}/copies/*/manifest.json")]


def files_of_copy(spark: SparkSession, target: str, stamp: str, disk_id: int | None = None) -> DataFrame:
    """The files table as it was when the copy was made."""
    state = _read(spark, f"{target}/copies/{stamp}/manifest.json")
    return Catalog(spark, target).files(disk_id, _placed(state, target))


def _placed(manifest: dict, target: str) -> dict:
    """A copy's manifest with whole paths."""
    for state in manifest["disks"].values():
        for entry in (state["base"], *state["changes"]):
            entry["folder"] = f"{target}/{entry['folder']}"
        # a copied folder has other data files than the original, so it is read whole
        state["base"]["files"] = []
    return manifest


def drop_old_copies(catalog: Catalog, target: str, keep: int = KEEP) -> list[str]:
    """Removes all but the newest ``keep`` copies, and folders that none of those names."""
    with Lock(catalog.spark, f"{target}/_locks/copies"):
        return _drop_old(catalog.folders, catalog.spark, target, keep)


def _drop_old(folders: Folders, spark: SparkSession, target: str, keep: int) -> list[str]:
    stamps = copies(spark, target)
    gone = stamps[: max(len(stamps) - keep, 0)]
    # those a process that died left unfinished have no manifest
    every = [f.rsplit("/", 1)[1] for f in folders.matching(f"{target}/copies/*")]
    removed = [s for s in every if s not in stamps or s in gone]
    for stamp in removed:
        folders.remove(f"{target}/copies/{stamp}")
    named = set()
    for stamp in copies(spark, target):
        for state in _read(spark, f"{target}/copies/{stamp}/manifest.json")["disks"].values():
            named |= {e["folder"] for e in (state["base"], *state["changes"])}
            named |= {f for kind in ("rollup", "hashes") if state.get("totals") for f in state["totals"][kind]}
    for pattern in ("files/*/*/*", "rollup/*/*", "hashes/*/*"):
        for folder in folders.matching(f"{target}/{pattern}"):
            if "/".join(folder.rsplit("/", pattern.count("/") + 1)[1:]) not in named:
                folders.remove(folder)
    return removed


def _write(spark: SparkSession, path: str, manifest: dict) -> None:
    """Written aside and renamed, so that it is there whole or not at all."""
    jvm = spark.sparkContext._jvm
    target, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.tmp"))
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = files.create(aside, True)
    stream.write(json.dumps(manifest).encode())
    stream.close()
    files.rename(aside, target)


def _read(spark: SparkSession, path: str) -> dict:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
