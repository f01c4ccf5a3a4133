"""Times the headline queries, queries on a stored catalog, and scans; prints one JSON line.

BENCH_SF_DIR: table folder (default /root/testdata/sf0.1); BENCH_CPUS: cores
(default 8); BENCH_RUNS: timed runs per query, of which the median counts;
BENCH_FILES: files of the tree that is scanned (default 100,000).
Every query is run once beforehand and its whole result is computed.  A scan and
the scan of the unchanged tree after it are timed once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import functions as F

from shelfmark.operators import folders, search
from shelfmark.plans import tables
from shelfmark.plans.queries import QUERIES
from shelfmark.plans.scan import Volume, scan
from shelfmark.schemas import FILES
from shelfmark.session import local_session
from shelfmark.sources.catalog import Catalog

HEADLINE = (
    "duplicates_found",
    "duplicate_members",
    "folder_rollup",
    "search_combined",
    "search_everything",
    "category_facets",
    "disk_stats",
    "browse_folders",
    "browse_root_folders",
    "path_known",
    "change_kinds",
    "catalog_upsert",
    "upsert_last_wins",
    "hash_modes",
    "blake2b_groups",
    "scan_counts",
    "disk_patch",
    "report_rows",
    "report_widths",
    "snapshot_keep",
)


def seconds(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def whole(rows) -> None:
    rows.write.format("noop").mode("overwrite").save()


def stored(spark, sf_dir: str, root: str) -> dict:
    """Queries on files that ``replace_files`` has written, as they meet them in use."""
    catalog = Catalog(spark, root)
    rows = tables.files_orders(spark, sf_dir).select(*FILES.fieldNames())
    for disk in range(1, 5):
        part = rows.where(F.col("disk_id") == disk)
        catalog.replace_files(disk, 1, part, part.count())
    some = catalog.files().where("hash is not null").agg(F.min("hash")).first()[0]
    return {
        "stored_browse": lambda: whole(folders.browse_folders(catalog.files(), 2, "E:\\Orders")),
        "stored_hash_lookup": lambda: whole(search.files_for_hash(catalog.files(), some)),
        "stored_disk_filter": lambda: whole(catalog.files(3)),
    }


def tree(root: str, files: int) -> None:
    for n in range(files):
        folder = os.path.join(root, f"d{n % 31}", f"e{n // 31 % 37}")
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, f"f{n}.txt"), "w") as out:
            out.write(f"content {n // 2}\n" * (1 + n % 40))


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    files = int(os.environ.get("BENCH_FILES", "100000"))
    spark = local_session("bench", cpus)
    times, rates = {}, {}
    with tempfile.TemporaryDirectory(prefix="bench-") as scratch:
        jobs = {n: lambda q=QUERIES[n]: whole(q(spark, sf_dir)) for n in names or HEADLINE}
        if not names:
            jobs |= stored(spark, sf_dir, f"{scratch}/stored")
        for name, run in jobs.items():
            run()
            times[name] = round(statistics.median(seconds(run) for _ in range(runs)), 4)
        if not names:
            tree(f"{scratch}/tree", files)
            catalog = Catalog(spark, f"{scratch}/catalog")
            for name in ("scan", "rescan_unchanged"):
                times[name] = round(seconds(lambda: scan(catalog, f"{scratch}/tree", Volume("bench"))), 4)
                rates[name] = round(files / times[name])
    print(
        json.dumps(
            {
                "metric": "total of median query times",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": times,
                "files_per_second": rates,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
