"""Catalog tables stated over the given Parquet tables.

Each is a projection of a whole table, so a query's work grows with the data.
``references.py`` states the same tables in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import mime_type, suffix
from ..schemas import FILES

# one suffix per document, by doc_id
SUFFIXES = (
    ".jpg", ".TXT", ".pdf", ".epub", ".mp4", ".mp3", ".zip",
    ".py", ".xlsx", "", ".xyz123", ".pptx", ".exe", ".tar.gz",
)


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is looked up once, as that takes a job."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def _after(start: str, seconds: Column) -> Column:
    begin = F.lit(start).cast("timestamp_ntz")
    return begin + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def pick(options: tuple[str, ...], n: Column) -> Column:
    """Option number n mod their count."""
    return F.get(F.array(*[F.lit(o) for o in options]), F.pmod(n, F.lit(len(options))).cast("int"))


def files(spark: SparkSession, sf_dir: str, content: bool = False) -> DataFrame:
    """One file per document; its content is the text."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), pick(SUFFIXES, F.col("doc_id")))
    hashed = F.col("doc_id") % 11 != 0
    d = d.withColumn("filename", name)
    values = {
        "disk_id": 1 + F.col("doc_id") % 3,
        "scan_id": 1 + F.col("doc_id") % 2,
        "path": F.concat(F.lit("D:\\Archive\\"), "source", F.lit("\\"), "lang", F.lit("\\"), "filename"),
        "filename": F.col("filename"),
        "extension": suffix("filename"),
        "size_bytes": F.octet_length("text").cast("long"),
        "created_date": _after("2023-01-01", F.col("doc_id") * 3701),
        "modified_date": _after("2024-01-01", F.col("doc_id") * 3701),
        "hash": F.when(hashed, F.sha2(F.encode("text", "UTF-8"), 256)),
        "hash_algo": F.when(hashed, F.lit("sha256")),
        "mime_type": mime_type("filename"),
        "last_seen": _after("2024-03-01", F.col("doc_id")),
    }
    out = [v.alias(c) for c, v in values.items()]
    if content:
        out.append(F.encode("text", "UTF-8").alias("content"))
    return d.select("doc_id", *out)


def files_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per order: many folders, many duplicate groups; every seventh a text."""
    o = table(spark, sf_dir, "orders")
    plain = F.col("o_orderkey") % 7 == 0
    ending = F.when(plain, F.lit(".txt")).otherwise(F.lit(".pdf"))
    name = F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"), ending)
    when = F.col("o_orderdate")
    month = F.lpad(F.month(when).cast("string"), 2, "0")
    folder = F.concat(F.lit("E:\\Orders\\"), F.year(when).cast("string"), F.lit("\\"), month, F.lit("\\"))
    content = F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderpriority")
    values = {
        "disk_id": 1 + F.col("o_custkey") % 4,
        "scan_id": 1 + F.col("o_custkey") % 50,
        "path": F.concat(folder, name),
        "filename": name,
        "extension": ending,
        "size_bytes": F.col("o_custkey") * F.col("o_custkey") * 1009,
        "created_date": when,
        "modified_date": when,
        "hash": F.md5(content.cast("binary")),
        "hash_algo": F.lit("md5"),
        "mime_type": F.when(plain, F.lit("text/plain")).otherwise(F.lit("application/pdf")),
        "last_seen": when,
    }
    return o.select(*[v.alias(c) for c, v in values.items()])


def batch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item; a (disk, path) may come several times."""
    li = table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey")
    return li.select(
        (1 + key % 3).alias("disk_id"),
        F.concat(
            F.lit("F:\\li\\"), key.cast("string"), F.lit("\\"), F.col("l_linenumber").cast("string"), F.lit(".dat")
        ).alias("path"),
        F.col("l_quantity").cast("long").alias("size_bytes"),
        F.col("l_shipdate").alias("last_seen"),
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
    )


def incoming_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``batch_files`` as rows of the files table: keys repeat."""
    name = F.substring_index("path", "\\", -1)
    known = {"scan_id": F.col("l_suppkey"), "filename": name, "extension": F.lit(".dat"), "created_date": F.col("last_seen")}
    known |= {"modified_date": F.col("last_seen"), "hash": F.col("l_partkey").cast("string"), "hash_algo": F.lit("none")}
    rows = batch_files(spark, sf_dir).withColumns({**known, "mime_type": F.lit(None).cast("string")})
    return rows.select(*FILES.fieldNames())


def earlier_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog from before: a file per order, some of which the batch brings again."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    values = {
        "disk_id": 1 + key % 3,
        "scan_id": F.lit(0).cast("long"),
        "path": F.concat(F.lit("F:\\li\\"), key.cast("string"), F.lit("\\1.dat")),
        "filename": F.lit("1.dat"),
        "extension": F.lit(".dat"),
        "size_bytes": F.lit(0).cast("long"),
        "created_date": F.col("o_orderdate"),
        "modified_date": F.col("o_orderdate"),
        "hash": F.lit(None).cast("string"),
        "hash_algo": F.lit(None).cast("string"),
        "mime_type": F.lit(None).cast("string"),
        "last_seen": F.col("o_orderdate"),
    }
    return o.select(*[v.alias(c) for c, v in values.items()])


def prior_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier state of ``files``: some moved since, some grown, some equal."""
    id_ = F.col("doc_id")
    earlier = {
        "path": F.when(id_ % 9 == 0, F.replace("path", F.lit("D:\\Archive\\"), F.lit("D:\\Gone\\"))).otherwise(
            F.col("path")
        ),
        "size_bytes": F.col("size_bytes") + F.when(id_ % 7 == 0, 1).otherwise(0),
        "hash": F.concat(F.lit("kept:"), "hash"),
        "scan_id": F.lit(1).cast("long"),
    }
    return files(spark, sf_dir).withColumns(earlier).select(*FILES.fieldNames())


def rescanned_files(spark: SparkSession, sf_dir: str, content: bool = False) -> DataFrame:
    """``files`` as the next scan lists them."""
    names = FILES.fieldNames() + (["content"] if content else [])
    return files(spark, sf_dir, content).withColumn("scan_id", F.lit(2).cast("long")).select(*names)


def serial(n: Column) -> Column:
    return F.lpad(F.hex(n), 16, "0")


def disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One disk per supplier; most hold no files."""
    key = F.col("s_suppkey")
    nation = F.col("s_nationkey")
    return table(spark, sf_dir, "supplier").select(
        (key + 1).alias("disk_id"),
        serial(key).alias("volume_serial"),
        F.when(key % 5 == 3, F.lit("")).when(key % 5 != 4, F.col("s_name")).alias("label"),
        pick(("NTFS", "exFAT", "FAT32"), key).alias("filesystem"),
        ((key + 1) * 1_000_000_007).alias("total_bytes"),
        _after("2023-01-01", key * 86400).alias("first_seen"),
        F.when(key % 3 != 0, _after("2023-02-01", key * 86400)).alias("last_scanned"),
        F.when(nation % 2 == 0, F.concat(F.lit("rack "), nation.cast("string"))).alias("description"),
    )


def disks_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same disks as the first schema version had them."""
    return disks(spark, sf_dir).drop("description")


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes met by scans, one per customer; the first ones are known disks."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        serial(key).alias("volume_serial"),
        F.col("c_name").alias("label"),
        F.when(key % 4 != 0, F.col("c_mktsegment")).alias("filesystem"),
        (key * 1_000_003).alias("total_bytes"),
    )


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disk edits, one per order: several per disk, some for unknown disks."""
    key = F.col("o_orderkey")
    label = F.concat(F.lit(" \t\u00a0disk "), key.cast("string"), F.lit("\u2003 \n"))
    return table(spark, sf_dir, "orders").select(
        key.alias("seq"),
        (1 + F.col("o_custkey")).alias("disk_id"),
        F.when(key % 5 == 0, F.lit("")).when(key % 5 <= 2, label).alias("label"),
        F.when(key % 7 == 0, F.lit("")).when(key % 7 <= 3, F.col("o_orderpriority")).alias("description"),
    )


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan per order."""
    started = F.col("o_orderdate")
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        (1 + F.col("o_orderkey")).alias("scan_id"),
        (1 + F.col("o_custkey") % 40).alias("disk_id"),
        F.concat(F.lit("E:\\Orders\\"), F.year(started).cast("string")).alias("root_path"),
        started.alias("started_at"),
        F.when(status != "O", started + F.expr("INTERVAL '1' HOUR")).alias("finished_at"),
        F.when(status == "O", "running").when(status == "F", "completed").otherwise("failed").alias("status"),
        F.col("o_custkey").alias("files_scanned"),
        (F.col("o_custkey") % 3).alias("files_failed"),
    )


def listing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What listing a tree yields, one row per event; error events are errors."""
    return table(spark, sf_dir, "events").select(
        (1 + F.col("user_id") % 60).alias("scan_id"),
        F.concat(F.lit("G:\\events\\"), F.col("event_id").cast("string")).alias("path"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("unreadable "), "props")).alias("error_message"),
        F.col("ts").alias("occurred_at"),
    )


def files_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log file per event, all of them in one folder of two disks."""
    name = F.concat(F.col("event_type"), F.lit("_"), F.col("event_id").cast("string"), F.lit(".log"))
    return table(spark, sf_dir, "events").select(
        (1 + F.col("event_id") % 2).alias("disk_id"),
        F.concat(F.lit("\\\\server\\share\\logs\\"), name).alias("path"),
        F.lit(".log").alias("extension"),
        (F.col("user_id") * 1000).alias("size_bytes"),
        F.col("ts").alias("modified_date"),
        F.md5(F.col("props").cast("binary")).alias("hash"),
    )


def requested_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths asked for, one per document; a quarter of them are not catalogued."""
    wrong = F.replace("path", F.lit("D:\\Archive\\"), F.lit("D:\\Missing\\"))
    return files(spark, sf_dir).select(
        F.when(F.col("doc_id") % 4 == 0, wrong).otherwise(F.col("path")).alias("path")
    )
