"""Explicit schemas of the four catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_L, _S, _TS = T.LongType(), T.StringType(), T.TimestampType()


def _table(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


DISKS_V1 = _table(
    ("disk_id", _L, False),
    ("volume_serial", _S, False),
    ("label", _S, True),
    ("filesystem", _S, True),
    ("total_bytes", _L, True),
    ("first_seen", _TS, False),
    ("last_scanned", _TS, True),
)

# version 2 added the description
DISKS = T.StructType(DISKS_V1.fields + [T.StructField("description", _S, True)])

SCANS = _table(
    ("scan_id", _L, False),
    ("disk_id", _L, False),
    ("root_path", _S, False),
    ("started_at", _TS, False),
    ("finished_at", _TS, True),
    ("status", _S, False),
    ("files_scanned", _L, False),
    ("files_failed", _L, False),
)

# key: (disk_id, path)
FILES = _table(
    ("disk_id", _L, False),
    ("scan_id", _L, False),
    ("path", _S, False),
    ("filename", _S, False),
    ("extension", _S, True),
    ("size_bytes", _L, False),
    ("created_date", _TS, True),
    ("modified_date", _TS, True),
    ("hash", _S, True),
    ("hash_algo", _S, True),
    ("mime_type", _S, True),
    ("last_seen", _TS, False),
)

SCAN_ERRORS = _table(
    ("scan_id", _L, False),
    ("path", _S, True),
    ("error_message", _S, True),
    ("occurred_at", _TS, False),
)

FILE_KEY = ["disk_id", "path"]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Read a table written under an older schema version as ``schema``.

    Columns the older version lacked become NULL; the rest keep their own type
    where it is one of the two timestamp types, so that both are accepted.
    """
    have = {f.name: f.dataType for f in df.schema.fields}

    def pick(field: T.StructField):
        if field.name not in have:
            return F.lit(None).cast(field.dataType).alias(field.name)
        if isinstance(have[field.name], (T.TimestampType, T.TimestampNTZType)):
            return F.col(field.name)
        return F.col(field.name).cast(field.dataType).alias(field.name)

    return df.select(*[pick(f) for f in schema.fields])
