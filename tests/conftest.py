import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shelfmark import schemas  # noqa: E402
from shelfmark.session import local_session  # noqa: E402

UTC = dt.timezone.utc


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = local_session("tests", "4", "4g", **{"spark.checkpoint.dir": str(folder)})
    yield session
    session.stop()


def at(text="2024-05-01T00:00:00"):
    return dt.datetime.fromisoformat(text).replace(tzinfo=UTC)


@pytest.fixture
def make_files(spark):
    """Files table from (disk_id, path, size, hash) or dicts of further columns."""

    def build(*rows, sep="\\"):
        full = []
        for row in rows:
            given = dict(zip(("disk_id", "path", "size_bytes", "hash"), row)) if isinstance(row, tuple) else dict(row)
            name = given["path"].rsplit(sep, 1)[-1]
            dot = name.rfind(".")
            base = {
                "scan_id": 1,
                "filename": name,
                "extension": name[dot:].lower() if dot > 0 else "",
                "size_bytes": 0,
                "created_date": at(),
                "modified_date": at(),
                "hash": None,
                "hash_algo": None,
                "mime_type": None,
                "last_seen": at(),
            }
            full.append({**base, **given})
        names = schemas.FILES.fieldNames()
        return spark.createDataFrame([tuple(r[n] for n in names) for r in full], schemas.FILES)

    return build


@pytest.fixture
def make_disks(spark):
    def build(*rows):
        names = schemas.DISKS.fieldNames()
        base = dict.fromkeys(names) | {"first_seen": at()}
        return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], schemas.DISKS)

    return build


def plan_of(df):
    """The formatted physical plan as text."""
    python = df.sparkSession.sparkContext._jvm.PythonSQLUtils
    return python.explainString(df._jdf.queryExecution(), "formatted")
