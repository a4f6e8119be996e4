import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from trailmark.session import local_session  # noqa: E402

SAMPLE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return local_session(8, 4, checkpoint_dir=str(tmp_path_factory.mktemp("shared")))


@pytest.fixture
def make_events(spark):
    """Events from dicts; missing columns get their defaults."""
    from pyspark.sql import functions as F

    from trailmark.sources.tables import conform

    def build(rows):
        names = sorted({k for r in rows for k in r})
        data = [tuple(r.get(n) for n in names) for r in rows]
        types = {"timestamp": "string", "event_id": "long", "value": "double", "tax": "double",
                 "scroll_depth": "int", "lcp_value": "double", "cls_value": "double",
                 "event_value": "double"}
        schema = ", ".join(f"{n} {types.get(n, 'string')}" for n in names)
        df = spark.createDataFrame(data, schema)
        return conform(df.withColumn("timestamp", F.col("timestamp").cast("timestamp")))

    return build


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
