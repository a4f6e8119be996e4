"""Stored tables: monthly partitions, sorted for row-group skipping, replayable appends."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.schema import EVENTS_SCHEMA, LINEAGE_COLUMNS

# Sort order of the rows in each file; filters on these skip parquet row groups.
SORT = {
    "events": ["website_id", "timestamp"],
    "raw_events": ["website_id", "timestamp"],
    "bad_events": ["timestamp"],
}


# SQL defaults by type name; numbers are 0.
_DEFAULTS = {"string": "''", "array": "array()", "map": "map()", "timestamp": "NULL"}


def with_month(df: DataFrame, column: str = "timestamp") -> DataFrame:
    return df.withColumn("event_month", F.date_format(column, "yyyyMM"))


def conform(events: DataFrame, extra: Sequence[Column] = ()) -> DataFrame:
    """Exactly the event columns, in order and type, without NULLs, plus lineage columns."""
    present = set(events.columns)
    out = []
    for field in EVENTS_SCHEMA.fields:
        kind = field.dataType.simpleString()
        default = f"CAST({_DEFAULTS.get(field.dataType.typeName(), '0')} AS {kind})"
        if field.name in present:
            out.append(f"coalesce(CAST({field.name} AS {kind}), {default}) AS {field.name}")
        else:
            out.append(f"{default} AS {field.name}")
    lineage = [c for c in LINEAGE_COLUMNS if c in present]
    return events.select(*[F.expr(e) for e in out], *lineage, *extra)


def append(df: DataFrame, path: str, table: str) -> None:
    """Append rows to a monthly partitioned table.

    The rebalance hint lets adaptive execution size the writing tasks: a month with most
    of the rows is split over many of them, small months share one.
    """
    with_month(df).hint("rebalance", F.col("event_month")).sortWithinPartitions(
        "event_month", *SORT[table]
    ).write.mode("append").partitionBy("event_month").parquet(path)


def write_events(events: DataFrame, path: str) -> None:
    append(conform(events), path, "events")


def write_raw(raw: DataFrame, path: str) -> None:
    append(raw, path, "raw_events")


def write_bad(bad: DataFrame, path: str) -> None:
    append(bad, path, "bad_events")


def write_rollup(rollup: DataFrame, path: str) -> None:
    """Replace the dates present in `rollup`, keep all other dates of the stored table."""
    (
        rollup.hint("rebalance", F.col("date"))
        .sortWithinPartitions("date", "website_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(path)
    )


# --- folders -----------------------------------------------------------------


def _file_system(spark: SparkSession, path: str):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    root, fs = _file_system(spark, path)
    return fs.exists(root)


def delete(spark: SparkSession, path: str) -> None:
    root, fs = _file_system(spark, path)
    fs.delete(root, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    root, fs = _file_system(spark, source)
    if not fs.rename(root, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"cannot move {source} to {target}")


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all."""
    root, fs = _file_system(spark, path)
    half = root.suffix(".half")
    out = fs.create(half, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(root, False)
    if not fs.rename(half, root):
        raise OSError(f"cannot write {path}")


def folders(spark: SparkSession, path: str, column: str) -> dict[str, object]:
    """Partition value -> folder; a listing of folders, not of data."""
    root, fs = _file_system(spark, path)
    found = {}
    for status in fs.listStatus(root) if fs.exists(root) else ():
        name = status.getPath().getName()
        if name.startswith(f"{column}="):
            found[name.split("=", 1)[1]] = status.getPath()
    return found


@contextmanager
def staged(df: DataFrame, out: str, batch_id: int, name: str = "batch") -> Iterator[DataFrame]:
    """`df` stored once for several readers; the folder goes when they are done.

    A repeated batch overwrites what a killed one left.
    """
    path = f"{out}/_staging/{name}-{batch_id}"
    df.write.mode("overwrite").parquet(path)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        delete(df.sparkSession, path)


# --- dimensions --------------------------------------------------------------


def read_websites(
    spark: SparkSession, path: str | None = None, jdbc: Mapping[str, str] | None = None
) -> DataFrame:
    """The website register, from parquet or from the application database by JDBC."""
    return _dimension(spark, path, {"dbtable": "websites", **jdbc} if jdbc else None)


def read_api_keys(
    spark: SparkSession, path: str | None = None, jdbc: Mapping[str, str] | None = None
) -> DataFrame:
    return _dimension(spark, path, {"dbtable": "api_keys", **jdbc} if jdbc else None)


def _dimension(spark: SparkSession, path: str | None, jdbc: Mapping[str, str] | None) -> DataFrame:
    if (path is None) == (jdbc is None):
        raise ValueError("give either a path or JDBC options")
    if path is not None:
        return spark.read.parquet(path)
    return spark.read.format("jdbc").options(**jdbc).load()
