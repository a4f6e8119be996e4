"""Reading posted payloads, as a batch or a stream.

Each input line is a JSON text `{"body": "<posted text>", "ip": ..., "user_agent": ...,
"ingest_time": ...}` as a collector log writes it. `body` stays text: it is parsed by the
validation step, which must see broken bodies too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.schema import PAYLOAD_SCHEMA


def _complete(lines: DataFrame) -> DataFrame:
    """Lines that are no JSON record become a body of their own, to be rejected later."""
    record = F.from_json("value", PAYLOAD_SCHEMA)
    return lines.select(record.alias("r"), "value").select(
        F.coalesce("r.body", "value").alias("body"),
        F.coalesce("r.ip", F.lit("")).alias("ip"),
        F.coalesce("r.user_agent", F.lit("")).alias("user_agent"),
        F.coalesce("r.ingest_time", F.current_timestamp()).alias("ingest_time"),
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    return _complete(spark.read.text(path))


def stream_payloads(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _complete(reader.text(path))


def write_payloads(payloads: DataFrame, path: str) -> None:
    """Store payload rows in the line format read above."""
    columns = ["body", "ip", "user_agent", "ingest_time"]
    whole = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    payloads.select(F.to_json(F.struct(*columns), whole).alias("value")).write.mode("append").text(path)
