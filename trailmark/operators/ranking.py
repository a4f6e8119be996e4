"""First rows per key, for any number of rows and keys of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Up to this rank the engine's default settings drop rows before they are shuffled.
_LIMITED = 1000
SPREAD = 64


def top_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str, spread_by: str, spread: int = SPREAD
) -> DataFrame:
    """The first n rows of each key, numbered from 1 in `name`.

    Beyond the engine's own limit, each key is dealt into `spread` parts by a hash of
    `spread_by`, ranked and cut there first: a task sees a part of a hot key, and the last
    ranking at most spread * n of its rows.
    """
    if n > _LIMITED:
        part = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = (
            df.withColumn("_part", F.pmod(F.xxhash64(spread_by), F.lit(spread)))
            .withColumn("_place", F.row_number().over(part)).filter(F.col("_place") <= n).drop("_part", "_place")
        )
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(name) <= n)
