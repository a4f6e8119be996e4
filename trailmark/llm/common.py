"""Shared pieces: reading, intermediate tables, word hashes, tiled pairs, connected components."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.session import work_dir

WORD = r"[^\x20\x09-\x0D]+"  # a word: no ASCII white space inside
SLICE_BYTES = 2 << 20  # text handled at once inside a task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes of text each; one longer text makes a range alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > size:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def texts_of(batch: pa.RecordBatch, start: int, end: int, column: str = "text") -> list[bytes]:
    """UTF-8 texts of a row range; null counts as empty."""
    values = batch.column(column).slice(start, end - start).cast(pa.large_binary())
    return [v or b"" for v in values.to_pylist()]


def release_memory() -> None:
    """Give back what earlier work of a reused worker left behind: tables of powers, freed Arrow buffers
    and the allocator's free pages."""
    _powers.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def released(run: Callable) -> Callable:
    """A task function that leaves a small worker behind: workers wait for further tasks, beside an
    executor that may have other work."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return whole


# ---- word hashes ----------------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 18
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (splitmix finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    up, down = np.full(n, _ODD), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _piece_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = SPACES[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    size = max(2 * _PIECE, 1 << int(len(data) + 1).bit_length())
    up, down = _powers(size) if size == 2 * _PIECE else _powers.__wrapped__(size)  # those of a giant word are not kept
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and byte position of every word; a long text goes in pieces cut at spaces."""
    data = np.frombuffer(text, dtype=np.uint8)
    if len(data) <= _PIECE:
        return _piece_hashes(data)
    hashes, places, start = [], [], 0
    while start < len(data):
        end = min(start + _PIECE, len(data))
        while end < len(data) and not SPACES[data[end]]:
            end += 1
        h, at = _piece_hashes(data[start:end])
        hashes.append(h)
        places.append(at + start)
        start = end
    return np.concatenate(hashes), np.concatenate(places)


def phrase_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions have none."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = mix64(out * _ODD + words[j : j + n])
    return out


# ---- pairs inside cells ---------------------------------------------------------------

def whole_cells(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Regroup key-sorted batches so that no cell is cut; yields rows and their cell numbers.

    Cells must be bounded by the caller (tiles): a cell is held in memory whole.
    """
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
        new = np.zeros(rows.num_rows, dtype=bool)
        for key in keys:
            v = rows.column(key).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if cut:
            yield rows.slice(0, cut), np.cumsum(new[:cut])
        rest = rows.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest, np.zeros(rest.num_rows, dtype=np.int64)


def cell_pairs(cells: np.ndarray, chunk: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j within equal (contiguous) cells, in bounded chunks."""
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    held, step, at = 0, 1, np.arange(len(cells))
    while True:
        at = at[at + step < len(cells)]
        at = at[cells[at + step] == cells[at]]
        if not len(at):
            break
        left.append(at)
        right.append(at + step)
        held += len(at)
        step += 1
        if held >= chunk:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes under the links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        if np.array_equal(low, label[i]) and np.array_equal(low, label[j]):
            return label
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]


def tiled(rows: DataFrame, keys: list[str], unique: str, tile: int) -> DataFrame:
    """Rows of keys with two rows or more, dealt into cells of at most about 2 * tile rows.

    A key of n rows gets t = ceil(n / tile) parts; part pairs (x <= y) make its cells, and a
    row goes to the t cells of its part. Every pair of rows meets: in (x, x) when both are in
    part x, else in (x, y), where only pairs of different parts are to be compared.
    Adds `part`, `cell_x`, `cell_y`; the result is partitioned and sorted by cell.
    """
    sizes = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "cell-sizes")
    parts = F.ceil(F.col("_n") / tile).cast("int")
    part = F.pmod(F.xxhash64(F.lit("part"), F.col(unique)), F.col("_t")).cast("int")
    dealt = (
        rows.join(sizes, keys)
        .withColumn("_t", parts)
        .withColumn("part", part)
        .withColumn("_o", F.explode(F.expr("sequence(0, _t - 1)")))
        .withColumn("cell_x", F.least("part", "_o"))
        .withColumn("cell_y", F.greatest("part", "_o"))
        .drop("_n", "_t", "_o")
    )
    cell = [*keys, "cell_x", "cell_y"]
    return dealt.repartition(*cell).sortWithinPartitions(*cell)


# ---- connected components -------------------------------------------------------------

def components(edges: DataFrame, limit: int = 50) -> DataFrame:
    """(node, component) of the nodes in edges (a, b); component is the smallest node.

    Alternates large-star and small-star steps until the links are stars. Minima are
    pre-aggregated on the map side and written before they are joined, so that both join
    sides are plain exchanges whose large partitions AQE splits (a hub may hold most links).
    """
    a, b = F.col("a"), F.col("b")
    links = stored(
        edges.where("a <> b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links"
    )
    seen = None
    for _ in range(limit):
        both = links.unionByName(links.select(b.alias("a"), a.alias("b")))
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "low")
        large = stored(
            both.join(low, "a").where("b > a").select(b.alias("a"), F.col("m").alias("b")).distinct(), "large"
        )
        small_low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "small-low")
        links = stored(
            large.join(small_low, "a")
            .select(F.explode(F.array(F.struct(a.alias("a"), F.col("m").alias("b")),
                                      F.struct(b.alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*").where("a <> b").distinct(),
            "links",
        )
        state = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == seen:
            return links.select(a.alias("node"), b.alias("component")).unionByName(
                links.select(b.alias("node"), b.alias("component")).distinct()
            )
        seen = state
    raise RuntimeError("components did not settle")
