"""Embedding near-duplicates: rotated binary codes with correction factors, exact recheck.

Each unit vector o is rotated at random; its code is the signs of the rotated coordinates and
its correction factor f = <code, o> (code scaled to unit length). For another unit vector q,
<code, q> / f estimates <o, q> without bias over rotations; its error is
    sqrt(1 - f^2) / f * sqrt(1 - <o, q>^2) * eps / sqrt(dim - 1)
with eps the confidence in standard deviations. Pairs whose estimate plus this bound stays
below the threshold are settled; the rest get the exact cosine in double precision. By default
eps = sqrt(dim - 1), where the bound holds with certainty (Cauchy-Schwarz).

Which pairs meet: `ROTATIONS` rotations give one 64-bit code each (or fewer bits for short
vectors), cut into bands of `BAND_BITS`. Pairs with equal label meet where a band agrees. At a
cosine of 0.98 one bit agrees with probability 0.936, so all 25 bands of 12 bits miss a pair
with probability 3e-7; closer pairs miss far less often. A pair that meets in several bands
counts in the first only. Bands shared by many vectors are dealt into tiles.

Defined cases: a vector that is null, zero, or holds null or non-finite components, or whose
label is null, links with nothing and is its own class; vectors of different lengths never
link; rows sharing a vec_id count once (the smallest by label, then vector); rows without
vec_id come out unlinked; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import cell_pairs, components, local_roots, stored, tiled, whole_cells

THRESHOLD = 0.98
ROTATIONS = 5
BAND_BITS = 12
BANDS = 5  # per rotation: 60 of 64 bits
TILE = 256
_PAIRS = 1 << 15  # pairs rechecked at once

_CODED = "vec_id long, label string, dim int, band int, bits int, codes binary, factor float, vec binary"


@functools.lru_cache(maxsize=8)
def rotations(dim: int) -> np.ndarray:
    """Random orthogonal matrices, fixed by their seed; stacked along the first axis."""
    rng = np.random.default_rng(20_24 + dim)
    return np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(ROTATIONS)])


def _bits(dim: int) -> int:
    return min(dim, BANDS * BAND_BITS)


def codes_of(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, ROTATIONS) of unit vectors, and the first rotation's correction factors."""
    dim = unit.shape[1]
    weights = np.uint64(1) << np.arange(_bits(dim), dtype=np.uint64)
    out = np.empty((len(unit), ROTATIONS), dtype=np.uint64)
    factor = np.empty(len(unit))
    for r, matrix in enumerate(rotations(dim)):
        turned = unit @ matrix.T
        out[:, r] = ((turned[:, : _bits(dim)] >= 0) * weights).sum(axis=1, dtype=np.uint64)
        if r == 0:
            factor = np.abs(turned).sum(axis=1) / np.sqrt(dim)
    return out, factor


def band_values(codes: np.ndarray) -> np.ndarray:
    """(n, ROTATIONS * BANDS) band values of the codes."""
    shifts = np.arange(BANDS, dtype=np.uint64) * np.uint64(BAND_BITS)
    mask = np.uint64((1 << BAND_BITS) - 1)
    return ((codes[:, :, None] >> shifts) & mask).reshape(len(codes), -1)


def _code_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            ids, labels = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("label")
            vectors = batch.column("embedding").to_pylist()
            by_dim: dict[int, list[int]] = {}
            for k, v in enumerate(vectors):
                by_dim.setdefault(len(v), []).append(k)
            for dim, rows in by_dim.items():
                raw = np.array([vectors[k] for k in rows], dtype=np.float64)
                scale = np.abs(raw).max(axis=1, keepdims=True)
                unit = raw / scale
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                codes, factor = codes_of(unit)
                bands = band_values(codes)
                n, b = bands.shape
                pick = pa.array(np.repeat(np.arange(n), b))
                take = lambda values: pa.array(values).take(pick)
                yield pa.RecordBatch.from_arrays(
                    [
                        take(ids[rows].astype(np.int64)),
                        labels.take(pa.array(rows)).take(pick),
                        pa.array(np.full(n * b, dim, dtype=np.int32)),
                        pa.array(np.tile(np.arange(b, dtype=np.int32), n)),
                        pa.array(bands.astype(np.int32).ravel()),
                        pa.array([c.tobytes() for c in codes], pa.binary()).take(pick),
                        take(factor.astype(np.float32)),
                        pa.array([v.tobytes() for v in raw], pa.binary()).take(pick),
                    ],
                    names=[c.split()[0] for c in _CODED.split(", ")],
                )


def settle(codes, factor, unit, i, j, threshold: float, eps: float | None) -> np.ndarray:
    """Which pairs (i, j) reach the threshold: estimate and bound first, exact cosine after."""
    dim = unit.shape[1]
    signs = (unit @ rotations(dim)[0].T >= 0) * 2.0 - 1.0  # the stored code, unpacked
    towards = (signs / np.sqrt(dim)) @ rotations(dim)[0]
    estimate = np.einsum("nd,nd->n", towards[i], unit[j]) / factor[i]
    spread = np.sqrt(np.maximum(0.0, 1.0 - factor**2)) / factor * np.sqrt(1.0 - threshold**2)
    sure = np.sqrt(max(dim - 1, 1))
    bound = spread * (min(eps, sure) if eps is not None else sure) / sure
    maybe = np.flatnonzero(estimate + bound[i] + 1e-6 >= threshold)
    exact = np.einsum("nd,nd->n", unit[i[maybe]], unit[j[maybe]])
    out = np.zeros(len(i), dtype=bool)
    out[maybe] = exact >= threshold
    return out


def _links(threshold: float, eps: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cells in whole_cells(batches, ["label", "dim", "band", "bits", "cell_x", "cell_y"]):
            dims = rows.column("dim").to_numpy()
            for dim in np.unique(dims):
                yield from one_length(rows.filter(pa.array(dims == dim)), cells[dims == dim], int(dim))

    def one_length(rows: pa.Table, cells: np.ndarray, dim: int) -> Iterator[pa.RecordBatch]:
        n = rows.num_rows
        ids, part = rows.column("vec_id").to_numpy(), rows.column("part").to_numpy()
        band = rows.column("band").to_numpy()
        crossed = rows.column("cell_x").to_numpy() != rows.column("cell_y").to_numpy()
        codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), dtype=np.uint64).reshape(n, ROTATIONS)
        raw = np.frombuffer(b"".join(rows.column("vec").to_pylist()), dtype=np.float64).reshape(n, dim)
        factor = rows.column("factor").to_numpy().astype(np.float64)
        unit = raw / np.linalg.norm(raw / np.abs(raw).max(axis=1, keepdims=True), axis=1, keepdims=True)
        unit /= np.abs(raw).max(axis=1, keepdims=True)
        values = band_values(codes)
        linked_i, linked_j = [], []
        for i, j in cell_pairs(cells, _PAIRS):
            fresh = ids[i] != ids[j]
            fresh &= ~crossed[i] | (part[i] != part[j])
            i, j = i[fresh], j[fresh]
            for at in range(0, len(i), _PAIRS):
                x, y = i[at : at + _PAIRS], j[at : at + _PAIRS]
                first = (values[x] == values[y]).argmax(axis=1) == band[x]  # counted in this band only
                x, y = x[first], y[first]
                yes = settle(codes, factor, unit, x, y, threshold, eps)
                linked_i.append(x[yes])
                linked_j.append(y[yes])
        if not linked_i:
            return
        i, j = np.concatenate(linked_i), np.concatenate(linked_j)
        if not len(i):
            return
        order = np.argsort(ids, kind="stable")  # roots are the smallest ids
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        root = order[local_roots(n, place[i], place[j])][place]
        degree = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
        hit = np.flatnonzero(degree)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[hit]), pa.array(ids[root[hit]]), pa.array(degree[hit].astype(np.int64))],
            ["a", "b", "n_links"],
        )

    return run


def classes(
    vectors: DataFrame, threshold: float = THRESHOLD, eps: float | None = None, tile: int = TILE
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    v = F.col("embedding").cast("array<double>")
    limit = F.lit(1.7976931348623157e308)
    usable = (
        F.col("label").isNotNull()
        & F.col("vec_id").isNotNull()
        & F.exists("embedding", lambda x: x != 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= limit))
    )
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), v.alias("embedding"))
    unnamed = rows.where("vec_id is null").select("vec_id")
    once = stored(
        rows.where("vec_id is not null").groupBy("vec_id")
        .agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.*"),
        "vectors",
    )
    coded = once.where(usable).mapInArrow(_code_rows, _CODED)
    keys = ["label", "dim", "band", "bits"]
    found = stored(
        tiled(coded, keys, "vec_id", tile).mapInArrow(_links(threshold, eps), "a long, b long, n_links long"),
        "vector-links",
    )
    degree = stored(found.groupBy("a").agg(F.sum("n_links").alias("n_links")), "degrees")
    member = stored(components(found.select("a", "b")), "components")
    named = (
        once.select("vec_id")
        .join(degree, F.col("vec_id") == degree.a, "left")
        .join(member, F.col("vec_id") == member.node, "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
        )
    )
    alone = unnamed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return named.unionByName(alone).withColumn("kept", F.coalesce(F.expr("vec_id = component_id"), F.lit(True)))
