"""SimHash near-duplicates: pigeonhole blocks, join on blocks, verified Hamming distance.

A fingerprint has 64 bits; bit i is 1 when it is set in more than half of the XXH64 hashes of
the document's shingles. The bits are cut into `max_bits + 2` blocks, so fingerprints within
`max_bits` agree on at least two whole blocks: each pair of blocks is one key, fingerprints
sharing a key are compared, and those within `max_bits` are linked.

Defined cases: null or blank text has fingerprint zero and links like any other; repeated rows
stay rows and share their class; a null doc_id never represents a class unless it is alone; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import cell_pairs, components, local_roots, released, stored, text_slices, texts_of, tiled, whole_cells

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
TILE = 256  # fingerprints of one block key compared in one place; more are dealt into tiles
_FOLD = 1 << 16  # hashes unpacked to bits at once


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """Fingerprint of a UTF-8 text, unsigned."""
    tokens = text.lower().split()  # bytes: lower() is A-Z only, split() is ASCII white space only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(tokens) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    hashes = np.fromiter(
        (digest(joined[s:e], SEED) for s, e in zip(starts, ends)), dtype=np.uint64, count=len(starts)
    )
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _FOLD):
        part = hashes[at : at + _FOLD].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int("".join("1" if 2 * c > len(hashes) else "0" for c in counts.tolist()), 2)


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows, dtype=np.uint64)
            for start, end in text_slices(batch):
                for k, text in enumerate(texts_of(batch, start, end)):
                    out[start + k] = fingerprint(text, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp), fp as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        released(_fingerprints(words)), "doc_id long, fp long"
    )


def block_masks(max_bits: int) -> list[int]:
    """Signed 64-bit masks of all pairs of max_bits + 2 blocks."""
    blocks = max_bits + 2
    edges = [64 * k // blocks for k in range(blocks + 1)]
    single = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(blocks)]
    masks = [x | y for x, y in itertools.combinations(single, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _links(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cells in whole_cells(batches, ["mask", "bits", "cell_x", "cell_y"]):
            fp = rows.column("fp").to_numpy()
            part = rows.column("part").to_numpy()
            crossed = rows.column("cell_x").to_numpy() != rows.column("cell_y").to_numpy()
            near_i, near_j = [], []
            for i, j in cell_pairs(cells):
                near = np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= max_bits
                near &= ~crossed[i] | (part[i] != part[j])
                near_i.append(i[near])
                near_j.append(j[near])
            if not near_i:
                continue
            i, j = np.concatenate(near_i), np.concatenate(near_j)
            nodes = np.unique(np.concatenate((i, j)))
            root = local_roots(len(fp), i, j)
            nodes = nodes[root[nodes] != nodes]
            yield pa.RecordBatch.from_arrays([pa.array(fp[nodes]), pa.array(fp[root[nodes]])], ["a", "b"])

    return run


def links(prints: DataFrame, max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """Enough links (a, b) of distinct fingerprints within max_bits to connect every class."""
    keys = F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits"))
                     for k, m in enumerate(block_masks(max_bits))])
    rows = prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.*")
    return tiled(rows, ["mask", "bits"], "fp", tile).mapInArrow(released(_links(max_bits)), "a long, b long")


def classes(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """One row per document row: doc_id, fp, component_id (smallest doc_id reachable)."""
    prints = stored(fingerprints(docs, words), "fingerprints")
    unique = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "unique-fingerprints")
    found = stored(components(links(unique, max_bits, tile)), "components")
    named = stored(
        unique.join(found, unique.fp == found.node, "left")
        .select("fp", "first_id", F.coalesce("component", "fp").alias("label")),
        "labels",
    )
    smallest = stored(named.groupBy("label").agg(F.min("first_id").alias("component_id")), "smallest")
    reps = stored(named.join(smallest, "label").select("fp", "component_id"), "representatives")
    return prints.join(reps, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicate(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents whose doc_id is the smallest of their class; all columns stay.

    Rows without doc_id stay. Repeated rows of a kept doc_id stay as they are.
    """
    gone = classes(docs, words, max_bits).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(stored(gone, "near-duplicates"), "doc_id", "left_anti")
