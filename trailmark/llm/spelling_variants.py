"""Spelling variants: words within one edit, found on a bit-sliced position index.

The vocabulary is counted over all documents. Two words one edit apart agree on the first half of
the shorter word's length or on the rest at the end, so words are dealt into cells by (length of
the shorter word, side, fragment). The vocabulary of a cell is held as bitsets, one per (position,
letter): bit v is set when word v has that letter there. All words of the shorter length query it
at once; per letter three sets of matching words move on, 64 words to a machine word:

    zero errors:      Z' = Z & B[i]
    one replaced:     S' = (S & B[i]) | (Z & ~B[i])
    one more letter:  I' = (I | Z) & B[i + 1]        (the index read one position further)

A deleted letter is the third set seen from the longer word. A pair that meets on both sides
counts on the first. Large cells are dealt into tiles, so no task holds a whole hot fragment, and
each cell gives sums and minima per word, never its pairs.

A word's form is its near word of largest count (ties: smallest in code-point order) when that
count is at least `ratio` times the word's own; forms are followed by pointer doubling.

Defined cases: null or empty texts hold no words; a null doc_id gives no slip (see `vocabulary`);
repeated rows count again; an empty table or vocabulary gives an empty result; very long runs are
words like any other; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import stored, whole_cells

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2
SLIP = 97
TILE = 4096  # words of one cell compared in one place; more are dealt into tiles
_TILE_LETTERS = 16  # longer words get smaller tiles: a tile holds about TILE * _TILE_LETTERS letters
_GROUP = 768  # words of small cells that share one index
_QUERIES = 1 << 16  # 64-bit words of a set matrix handled at once


def slipped(doc_id: Column, run: Column, modulus: int) -> Column:
    """The run, or the run without one letter where `modulus` divides its checksum.

    The checksum is crc32 of `<doc_id>:<run>`; it also names the letter (modulo the length).
    """
    h = F.crc32(F.encode(F.concat(doc_id.cast("string"), F.lit(":"), run), "UTF-8"))
    at = (h % F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % modulus == 0, cut).otherwise(run)


def vocabulary(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, slip: int | None = None
) -> DataFrame:
    """(word, n): letter runs, A-Z lower-cased, with at least min_length code points, n >= min_count.

    With `slip`, one of so many (document, run) pairs loses a letter first: known misspellings.
    """
    lowered = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    runs = docs.select(
        F.col("doc_id").alias("id"), F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("word")
    ).where(F.char_length("word") >= min_length)  # a slip never lengthens a run
    if slip is not None:
        runs = runs.withColumn("word", F.coalesce(slipped(F.col("id"), F.col("word"), slip), F.col("word")))
        runs = runs.where(F.char_length("word") >= min_length)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


# ---- the index ------------------------------------------------------------------------

def code_matrix(words: list[str], width: int) -> tuple[np.ndarray, int]:
    """Letter numbers per word and position (0: beyond the end), and how many letters there are."""
    points = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), dtype=np.uint32)
    letters, codes = np.unique(np.append(points, 0), return_inverse=True)
    return codes[:-1].reshape(len(words), width), len(letters)


def _bitsets(codes: np.ndarray, letters: int) -> np.ndarray:
    """(letters, words / 64) bitsets of one position; nobody has the letter 0."""
    n = len(codes)
    member = np.zeros((letters, -(-n // 64) * 64), dtype=bool)
    member[codes, np.arange(n)] = True
    member[0] = False
    return np.packbits(member, axis=1, bitorder="little").view(np.uint64)


def _mask(chosen: np.ndarray) -> np.ndarray:
    padded = np.zeros(-(-len(chosen) // 64) * 64, dtype=bool)
    padded[: len(chosen)] = chosen
    return np.packbits(padded, bitorder="little").view(np.uint64)


def one_error(codes: np.ndarray, letters: int, short: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, word): queries have `short` letters, words that many or one more.

    Both orders of a replacement appear; an additional letter appears as (shorter, longer).
    """
    longer = codes[:, short] > 0
    queries = np.flatnonzero(~longer)
    same, more = _mask(~longer), _mask(longer)
    width = len(same)
    left, right = [], []
    step = max(1, _QUERIES // width)
    for at in range(0, len(queries), step):
        own = codes[queries[at : at + step]]
        zero = np.full((len(own), width), ~np.uint64(0))
        replaced = np.zeros_like(zero)
        added = np.zeros_like(zero)
        here = _bitsets(codes[:, 0], letters)
        for i in range(short):
            after = _bitsets(codes[:, i + 1], letters)
            match = here[own[:, i]]
            added |= zero
            added &= after[own[:, i]]
            replaced &= match
            replaced |= zero & ~match
            zero &= match
            here = after
        found = (replaced & same) | ((added | zero) & more)
        row, word = np.nonzero(found)
        bits = np.unpackbits(found[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        hit, bit = np.nonzero(bits)
        left.append(queries[at + row[hit]])
        right.append(word[hit] * 64 + bit)
    if not left:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(left), np.concatenate(right)


_KEYS = ["short", "side", "fragment"]
_NEAR = "word string, near long, best_n long, best string"


def _group_links(rows: pa.Table, cells: np.ndarray) -> pa.RecordBatch | None:
    """Sums and best near words of the words of some whole cells of one length."""
    short = rows.column("short")[0].as_py()
    words = rows.column("word").to_pylist()
    codes, letters = code_matrix(words, short + 1)
    i, j = one_error(codes, letters, short)
    part, side = rows.column("part").to_numpy(), rows.column("side").to_numpy()
    crossed = rows.column("cell_x").to_numpy() != rows.column("cell_y").to_numpy()
    half = short // 2
    use = (cells[i] == cells[j]) & (~crossed[i] | (part[i] != part[j]))
    i, j = i[use], j[use]
    use = (side[i] == 0) | (codes[i, :half] != codes[j, :half]).any(axis=1)
    i, j = i[use], j[use]
    grown = codes[j, short] > 0
    i, j = np.concatenate((i, j[grown])), np.concatenate((j, i[grown]))
    if not len(i):
        return None
    n = rows.column("n").to_numpy()
    names = np.array(words, dtype=object)
    rank = np.empty(len(words), dtype=np.int64)
    order = np.argsort(names, kind="stable")
    order = order[np.argsort(-n[order], kind="stable")]
    rank[order] = np.arange(len(words))
    best = np.full(len(words), len(words), dtype=np.int64)
    np.minimum.at(best, i, rank[j])
    near = np.bincount(i, minlength=len(words))
    hit = np.flatnonzero(near)
    top = order[best[hit]]
    return pa.RecordBatch.from_arrays(
        [pa.array(names[hit], pa.string()), pa.array(near[hit]), pa.array(n[top]), pa.array(names[top], pa.string())],
        ["word", "near", "best_n", "best"],
    )


def _cells_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, cells in whole_cells(batches, [*_KEYS, "cell_x", "cell_y"]):
        short = rows.column("short").to_numpy()
        edges = [0, *(np.flatnonzero((cells[1:] != cells[:-1])) + 1).tolist(), len(cells)]
        start = 0
        for k in range(1, len(edges)):
            # close a group at its size, and where the length changes
            if k == len(edges) - 1 or short[edges[k]] != short[start] or edges[k + 1] - start > _GROUP:
                if edges[k] - start > 1:
                    found = _group_links(rows.slice(start, edges[k] - start), cells[start : edges[k]])
                    if found is not None:
                        yield found
                start = edges[k]


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have a near word."""
    length = F.char_length("word")
    half = (F.col("short") / 2).cast("int")
    keyed = (
        words.withColumn("short", F.explode(F.array(length, length - 1)))
        .where("short >= 1")
        .withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn(
            "fragment",
            F.when(F.col("side") == 0, F.substring("word", F.lit(1), half))
            .otherwise(F.substring("word", length - (F.col("short") - half) + 1, length)),
        )
    )
    sizes = stored(keyed.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "cell-sizes")
    scale = F.greatest(F.lit(1.0), F.col("short") / _TILE_LETTERS)
    dealt = (
        keyed.join(sizes, _KEYS)
        .withColumn("_t", F.ceil(F.col("_n") * scale / tile).cast("int"))
        .withColumn("_t", F.least("_t", F.col("_n").cast("int")))
        .withColumn("part", F.pmod(F.xxhash64(F.lit("part"), F.col("word")), F.col("_t")).cast("int"))
        .withColumn("_o", F.explode(F.expr("sequence(0, _t - 1)")))
        .withColumn("cell_x", F.least("part", "_o"))
        .withColumn("cell_y", F.greatest("part", "_o"))
        .drop("_n", "_t", "_o")
    )
    cell = [*_KEYS, "cell_x", "cell_y"]
    found = dealt.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(_cells_links, _NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("top")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("top.minus")).alias("best_n"), F.col("top.best").alias("best")
    )


# ---- forms and roots ------------------------------------------------------------------

def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, by pointer doubling.

    Counts at least double along a chain, so it has no cycle and few steps.
    """
    jumps = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = jumps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        jumps = stored(
            jumps.join(further, "root", "left").select(
                "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")
            ),
            "roots",
        )
        moved = jumps.where("moved").limit(1).count()
        jumps = jumps.drop("moved")
        if not moved:
            return jumps


def group(words: DataFrame, ratio: int = RATIO, tile: int = TILE) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of a vocabulary (word, n)."""
    words = stored(words, "vocabulary")
    chosen = F.col("best_n") >= ratio * F.col("n")
    named = stored(
        words.join(near_words(words, tile), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(chosen, F.col("best")).alias("form"), F.when(chosen, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(named.where(F.col("form").isNotNull()).select("word", "form"))
    return named.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
