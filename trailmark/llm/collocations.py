"""Phrase collocations from count streams in prefix and suffix order.

Phrases of 1 to `longest` words are counted per language, one length at a time. A phrase of k
words can only reach `min_count` when both of its parts of k - 1 words do, so windows of k words
are emitted only where both parts pass a bit filter of the frequent phrases one word shorter. The
filter has a bounded size (`FILTER_BITS` at most) and errs on one side: a phrase that slips
through is counted and dropped, so counts are exact whatever its size.

The stream of length k is then read twice, each time merge-joined in lockstep with the stream of
length k - 1: in prefix order (lang, all but the last word), which gives the counts of all first
parts and, the other way, the largest extension to the right; and in suffix order (lang, all but
the first word), which gives the counts of the rest and the largest extension to the left. First
parts and rests of shorter cuts are handed on along the streams, so no table of all counts is
looked up. A longer phrase that holds a candidate holds it inside a phrase of one more word that
is at least as frequent, so extensions by one word decide which candidates are dropped.

Scores are computed in decimals. The top phrases of a language are taken in two steps, first in
each of its parts (as many as balance both steps), so one large language isn't ranked in one task.

Defined cases: null and empty texts have no words; null lang counts as `und`, an empty one is a
language of its own; repeated rows count again; ties go by phrase; an empty table gives an empty
result; long texts are cut between pieces or, within a piece, at overlapping words; doc_id and
other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import phrase_hashes, stored, text_slices, texts_of, word_hashes

LONGEST = 4
MIN_COUNT = 30
ABSORB = 80  # a candidate is dropped when a longer one has this percentage of its count
TOP = 2000
SCALE = 2_000_000
UNKNOWN = "und"
FILTER_BITS = 28  # the filter has at most 2 ** FILTER_BITS bits, 32 MB
_BITS_EACH = 16  # bits a frequent phrase gets, below that bound
_BLOCK = 15  # a bitmap of the engine has 2 ** 15 bits

_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANKS = np.zeros(256, dtype=bool)
_BLANKS[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CHUNK = 1 << 18  # bytes of text tokenized at once
_WINDOWS = 1 << 14  # windows gathered at once


class Tokens:
    """Words of some pieces: normalized bytes (one blank after each word), starts, ends, pieces."""

    def __init__(self, data: np.ndarray, owner: np.ndarray):
        """`owner` numbers the text of every byte; a piece never spans two texts."""
        data = _LOWER[data]
        broken = _BREAKS[data]
        inside = ~(broken | _BLANKS[data])
        changes = np.flatnonzero(np.diff(owner)) + 1
        split = np.zeros(len(data), dtype=bool)
        split[changes] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | split[1:]
        starts = np.flatnonzero(first)
        word = np.cumsum(first) - 1
        lengths = np.bincount(word[inside], minlength=len(starts)) if len(starts) else np.zeros(0, dtype=np.int64)
        ends = np.cumsum(lengths + 1) - 1
        self.starts, self.ends = ends - lengths, ends
        self.bytes = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, dtype=np.uint8)
        kept = np.flatnonzero(inside)
        self.bytes[np.arange(len(kept)) + word[kept]] = data[kept]
        piece = np.cumsum(broken | split)
        self.piece, self.owner = piece[starts], owner[starts]
        self.source = starts

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word, for the filter only: equal words are equal, others may be."""
        return word_hashes(self.bytes.tobytes())[0]


def _stretches(text: bytes, overlap: int) -> Iterator[tuple[bytes, int]]:
    """A long text in stretches with the offset of the first new word of each.

    A stretch ends between words; the next one begins `overlap` words earlier.
    """
    start, fresh = 0, 0
    while True:
        end = min(len(text), start + max(_CHUNK, 2 * (fresh - start)))
        while end < len(text) and not (_BREAKS[text[end]] or _BLANKS[text[end]]):
            end += 1
        yield text[start:end], fresh - start
        if end == len(text):
            return
        fresh, start = end, end
        for _ in range(overlap):
            while start > 0 and (_BREAKS[text[start - 1]] or _BLANKS[text[start - 1]]):
                start -= 1
            while start > 0 and not (_BREAKS[text[start - 1]] or _BLANKS[text[start - 1]]):
                start -= 1


def _groups(texts: list[bytes], k: int) -> Iterator[list[tuple[int, bytes, int]]]:
    """(number, text, first new byte) of texts tokenized together; long texts come in stretches."""
    group, held = [], 0
    for i, text in enumerate(texts):
        if group and held + len(text) > _CHUNK:
            yield group
            group, held = [], 0
        if len(text) > _CHUNK:
            for stretch, new in _stretches(text, k - 1):
                yield [(i, stretch, new)]
        elif text:
            group.append((i, text, 0))
            held += len(text)
    if group:
        yield group


def _token_runs(batch: pa.RecordBatch, k: int) -> Iterator[tuple[Tokens, np.ndarray]]:
    """Tokens of row ranges, and for each range which windows of k words are new."""
    for start, end in text_slices(batch):
        for group in _groups(texts_of(batch, start, end), k):
            data = np.frombuffer(b"".join(t for _, t, _ in group), dtype=np.uint8)
            owner = np.repeat([start + i for i, _, _ in group], [len(t) for _, t, _ in group])
            tokens = Tokens(data, owner)
            n = max(0, len(tokens.starts) - k + 1)
            yield tokens, tokens.source[k - 1 : k - 1 + n] >= group[0][2]


def _passes(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _windows(k: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if shared is None else np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            langs = batch.column("lang")
            for tokens, new in _token_runs(batch, k):
                n = len(new)
                ok = new & (tokens.piece[:n] == tokens.piece[k - 1 : k - 1 + n])
                if bits is not None:
                    part = _passes(phrase_hashes(tokens.hashes(), k - 1), bits)
                    ok &= part[:n] & part[1 : n + 1]
                at = np.flatnonzero(ok)
                for low in range(0, len(at), _WINDOWS):
                    own = at[low : low + _WINDOWS]
                    first, last = tokens.starts[own], tokens.ends[own + k - 1]
                    offsets = np.zeros(len(own) + 1, dtype=np.int64)
                    np.cumsum(last - first, out=offsets[1:])
                    index = np.repeat(first - offsets[:-1], last - first) + np.arange(offsets[-1])
                    phrase = pa.LargeStringArray.from_buffers(
                        len(own), pa.py_buffer(offsets), pa.py_buffer(tokens.bytes[index])
                    )
                    lang = langs.take(pa.array(tokens.owner[own]))
                    yield pa.RecordBatch.from_arrays([lang, phrase.cast(pa.string())], ["lang", "phrase"])

    return run


def occurrences(docs: DataFrame, k: int, shared=None) -> DataFrame:
    """(lang, phrase) of every window of k words whose parts pass the filter `shared`."""
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string")
    )
    return texts.mapInArrow(_windows(k, shared), "lang string, phrase string")


def _positions(k: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = b" ".join(p.encode() for p in batch.column("phrase").to_pylist())
            hashes = phrase_hashes(word_hashes(words)[0], k)[::k]  # each phrase has k words
            yield pa.RecordBatch.from_arrays(
                [pa.array((hashes & np.uint64((1 << bits) - 1)).astype(np.int64))], ["position"]
            )

    return run


def _filter(level: DataFrame, k: int):
    """Broadcast bit filter of the phrases of a level; at most 2 ** FILTER_BITS bits."""
    spark = level.sparkSession
    n = level.count()
    bits = min(FILTER_BITS, max(16, int(n * _BITS_EACH).bit_length()))
    rows = (
        level.select("phrase").mapInArrow(_positions(k, bits), "position long")
        .groupBy(F.shiftright("position", _BLOCK).alias("block"))
        .agg(F.bitmap_construct_agg(F.col("position").bitwiseAND(F.lit((1 << _BLOCK) - 1))).alias("bitmap"))
    )
    out = bytearray((1 << bits) // 8)
    for row in rows.toLocalIterator():
        at = row.block << (_BLOCK - 3)
        out[at : at + (1 << (_BLOCK - 3))] = row.bitmap
    return spark.sparkContext.broadcast(bytes(out))


def counted(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT) -> tuple[DataFrame, list[DataFrame]]:
    """Word totals (lang, n) and, per length 1 to longest, the frequent phrases (lang, phrase, words, f)."""
    totals, levels, shared = None, [], None
    for k in range(1, longest + 1):
        counts = occurrences(docs, k, shared).groupBy("lang", "phrase").agg(F.count(F.lit(1)).alias("f"))
        if k == 1:
            counts = stored(counts, "word-counts")
            totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
        level = stored(counts.where(F.col("f") >= min_count), f"phrases-{k}")
        levels.append(level.withColumn("words", F.split("phrase", " ")))
        if k < longest:
            shared = _filter(level, k)
    return totals, levels


def cut_counts(levels: list[DataFrame]) -> DataFrame:
    """(lang, phrase, a, firsts, rests, extension) of the frequent phrases of two words or more.

    firsts[j] counts the first j + 1 words, rests[j] what follows them; extension is the largest
    count of a frequent phrase with one word more on either side (null: none).
    """
    none = F.array().cast("array<bigint>")
    shorter = levels[0].select("lang", "words", "phrase", "f", none.alias("firsts"), none.alias("rests"))
    parts = []
    for k in range(2, len(levels) + 1):
        stream = levels[k - 1].select(
            "lang", "phrase", "words", "f",
            F.slice("words", 1, k - 1).alias("head"), F.slice("words", 2, k - 1).alias("tail"),
        )
        if k > 2:
            right = stream.groupBy("lang", F.col("head").alias("words")).agg(F.max("f").alias("e"))
            left = stream.groupBy("lang", F.col("tail").alias("words")).agg(F.max("f").alias("e"))
            longer = right.unionByName(left).groupBy("lang", "words").agg(F.max("e").alias("extension"))
            parts.append(shorter.join(longer.hint("merge"), ["lang", "words"], "left"))
        prefix = shorter.select("lang", F.col("words").alias("head"), F.concat("firsts", F.array("f")).alias("firsts"))
        suffix = shorter.select("lang", F.col("words").alias("tail"), F.concat(F.array("f"), "rests").alias("rests"))
        shorter = stored(
            stream.join(prefix.hint("merge"), ["lang", "head"])
            .join(suffix.hint("merge"), ["lang", "tail"])
            .select("lang", "words", "phrase", "f", "firsts", "rests"),
            f"cuts-{k}",
        )
    parts.append(shorter.withColumn("extension", F.lit(None).cast("long")))
    columns = ["lang", "phrase", F.col("f").alias("a"), "firsts", "rests", "extension"]
    return functools.reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])


# score, cut (words before it less one) and both counts; structs order by score, then cut
_CUTS = f"""transform(arrays_zip(firsts, rests), (x, k) -> struct(
    cast({SCALE} as decimal(7,0)) * cast(a as decimal(19,0))
        div (cast(x.firsts as decimal(19,0)) + cast(x.rests as decimal(19,0))) as score,
    k, x.firsts as l, x.rests as r))"""


def mine(
    docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, absorb: int = ABSORB, top: int = TOP
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `top` collocations of every language."""
    totals, levels = counted(docs, longest, min_count)
    absorbed = F.expr(f"cast(100 as decimal(3,0)) * cast(extension as decimal(19,0)) >= cast({absorb} as decimal(10,0)) * cast(a as decimal(19,0))")
    scored = stored(
        cut_counts(levels).where(F.coalesce(~absorbed, F.lit(True)))
        .withColumn("cut", F.array_min(F.expr(_CUTS)))
        .select("lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.score").cast("long").alias("score")),
        "scored",
    )
    parts = math.ceil(math.sqrt(scored.count() / top)) or 1
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    split = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    first = split.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    best = first.where(F.col("_place") <= top).withColumn("rank", place.cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
