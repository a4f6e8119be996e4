"""Line dedup: exact set-similarity join on the word sets of lines; later matches go.

A line is the set of its words (64-bit hashes, A-Z lowered). A line is removed when a line
before it, in order of (doc_id, line number) over the whole table, has a Jaccard similarity of
`4/5` or more with it. Removed lines count as earlier lines too, so the result does not depend
on the order of work. Blank lines are never removed and never match.

How matches are found, none lost:
 - words are ordered by rarity, from counts in a fixed number of hash buckets (any order that
   is the same for all lines keeps the filters exact; 2^17 counts are broadcast);
 - similar sets of n words share one of the n - ceil(0.8 n) + 1 rarest (prefix filter);
 - rows meet by prefix word and are compared when their sizes (length filter), the places of the
   word (positional filter) and 128-bit parity maps (64-bit for short lines) of their words (words of one side only flip a
   bit each, which bounds the overlap from above) still allow the similarity; equal sets (size, map
   and a hash of the set, 64 bits for short lines and 32 beside the map of 128) match at once;
 - each other line offers its likeliest surviving earlier partner per word, by the maps, which are
   verified on the whole word sets; lines that had more partners and none verified offer all of them in a second
   round. The word sets come from one more scan a round, of the lines in a bit map of 2^26 bits:
   with more offered lines than that it lets others through too, which costs work and changes
   nothing.
Prefix rows are shuffled once and not stored. Words whose bucket holds at most `SHARE` of all words
meet by word in one partition, and leave it unpaired when they have more than `HOT` rows; under the
others equal lines meet and are merged. The rows of both kinds of frequent words are dealt into tiles,
so no word makes a large task or is held in memory whole. Only the rows of cells with further
partners, and of those only the rows in a surviving pair, are kept for the second round. Repeats
of a line are removed inside a task while its table of `KNOWN` lines remembers them; the others meet
as equal sets.

Hashes of words up to `LONG_WORD` bytes are polynomial sums, vectorized; longer ones are XXH64.

Defined cases: null text has no lines; rows without doc_id are kept whole and not compared; rows
sharing a doc_id have their lines treated alike (equal line numbers never remove each other);
an empty table gives an empty result; other columns are kept (`deduplicate`) or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import (
    free_name, mix64, released, stored, text_slices, texts_of, tiled, whole_cells, word_hashes,
)

NUMERATOR, DENOMINATOR = 4, 5  # Jaccard similarity
BUCKET_BITS = 17
HOT = 1000
SHARE = 2.0**-14
TILE = 500
OFFERS = 1  # partners offered per line and word in the first round
KNOWN = 1 << 18  # lines a task remembers to drop repeats early
LONG_WORD = 128  # bytes
SHORT_LINE = 60  # words; such lines have a map of 64 bits
_BUCKETS = 1 << BUCKET_BITS

# kinds of rows, in the top bits of `cell`; the rest is a hash of what meets there
REPEAT, COLD, HOT_ROW, LATER = 0, 1, 2, 3
_KIND_BIT = 61
_CELL_BITS = 44  # words sharing a cell only cost comparisons; the zeros above need no room in a shuffle
_ROWS = "cell long, token long, sizes long, map long, map_2 long, whole long, doc_id long, line int"
_SET = ("sizes", "map", "map_2", "whole")
_SLOT_BITS = 26  # bit map of the lines to verify, 8 MB


def line_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and line of every word; document and line number of every line (A-Z lowered)."""
    joined = b"\n".join(texts).lower()  # bytes: A-Z only
    hashes, at = word_hashes(joined)
    ends = np.append(at[1:], len(joined))
    for k in np.flatnonzero(ends - at > LONG_WORD):
        word = joined[at[k] : ends[k]].split(None, 1)[0]
        if len(word) > LONG_WORD:
            hashes[k] = xxhash.xxh64_intdigest(word, seed=5)
    breaks = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 10)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    first = np.searchsorted(breaks, np.cumsum(sizes + 1) - sizes - 1)  # first line of each document
    line = np.arange(len(breaks) + 1)
    doc = np.searchsorted(first, line, side="right") - 1
    return hashes, np.searchsorted(breaks, at), doc, line - first[doc]


def _pack(size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Size and place of a word (less than the size) as one small number, which a shuffle compresses."""
    return size * (size - 1) // 2 + place


def _unpack(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = ((1 + np.sqrt(8.0 * sizes + 1)) / 2).astype(np.int64)
    size -= size * (size - 1) // 2 > sizes  # rounding of large numbers
    size += size * (size + 1) // 2 <= sizes
    return size, sizes - size * (size - 1) // 2


def _bucket(words: np.ndarray) -> np.ndarray:
    return (mix64(words ^ np.uint64(0xA5)) & np.uint64(_BUCKETS - 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_BUCKETS, dtype=np.int64)
    for batch in batches:
        for start, end in text_slices(batch):
            word = line_words(texts_of(batch, start, end))[0]
            total += np.bincount(_bucket(word), minlength=_BUCKETS)
    hit = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["bucket", "n"])


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """Word counts in 2^BUCKET_BITS buckets over all lines: a bounded table."""
    rows = docs.select("text").mapInArrow(released(_count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = rows.toPandas()
    counts = np.zeros(_BUCKETS, dtype=np.int64)
    counts[found.bucket.to_numpy(dtype=np.int64)] = found.n.to_numpy(dtype=np.int64)
    return counts


def _prefix_rows(counts: Broadcast, hot: int):
    """Prefix rows of lines, and the lines repeated in the same task.

    `cell` brings cold rows of a word together, and equal lines under a hot word (which keep
    the word in `token`).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counts.value
        seen: dict[int, tuple[int, int]] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for start, end in text_slices(batch):
                word, line, doc, number = line_words(texts_of(batch, start, end))
                if len(word):
                    yield from slice_rows(word, line, ids[start:end][doc], number, count, seen)

    def slice_rows(word, line, owner, number, count, seen):
        # by line, rarity and word: one sort key, with ties of different words broken by the word
        rarity = count[_bucket(word)]
        most = np.uint64((1 << 18) - 1)
        key = (line.astype(np.uint64) << np.uint64(42)) | (np.minimum(rarity.astype(np.uint64), most) << np.uint64(24)) | (word >> np.uint64(40))
        order = np.argsort(key)
        tie = (key[order][1:] == key[order][:-1]) & (word[order][1:] != word[order][:-1])
        if tie.any() or line[-1] >= 1 << 22:
            order = np.lexsort((word, np.minimum(rarity, int(most)), line))
        word, line, rarity = word[order], line[order], rarity[order]
        new = np.append(True, (word[1:] != word[:-1]) | (line[1:] != line[:-1]))
        word, line, rarity = word[new], line[new], rarity[new]
        first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        size = np.diff(np.append(first, len(word)))
        whole = np.add.reduceat(mix64(word ^ np.uint64(0x51)), first) ^ size.astype(np.uint64)
        owner, number = owner[line[first]], number[line[first]]
        # repeats inside the task: the earlier one stays
        fresh, gone_doc, gone_line = np.ones(len(first), dtype=bool), [], []
        for k, (key, d, n) in enumerate(zip(whole.tolist(), owner.tolist(), number.tolist())):
            known = seen.get(key)
            if known is None or (d, n) < known:
                if len(seen) >= KNOWN:
                    seen.clear()
                seen[key] = (d, n)
            else:
                fresh[k] = False
                if known != (d, n):
                    gone_doc.append(d)
                    gone_line.append(n)
        if gone_doc:
            n = len(gone_doc)
            zero = np.zeros(n, dtype=np.int64)
            gone_doc, gone_line = np.array(gone_doc, dtype=np.int64), np.array(gone_line, dtype=np.int64)
            yield batch_of(REPEAT, _place(gone_doc, gone_line), [None] * n, zero, zero, zero, zero, gone_doc, gone_line)
        group = np.repeat(np.arange(len(first)), size)
        place = np.arange(len(word)) - np.repeat(first, size)
        prefix = size - (NUMERATOR * size + DENOMINATOR - 1) // DENOMINATOR + 1
        width = np.where(size > SHORT_LINE, np.uint64(127), np.uint64(63))  # 64 bits tell short lines apart
        bit = mix64(word ^ np.uint64(0x77)) & np.repeat(width, size)
        flip, high = np.uint64(1) << (bit & np.uint64(63)), bit >> np.uint64(6) == 1
        maps, maps_2 = (
            np.bitwise_xor.reduceat(np.where(own, flip, np.uint64(0)), first).view(np.int64) for own in (~high, high)
        )
        mark = np.where(size > SHORT_LINE, whole >> np.uint64(32), whole).view(np.int64)
        pick = np.flatnonzero((place < prefix[group]) & fresh[group] & (rarity > 1))
        hot_word = rarity[pick] > hot
        for kind, own in ((COLD, pick[~hot_word]), (HOT_ROW, pick[hot_word])):
            if len(own):
                g, token = group[own], word[own]
                yield batch_of(
                    kind, token if kind == COLD else mix64(token ^ whole[g]),
                    [None] * len(own) if kind == COLD else token.view(np.int64), _pack(size[g], place[own]),
                    maps[g], maps_2[g], mark[g], owner[g], number[g],
                )

    def batch_of(kind, key, token, sizes, map_, map_2, whole, doc_id, number):
        cell = (key >> np.uint64(64 - _CELL_BITS)).view(np.int64) | (kind << _KIND_BIT)
        return pa.RecordBatch.from_arrays(
            [pa.array(cell), pa.array(token, pa.int64()), pa.array(sizes), pa.array(map_), pa.array(map_2), pa.array(whole),
             pa.array(np.asarray(doc_id, dtype=np.int64)), pa.array(np.asarray(number, dtype=np.int32))],
            names=_names(_ROWS),
        )

    return run


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


_OFFERED = "doc_id long, line int, with_doc long, with_line int, more boolean, same boolean"


def _near_pairs(cells: np.ndarray, size: np.ndarray, chunk: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j within equal (contiguous) cells whose sizes pass the length filter, in bounded
    chunks: a row meets the next rows by size only, so other pairs are never made."""
    cell = np.cumsum(np.append(0, cells[1:] != cells[:-1]))
    order = np.lexsort((size, cell))
    of, own = cell[order], size[order]
    sizes, level = np.unique(own, return_inverse=True)  # so that cell and size fit one number
    most = np.searchsorted(sizes, own * DENOMINATOR // NUMERATOR, side="right") - 1
    key = of * len(sizes)
    at = np.arange(len(own))
    n = np.searchsorted(key + level, key + most, side="right") - at - 1
    ends = np.cumsum(n)
    low = 0
    while low < len(n):
        done = ends[low - 1] if low else 0
        high = max(int(np.searchsorted(ends, done + chunk, side="right")), low + 1)
        if ends[high - 1] > done:
            left = np.repeat(at[low:high], n[low:high])
            right = left + 1 + np.arange(len(left)) - np.repeat(ends[low:high] - n[low:high] - done, n[low:high])
            left, right = order[left], order[right]
            yield np.minimum(left, right), np.maximum(left, right)
        low = high


def _partners(rows: pa.Table, cells: np.ndarray, most: int | None):
    """Earlier partners (j, i) inside cells that the filters leave, at most `most` per row j.

    Returns (rows in order, cells, j, i, same, more, paired); `more` marks rows that had further
    partners, `paired` all rows of surviving pairs. A row with an equal earlier set gets that
    partner only (`same`). Of more partners than `most`, those whose maps differ least are given.
    """
    shared = np.zeros(len(cells), dtype=bool)
    shared[1:] = cells[1:] == cells[:-1]
    shared[:-1] |= shared[1:]
    if not shared.any():
        return None
    rows, cells = rows.filter(pa.array(shared)), cells[shared]
    order = np.lexsort((rows.column("line").to_numpy(), rows.column("doc_id").to_numpy(), cells))
    rows = rows.take(pa.array(order))
    doc, line, sizes, whole = (rows.column(n).to_numpy() for n in ("doc_id", "line", "sizes", "whole"))
    maps, maps_2 = (rows.column(n).to_numpy().view(np.uint64) for n in ("map", "map_2"))
    size, place = _unpack(sizes)
    part = crossed = None
    if "cell_x" in rows.column_names:
        part = rows.column("part").to_numpy()
        crossed = rows.column("cell_x").to_numpy() != rows.column("cell_y").to_numpy()
    asks = rows.column("asks").to_numpy() if "asks" in rows.column_names else None
    given = np.zeros(len(doc), dtype=np.int64)
    more, done, paired = (np.zeros(len(doc), dtype=bool) for _ in range(3))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i, j in _near_pairs(cells, size):  # i before j in order
        a, b = size[i], size[j]
        bound = np.minimum(place[i], place[j]) + np.minimum(a - place[i], b - place[j])
        low, high = maps[i] ^ maps[j], maps_2[i] ^ maps_2[j]
        mixed = (a > SHORT_LINE) != (b > SHORT_LINE)  # a map of 128 bits is folded to meet one of 64
        apart = np.bitwise_count(np.where(mixed, low ^ high, low)).astype(np.int64) + np.where(mixed, 0, np.bitwise_count(high))
        bound = np.minimum(bound, (a + b - apart) // 2)
        ok = (NUMERATOR + DENOMINATOR) * bound >= NUMERATOR * (a + b)
        ok &= (doc[i] != doc[j]) | (line[i] != line[j])
        if crossed is not None:
            ok &= ~crossed[i] | (part[i] != part[j])
        if asks is not None:
            ok &= asks[j]
        i, j, gap = i[ok], j[ok], apart[ok] / (a + b)[ok]
        paired[i] = paired[j] = True
        same = (whole[i] == whole[j]) & (maps[i] == maps[j]) & (maps_2[i] == maps_2[j]) & (size[i] == size[j])
        new, at = np.unique(j[same], return_index=True)
        fresh = ~done[new]
        new, by = new[fresh], i[same][at[fresh]]
        found.append((new, by, np.ones(len(new), dtype=bool)))
        done[new] = True
        open_ = ~done[j]
        i, j, gap = i[open_], j[open_], gap[open_]
        if most is not None and len(j):
            by = np.lexsort((gap, j))
            i, j = i[by], j[by]
            at = np.arange(len(j)) - np.searchsorted(j, j) + given[j]
            given += np.bincount(j, minlength=len(given))
            more[j[at >= most]] = True
            i, j = i[at < most], j[at < most]
        found.append((j, i, np.zeros(len(j), dtype=bool)))
    if not found:
        return None
    j, i, same = (np.concatenate(x) for x in zip(*found))
    left = same | ~done[j]
    return rows, cells, j[left], i[left], same[left], more & ~done, paired


def _offer_columns(found) -> list[pa.Array]:
    rows, _, j, i, same, more, _ = found
    doc, line = rows.column("doc_id").to_numpy(), rows.column("line").to_numpy()
    return [pa.array(doc[j]), pa.array(line[j]), pa.array(doc[i]), pa.array(line[i]), pa.array(more[j]), pa.array(same)]


def _offers(keys: list[str], most: int | None):
    """Offers inside the cells of `keys`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cells in whole_cells(batches, keys):
            found = _partners(rows, cells, most)
            if found is not None and len(found[2]):
                yield pa.RecordBatch.from_arrays(_offer_columns(found), _names(_OFFERED))

    return run


_MET = f"kind int, {_OFFERED}, {_ROWS.partition(', doc_id')[0]}"


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Stretches of one kind of cell-sorted rows."""
    for batch in batches:
        kind = batch.column("cell").to_numpy() >> _KIND_BIT
        cuts = [0, *(np.flatnonzero(kind[1:] != kind[:-1]) + 1).tolist(), len(kind)]
        for low, high in zip(cuts, cuts[1:]):
            if high > low:
                yield int(kind[low]), batch.slice(low, high - low)


def _bounded(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[bool, pa.Table, np.ndarray]]:
    """Cell-sorted rows as (False, rows of whole cells, cells), but cells of more than `limit` rows
    in pieces, as (True, rows, cells): no more than `limit` rows and a batch are held."""
    rest, large = None, None  # rows of the last cell so far; that cell if already passed on in part
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
        cells = rows.column("cell").to_numpy()
        last = int(np.searchsorted(cells, cells[-1]))
        _, of, size = np.unique(cells, return_inverse=True, return_counts=True)
        over = (size > limit)[of] | (cells == large if large is not None else False)
        if over.any():
            yield True, rows.filter(pa.array(over)), cells[over]
        ready = ~over
        ready[last:] = False
        if ready.any():
            yield False, rows.filter(pa.array(ready)), cells[ready]
        large = cells[-1] if over[-1] else None
        rest = None if over[-1] else rows.slice(last)
    if rest is not None and rest.num_rows:
        yield False, rest, rest.column("cell").to_numpy()


def _meetings(most: int, limit: int):
    """Cell-sorted prefix rows to offers (COLD), the first of equal lines under each hot word
    (HOT_ROW), lines equal to an earlier one (REPEAT), and the rows of cold cells that hold
    further partners than were offered (LATER). A cold cell of more than `limit` rows turns hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, group in groupby(_kinds(batches), key=lambda found: found[0]):
            slices = (rows for _, rows in group)
            if kind == REPEAT:
                for rows in slices:
                    yield out(REPEAT, rows)
                continue
            for large, rows, cells in _bounded(slices, limit):
                if kind == COLD and not large:
                    found = _partners(rows, cells, most)
                    if found is None or not len(found[2]):
                        continue
                    n = len(found[2])
                    none = [pa.nulls(n, pa.int64())] * (len(_names(_MET)) - 7)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, COLD, dtype=np.int32)), *_offer_columns(found), *none], _names(_MET)
                    )
                    own = found[6] & np.isin(found[1], np.unique(found[1][found[5]]))
                    if own.any():
                        yield out(LATER, found[0].filter(pa.array(own)))
                else:
                    alike = [rows.column(name).to_numpy() for name in _SET]  # the word has one place in equal sets
                    order = np.lexsort((rows.column("line").to_numpy(), rows.column("doc_id").to_numpy(), *alike, cells))
                    rows, cells = rows.take(pa.array(order)), cells[order]
                    first = np.append(True, cells[1:] != cells[:-1])
                    for own in alike:
                        first[1:] |= own[order][1:] != own[order][:-1]
                    doc, line = rows.column("doc_id").to_numpy(), rows.column("line").to_numpy()
                    head = np.flatnonzero(first)[np.cumsum(first) - 1]
                    again = ~first & ((doc != doc[head]) | (line != line[head]))
                    if kind == COLD:  # the cell stands for its word
                        at = rows.schema.get_field_index("token")
                        rows = rows.set_column(at, "token", rows.column("cell"))
                    yield out(HOT_ROW, rows.filter(pa.array(first)))
                    if again.any():
                        yield out(REPEAT, rows.filter(pa.array(again)))

    def out(kind: int, rows: pa.Table | pa.RecordBatch) -> pa.RecordBatch:
        n = rows.num_rows
        whole = lambda name: rows.column(name).combine_chunks() if isinstance(rows, pa.Table) else rows.column(name)
        have = {"kind": pa.array(np.full(n, kind, dtype=np.int32)), "doc_id": whole("doc_id"), "line": whole("line")}
        if kind != REPEAT:
            have |= {name: whole(name) for name in ("cell", "token", *_SET)}
        kinds = {"int": pa.int32(), "boolean": pa.bool_(), "long": pa.int64()}
        return pa.RecordBatch.from_arrays(
            [have.get(c.split()[0], pa.nulls(n, kinds[c.split()[1]])) for c in _MET.split(", ")], _names(_MET)
        )

    return run


def _place(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix64(doc.astype(np.int64).view(np.uint64) + mix64(line.astype(np.uint64)))


def _slot(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return _place(doc, line) & np.uint64((1 << _SLOT_BITS) - 1)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slot = np.unique(_slot(batch.column(0).to_numpy(), batch.column(1).to_numpy())).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(slot + 1)], ["slot"])  # Spark counts from 1


def _bit_map(lines: DataFrame) -> np.ndarray:
    """Bit map of the slots of lines (doc_id, line), packed: 8 MB whatever their number."""
    blocks = (
        lines.mapInArrow(released(_slots), "slot long")
        .groupBy(F.bitmap_bucket_number("slot").alias("block"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
        .toPandas()
    )
    bits = np.zeros(((1 << _SLOT_BITS) >> 15, 1 << 12), dtype=np.uint8)
    for block, found in zip(blocks.block, blocks.bits):
        bits[block - 1] = np.frombuffer(found, dtype=np.uint8)
    return bits.reshape(-1)


def _wanted_sets(bits: Broadcast):
    """Word sets of the lines whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = bits.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for start, end in text_slices(batch):
                word, line, doc, number = line_words(texts_of(batch, start, end))
                owner = ids[start:end][doc]
                slot = _slot(owner, number).astype(np.int64)
                asked = (wanted[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
                own = asked[line]
                word, line = word[own], line[own]
                order = np.lexsort((word, line))
                word, line = word[order], line[order]
                if not len(word):
                    continue
                new = np.append(True, (word[1:] != word[:-1]) | (line[1:] != line[:-1]))
                word, line = word[new], line[new]
                first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
                words = pa.ListArray.from_arrays(
                    pa.array(np.append(first, len(word)).astype(np.int32)), pa.array(word.view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owner[line[first]]), pa.array(number[line[first]].astype(np.int32)), words],
                    ["doc_id", "line", "words"],
                )

    return run


def _verified(docs: DataFrame, offers: DataFrame) -> DataFrame:
    """Offers whose word sets reach the similarity: (doc_id, line), distinct."""
    needed = offers.select("doc_id", "line").unionByName(
        offers.select(F.col("with_doc").alias("doc_id"), F.col("with_line").alias("line"))
    )
    shared = docs.sparkSession.sparkContext.broadcast(_bit_map(needed))
    sets = stored(docs.mapInArrow(released(_wanted_sets(shared)), "doc_id long, line int, words array<long>"), "line-sets")
    sets = sets.repartition("doc_id", "line")  # one exchange for both joins
    other = sets.select(F.col("doc_id").alias("with_doc"), F.col("line").alias("with_line"), F.col("words").alias("with_words"))
    both = F.size(F.array_intersect("words", "with_words"))
    return (
        offers.join(sets, ["doc_id", "line"]).join(other, ["with_doc", "with_line"])
        .where((NUMERATOR + DENOMINATOR) * both >= NUMERATOR * (F.size("words") + F.size("with_words")))
        .select("doc_id", "line").distinct()
    )


def removed_lines(
    docs: DataFrame, hot: int = HOT, tile: int = TILE, offers: int = OFFERS, share: float = SHARE
) -> DataFrame:
    """Distinct (doc_id, line) of the lines to remove; line numbers start at 0.

    Words of more than `hot` rows are dealt into tiles; those that may make up more than `share`
    of all words never meet in one partition before that.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    found = bucket_counts(docs)
    counts, spread = spark.sparkContext.broadcast(found), max(hot, int(found.sum() * share))
    met = stored(
        docs.mapInArrow(released(_prefix_rows(counts, spread)), _ROWS).repartition("cell").sortWithinPartitions("cell")
        .mapInArrow(released(_meetings(offers, hot)), _MET),
        "meetings",
    )
    line, partner = ["doc_id", "line"], ["with_doc", "with_line"]
    many = met.where(F.col("kind") == HOT_ROW).select("token", *_SET, *line)

    def warm(many: DataFrame, most: int | None) -> DataFrame:
        many = many.withColumn("key", F.xxhash64("doc_id", "line", "sizes"))
        return tiled(many, ["token"], "key", tile).mapInArrow(released(_offers(["token", "cell_x", "cell_y"], most)), _OFFERED)

    # one row per line: a line has at most one partner per prefix word here
    first = stored(
        met.where(F.col("kind") == COLD).select(*line, *partner, "more", "same")
        .unionByName(warm(many, offers))
        .unionByName(
            met.where(F.col("kind") == REPEAT)
            .select(*line, *[F.lit(None).cast(t).alias(c) for c, t in zip(partner, ("long", "int"))],
                    F.lit(False).alias("more"), F.lit(True).alias("same"))
        )
        .groupBy(*line)
        .agg(F.max("same").alias("same"), F.max("more").alias("more"),
             F.collect_set(F.when(~F.col("same"), F.struct(*partner))).alias("partners")),
        "offers",
    )
    sure = first.where("same").select(*line)
    doubt = first.where("not same").select(*line, F.explode("partners").alias("p")).select(*line, "p.*")
    verified = stored(_verified(docs, doubt), "verified")
    gone = sure.unionByName(verified)
    open_ = stored(first.where("not same and more").select(*line).join(verified, line, "left_anti"), "open")
    if not open_.isEmpty():
        mark = open_.withColumn("asks", F.lit(True))

        def asked(rows: DataFrame, key: str) -> DataFrame:
            """Rows of the words under which an open line has a row."""
            marked = rows.join(mark, line, "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
            return marked.join(marked.where("asks").select(key).distinct(), key, "left_semi")

        later = asked(met.where(F.col("kind") == LATER).select("cell", *_SET, *line), "cell")
        cold = later.repartition("cell").sortWithinPartitions("cell").mapInArrow(released(_offers(["cell"], None)), _OFFERED)
        rest = cold.unionByName(warm(asked(many, "token"), None)).select(*line, *partner)
        gone = gone.unionByName(_verified(docs, stored(rest.distinct(), "all-offers"))).distinct()
    return gone


_LINE_COUNT = "size(filter(split(coalesce(text, ''), '\\n', -1), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]'))"


def line_counts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.expr(_LINE_COUNT).cast("long").alias("n_lines"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_lines (with a word), n_removed, removed line numbers."""
    gone = removed_lines(docs).groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("removed"))
    return (
        line_counts(docs).join(stored(gone, "removed-by-doc"), "doc_id", "left")
        .select(
            "doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
            F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"),
        )
        .withColumn("n_removed", F.greatest("n_removed", F.lit(0).cast("long")))
    )


def _doc_slot(doc_id: Column) -> Column:
    return F.xxhash64(doc_id).bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents without removed lines; all columns and rows stay, emptied texts too."""
    doc, lines = free_name(docs, "_doc"), free_name(docs, "_gone")
    gone = removed_lines(docs).groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set("line").alias(lines))
    kept = F.expr(
        f"CASE WHEN {lines} IS NULL OR text IS NULL THEN text ELSE "
        f"array_join(filter(split(text, '\\n', -1), (l, i) -> NOT array_contains({lines}, i)), '\\n') END"
    )
    gone = stored(gone, "removed-by-doc")
    # texts that lose nothing stay where they are: a bit map of the others' slots, 8 MB, lets some more through
    block, bits = free_name(docs, "_block"), free_name(docs, "_bits")
    slots = stored(
        gone.select((_doc_slot(F.col(doc)) + 1).alias("slot"))  # Spark counts from 1
        .groupBy(F.bitmap_bucket_number("slot").alias(block))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias(bits)),
        "slots-by-doc",
    )
    slot = _doc_slot(docs.doc_id.cast("long"))
    marked = docs.join(F.broadcast(slots), F.shiftright(slot, 15) + 1 == F.col(block), "left")
    byte = F.conv(F.hex(F.substr(F.col(bits), (F.shiftright(slot.bitwiseAND(F.lit(32767)), 3) + 1).cast("int"), F.lit(1))), 16, 10)
    hit = F.coalesce(F.getbit(byte.cast("int"), slot.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    joined = marked.where(hit).join(gone, F.col("doc_id").cast("long") == F.col(doc), "left")
    changed = joined.select(*[(kept if c == "text" else F.col(f"`{c}`")).alias(c) for c in docs.columns])
    return marked.where(~hit).select(*[F.col(f"`{c}`") for c in docs.columns]).unionAll(changed)
