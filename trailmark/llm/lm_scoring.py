"""Language-model scores: a probabilistic suffix tree, and a smoothed word unigram as base.

Text is taken as its words, A-Z lowered, joined by one space, and ended by an end symbol. The
tree predicts its UTF-8 bytes: the 62 most frequent bytes are symbols of their own, the rest
share one (and split its probability evenly), the end is the last. A context of up to `DEPTH`
symbols is a candidate when it makes up at least `SHARE` of all training positions (so there are
at most DEPTH / SHARE of them, whatever the corpus), and is kept when its next-symbol
distribution diverges from that of its longest proper suffix: n * KL must exceed half a log(N)
for every next symbol it has (BIC). Suffixes of kept contexts are kept. Distributions are
smoothed towards the suffix's. A position is scored by the longest kept suffix of its history.
Contexts of up to `SHORT` symbols are counted in one pass over the training texts, and those of up
to `LONG` in a second one: a longer candidate consists of candidates of SHORT + 1 symbols, whose
counts the first pass knows, so a position is counted once, under the longest history that
consists of such. Orders above LONG, which a code of 64 bits does not hold, take a pass each
that extends the candidates of the order before by one older symbol.

The tree spells a token: its bytes, then that the word ends there; between tokens it chooses
between another word and the end. Token probabilities are interpolated with the base unigram
(`WORD_SHARE`), which knows whole words. The README has the figures: the tree alone scores below
the base, and the mix beats it only with enough training text.

Counts cover every training text. Word counts are exact and never gathered in one place: texts
are written as their words in chunks of about CHUNK bytes; each chunk sends its distinct words once, gets their
corpus counts back (a window over one row per chunk and word), and is scored with these.

Defined cases: null text is empty and has the end token only; rows without doc_id are scored but
teach nothing; repeated rows teach and are scored each; with no training rows counts are zero
and the tree is uniform; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import released, stored, text_slices, texts_of

FOLDS, HELD_OUT = 7, 2
SHORT, LONG, DEPTH = 4, 8, 8
SHARE = 5e-5
WORD_SHARE = 0.6
PRIOR = 4.0  # weight of the suffix's distribution, in observations
CHUNK = 12 << 20
END, OTHER = 63, 62
_LN10 = math.log(10)
_EDGE = b"\xff"  # no byte of UTF-8
_PAD = _EDGE * DEPTH
_MERGE = 2 << 20
_SLICE = 1 << 19  # bytes of text handled at once: the arrays of a slice stay in a core's cache
_HEAD = 3  # symbols of a history that are looked up at once


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: A-Z and ASCII white space only


# ---- chunks and words -----------------------------------------------------------------

def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk, held = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for start, end in text_slices(batch):
            part = batch.slice(start, end - start)
            size = part.column("text").nbytes
            if held and held + size > CHUNK:
                chunk, held = chunk + 1, 0
            held += size
            plain = pa.array([b" ".join(tokens(text)) for text in texts_of(batch, start, end)], pa.binary())
            columns = [plain.cast(pa.string()) if name == "text" else part.column(name) for name in part.schema.names]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(part.num_rows, chunk)), *columns], ["chunk", *part.schema.names]
            )


def chunked(docs: DataFrame) -> DataFrame:
    """(chunk, doc_id, held_out, teaches, text), written; text is the tokens, joined by one space."""
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select(
        "doc_id", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"),
        F.coalesce(fold != HELD_OUT, F.lit(False)).alias("teaches"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return stored(rows.mapInArrow(released(_chunks), "chunk long, doc_id long, held_out boolean, teaches boolean, text string"), "chunks")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, word, n): every distinct token of a chunk, counted in training texts; '' is the end."""
    at, counts = None, Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        words, n = list(counts), list(counts.values())
        for low in range(0, len(words), 1 << 16):
            part = pa.array(words[low : low + (1 << 16)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(part), at)), part, pa.array(n[low : low + (1 << 16)], pa.int64())],
                ["chunk", "word", "n"],
            )

    for batch in batches:
        chunk, teaches = batch.column("chunk").to_numpy(), batch.column("teaches").to_pylist()
        for start, end in text_slices(batch):
            for k, text in enumerate(texts_of(batch, start, end), start):
                if chunk[k] != at:
                    if counts:
                        yield from flush()
                    at, counts = int(chunk[k]), Counter()
                words = text.split()
                if teaches[k]:
                    counts.update(words)
                    counts[b""] += 1
                else:
                    counts.update(dict.fromkeys(words, 0))
                    counts[b""] += 0
    if counts:
        yield from flush()


def word_counts(chunks: DataFrame) -> tuple[DataFrame, int, int]:
    """((chunk, word, c), tokens N, distinct tokens V) of the training texts."""
    rows = chunks.select("chunk", "teaches", "text").mapInArrow(released(_words), "chunk long, word string, n long")
    same = Window.partitionBy("word")  # a row per chunk at most
    known = stored(
        rows.select(
            "chunk", "word", "n", F.sum("n").over(same).alias("c"),
            (F.row_number().over(same.orderBy("chunk")) == 1).alias("first"),
        ),
        "word-counts",
    )
    n, v = known.agg(F.sum("n"), F.count(F.when(F.col("first") & (F.col("c") > 0), 1))).first()
    return known.select("chunk", "word", "c"), int(n or 0), int(v or 0)


# ---- the tree -------------------------------------------------------------------------

def _joined(plain: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Texts, given as joined tokens, as one buffer with edges around; first and end position of every text."""
    sizes = np.fromiter(map(len, plain), dtype=np.int64, count=len(plain))
    starts = np.cumsum(sizes + DEPTH) - sizes
    return _PAD + _PAD.join(plain) + _EDGE, starts, starts + sizes


def _codes(data: bytes, ends: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a position is predicted, symbol) of all positions."""
    s = symbol.astype(np.int32)[np.frombuffer(data, dtype=np.uint8)]
    predicted = np.ones(len(s), dtype=bool)
    predicted[:DEPTH] = False
    for k in range(1, DEPTH):  # the rest of the edge after a text's end symbol
        predicted[ends[:-1] + k] = False
    return predicted, s


def _short_codes(data: bytes, ends: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """SHORT + 1 symbols of 6 bits for every predicted position."""
    predicted, s = _codes(data, ends, symbol)
    code = s[: len(s) - SHORT].copy()
    for k in range(1, SHORT + 1):
        code <<= 6
        code |= s[k : len(s) - SHORT + k]
    return code[predicted[SHORT:]]


def children(parents: list[np.ndarray], older: list[np.ndarray]) -> list[np.ndarray]:
    """Per order k >= 1: which context of order k extends one of order k - 1 by an older symbol.

    The last row stands for no context, -1.
    """
    out, above = [], 1
    for parent, symbol in zip(parents, older):
        step = np.full((above + 1, 64), -1, dtype=np.int32)
        step[parent, symbol] = np.arange(len(parent), dtype=np.int32)
        out.append(step)
        above = len(parent)
    return out


def _towards_last(steps: list[np.ndarray], parents: list[np.ndarray]) -> list[np.ndarray]:
    """Steps that lead to contexts of the last order only."""
    out, leads = [], np.ones(len(parents[-1]), dtype=bool)
    for step, parent in zip(reversed(steps), reversed(parents)):
        out.append(np.where((step >= 0) & leads[step], step, np.int32(-1)))
        above = np.zeros(len(step) - 1, dtype=bool)
        above[parent[leads]] = True
        leads = above
    return out[::-1]


def _heads(steps: list[np.ndarray]) -> list[np.ndarray]:
    """Per order up to _HEAD: the context of every history of _HEAD symbols, -1 where there is none."""
    code = np.arange(1 << 6 * _HEAD)
    state, out = np.zeros(len(code), dtype=np.int32), []
    for k in range(_HEAD):
        if k < len(steps) and len(steps[k]):
            state = np.where(state >= 0, steps[k][state, (code >> 6 * k) & 63], np.int32(-1))
        else:
            state = np.full(len(code), -1, dtype=np.int32)
        out.append(state)
    return out


def _histories(s: np.ndarray) -> np.ndarray:
    """The last _HEAD symbols before every position from _HEAD on, the latest one lowest."""
    code = s[: len(s) - _HEAD].copy()
    for k in range(1, _HEAD):
        code <<= 6
        code |= s[k : len(s) - _HEAD + k]
    return code


def _descend(state: np.ndarray, s: np.ndarray, steps: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per order above _HEAD: the positions whose history has a context there, and the context.

    `state` has the contexts of _HEAD symbols of all positions from _HEAD on, -1 where there is none.
    """
    live = None
    for k, step in enumerate(steps[_HEAD:], _HEAD + 1):
        if live is None:  # most positions get here: all at once; -1 leads to the row of no context
            state = step.ravel()[(state[1:] << 6) + s[: len(s) - k]]
            there = np.flatnonzero(state >= 0)
            live, state = there + k, state[there]
        else:
            state = step.ravel()[(state << 6) + s[live - k]]
            there = state >= 0
            live, state = live[there], state[there]
        yield live, state


def _extensions(symbol: np.ndarray, parents: list[np.ndarray], older: list[np.ndarray]):
    """Next symbols (kind 0) and older symbols (kind 1) of the contexts of the last order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, k = _towards_last(children(parents, older), parents), len(parents)
        head = _heads(steps)[-1]
        total = np.zeros((2, len(parents[-1]) * 64), dtype=np.int64)
        for batch in batches:
            for start, end in text_slices(batch, size=_SLICE):
                data, _, ends = _joined([b" ".join(tokens(text)) for text in texts_of(batch, start, end)])
                predicted, s = _codes(data, ends, symbol)
                for at, state in _descend(head[_histories(s)], s, steps):  # noqa: B007
                    pass
                own = predicted[at]
                at, cell = at[own], state[own] << 6
                total[0] += np.bincount(cell + s[at], minlength=total.shape[1])
                if k < DEPTH:
                    total[1] += np.bincount(cell + s[at - k - 1], minlength=total.shape[1])
        kind, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(cell), pa.array(total[kind, cell])], ["kind", "cell", "n"])

    return run


def _bytes_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, dtype=np.int64)
    for batch in batches:
        for start, end in text_slices(batch):
            total += np.bincount(np.frombuffer(b" ".join(texts_of(batch, start, end)), dtype=np.uint8), minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], ["byte", "n"])


def _merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    return code[first], np.add.reduceat(n, first)


def _grams(codes_of: Callable[[bytes, np.ndarray], np.ndarray]):
    """Counts of the codes that `codes_of` finds in joined texts and their end positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for start, end in text_slices(batch, size=_SLICE):
                data, _, ends = _joined(texts_of(batch, start, end))
                code, n = np.unique(codes_of(data, ends), return_counts=True)
                codes.append(code.astype(np.int64))
                counts.append(n)
                held += len(code)
                if held > _MERGE:
                    code, n = _merged(codes, counts)
                    codes, counts, held = [code], [n], 0
                    if len(code) > _MERGE // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])
                        codes, counts = [], []
        if held or codes and len(codes[0]):
            code, n = _merged(codes, counts)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    return run


def _short_grams(symbol: np.ndarray):
    return _grams(lambda data, ends: _short_codes(data, ends, symbol))


def _long_grams(symbol: np.ndarray, parents: list[np.ndarray], older: list[np.ndarray]):
    """Histories of more than SHORT symbols that consist of contexts of the last order, and the next symbol.

    Every predicted position is counted under its longest such history, of up to LONG symbols; its
    length, less SHORT, stands above the LONG + 1 symbols of 6 bits.
    """
    steps, order = _towards_last(children(parents, older), parents), len(parents)
    head = _heads(steps)[-1]

    def codes_of(data: bytes, ends: np.ndarray) -> np.ndarray:
        predicted, s = _codes(data, ends, symbol)
        for at, _ in _descend(head[_histories(s)], s, steps):  # noqa: B007
            pass
        run = np.zeros(len(s), dtype=np.int8)  # contexts of the last order that end here in a row
        run[at] = 1
        longest = row = run[DEPTH:]
        for k in range(1, LONG - order + 1):
            row = row & run[DEPTH - k : len(run) - k]
            longest = longest + row
        longest[~predicted[DEPTH:]] = 0
        at = np.flatnonzero(longest)
        past = s[DEPTH - LONG : len(s) - LONG].astype(np.int64)  # the last LONG symbols before every position from DEPTH on
        for k in range(LONG - 1, 0, -1):
            past <<= 6
            past |= s[DEPTH - k : len(s) - k]
        length = longest[at]
        kept = (np.int64(1) << 6 * np.arange(SHORT, LONG + 1)) - 1
        return (past[at] & kept[length]) << 6 | s[DEPTH:][at] | length.astype(np.int64) << 6 * (LONG + 1)

    return _grams(codes_of)


def _frequent(grams: DataFrame, fewest: float, low: int, high: str | int):
    """Next-symbol counts (k, context, next, n) of the contexts of `low` to `high` symbols that codes hold."""
    every = F.explode(F.expr(
        f"transform(sequence({low}, {high}), k -> named_struct('k', k, 'context', "
        f"shiftright(code, 6) & (shiftleft(1L, 6 * k) - 1), 'next', code & 63))"
    ))
    # a context has at most 64 next symbols; at most 1 / share contexts per order are left
    return (
        grams.select("n", every.alias("e")).groupBy("e.k", "e.context", "e.next").agg(F.sum("n").alias("n"))
        .withColumn("of", F.sum("n").over(Window.partitionBy("k", "context")))
        .where(F.col("of") >= fewest).drop("of").toPandas()
    )


def _counted(rows: DataFrame) -> DataFrame:
    return stored(rows.groupBy("code").agg(F.sum("n").alias("n")), "grams")


def fit(chunks: DataFrame, share: float = SHARE):
    """(symbol of each byte, kept contexts by order, log10 probabilities per state)."""
    taught = chunks.where("teaches").select("text")
    seen = taught.mapInArrow(released(_bytes_seen), "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).toPandas()
    seen = seen[(seen.n > 0) & ~seen.byte.isin([9, 10, 11, 12, 13, 255])].sort_values(["n", "byte"], ascending=[False, True])
    symbol = np.full(256, OTHER, dtype=np.uint8)
    for k, byte in enumerate(seen.byte.head(OTHER)):
        symbol[int(byte)] = k
    symbol[255] = END
    grams = _counted(taught.mapInArrow(released(_short_grams(symbol)), "code long, n long"))
    total = grams.agg(F.sum("n")).first()[0] or 0
    names, counts = _contexts(_frequent(grams, total * share, 0, SHORT), 0, SHORT)
    names[0] = np.zeros(1, dtype=np.int64)
    counts[0] = counts[0] if len(counts[0]) else np.zeros((1, 64))
    if LONG > SHORT:
        begun = _longer(names[-1], counts[-1], total * share)
        if len(begun):
            found = _counted(taught.mapInArrow(released(_long_grams(symbol, *_links([*names, begun]))), "code long, n long"))
            high = f"{SHORT} + cast(shiftright(code, {6 * (LONG + 1)}) as int)"
            more = _contexts(_frequent(found, total * share, SHORT + 1, high), SHORT + 1, LONG)
            while more[0] and not len(more[0][-1]):  # an order without contexts
                more[0].pop()
                more[1].pop()
            names, counts = names + more[0], counts + more[1]
    parents, older = _links(names)
    done = len(parents)
    while done >= LONG and len(parents) < DEPTH and len(parents[-1]):  # one more order a pass
        found = (
            taught.mapInArrow(released(_extensions(symbol, parents, older)), "kind long, cell long, n long")
            .groupBy("kind", "cell").agg(F.sum("n").alias("n"))
            .where((F.col("kind") == 0) | (F.col("n") >= total * share)).toPandas()
        )
        if len(parents) > done:
            counts.append(_next_counts(found, len(parents[-1])))
        cell = np.sort(found.cell[found.kind == 1].to_numpy(dtype=np.int64))
        parents.append(cell >> 6)
        older.append(cell & 63)
    if len(parents) > done and len(parents[-1]):
        found = (
            taught.mapInArrow(released(_extensions(symbol, parents, older)), "kind long, cell long, n long")
            .where("kind = 0").groupBy("kind", "cell").agg(F.sum("n").alias("n")).toPandas()
        )
        counts.append(_next_counts(found, len(parents[-1])))
    while len(parents) >= len(counts):  # an order without contexts
        parents.pop()
        older.pop()
    return symbol, *_grow(parents, older, counts, total)


def _next_counts(found, n: int) -> np.ndarray:
    own = found[found.kind == 0]
    out = np.zeros(n * 64)
    out[own.cell.to_numpy(dtype=np.int64)] = own.n.to_numpy(dtype=np.float64)
    return out.reshape(n, 64)


def _contexts(rows, low: int, high: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Codes and next-symbol counts of the contexts by order; the latest symbol is the lowest."""
    names, counts = [], []
    for k in range(low, high + 1):
        own = rows[rows.k == k]
        context = own.context.to_numpy(dtype=np.int64)
        name = np.unique(context)
        table = np.zeros((len(name), 64))
        table[np.searchsorted(name, context), own.next.to_numpy(dtype=np.int64)] = own.n.to_numpy(dtype=np.float64)
        names.append(name)
        counts.append(table)
    return names, counts


def _longer(names: np.ndarray, counts: np.ndarray, fewest: float) -> np.ndarray:
    """Contexts of one more symbol: a context and its next symbol, unless that ends the text, or edges only."""
    context, symbol = np.nonzero((counts >= fewest) & (counts > 0) & (np.arange(64) != END))
    edges = (1 << 6 * SHORT) - 1  # before every text's first position
    starts = counts[names == edges].sum()
    own = [edges << 6 | END] if starts > 0 and starts >= fewest else []
    return np.unique(np.append(names[context] << 6 | symbol, np.array(own, dtype=np.int64)))


def _links(names: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Parents and older symbols of the contexts by order."""
    parents = [np.searchsorted(names[k - 1], names[k] & ((1 << 6 * (k - 1)) - 1)) for k in range(1, len(names))]
    return parents, [names[k] >> 6 * (k - 1) for k in range(1, len(names))]


def _grow(parents, older, counts, total: int):
    """Kept contexts (parents, older symbols by order) and log10 probabilities by order."""
    smooth = [(counts[0] + 1) / (counts[0].sum() + 64)]
    kept = [np.ones(1, dtype=bool)]
    for k in range(1, len(counts)):
        parent = parents[k - 1]
        n = counts[k].sum(axis=1, keepdims=True)
        smooth.append((counts[k] + PRIOR * smooth[k - 1][parent]) / (n + PRIOR))
        above = counts[k - 1][parent]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = (counts[k] / n) / (above / above.sum(axis=1, keepdims=True))
            gain = np.where(counts[k] > 0, counts[k] * np.log(ratio), 0.0).sum(axis=1)
        kept.append(gain > 0.5 * (counts[k] > 0).sum(axis=1) * math.log(max(total, 2)))
    for k in range(len(counts) - 1, 1, -1):  # suffixes of kept contexts stay
        kept[k - 1][parents[k - 1][kept[k]]] = True
    number = [np.cumsum(own) - 1 for own in kept]
    kept_parents = [number[k - 1][parents[k - 1][kept[k]]] for k in range(1, len(counts))]
    kept_older = [older[k - 1][kept[k]] for k in range(1, len(counts))]
    logs = []
    for k in range(len(counts)):
        table = np.log10(smooth[k][kept[k]])
        table[:, OTHER] -= math.log10(255 - OTHER)
        logs.append(table.astype(np.float32))
    return kept_parents, kept_older, logs


class Suffixes:
    """Lookup of the longest kept suffix: contexts of all orders numbered in one row of tables."""

    def __init__(self, model):
        self.symbol, parents, older, logs = model
        self.steps = children(parents, older)
        self.logs = np.concatenate([table.ravel() for table in logs])
        self.first = np.cumsum([0, *map(len, logs)]).astype(np.int32)  # of each order
        heads = _heads(self.steps)
        self.head = heads[-1]
        self.longest = np.zeros(len(self.head), dtype=np.int32)
        for k, state in enumerate(heads, 1):
            self.longest = np.where(state >= 0, state + self.first[min(k, len(logs))], self.longest)

    def of(self, s: np.ndarray) -> np.ndarray:
        """The longest suffix of the history of every position from _HEAD on."""
        history = _histories(s)
        state, longest = self.head[history], self.longest[history]
        for k, (live, state) in enumerate(_descend(state, s, self.steps), _HEAD + 1):
            longest[live - _HEAD] = state + self.first[k]  # longer suffixes replace shorter
        return longest


def token_logs(texts: list[bytes], suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 probabilities under the tree of all words in order and of each text's end token,
    and the text of every word. Texts are joined tokens."""
    data, starts, ends = _joined(texts)
    predicted, s = _codes(data, ends, suffixes.symbol)
    table = suffixes.of(s) << 6
    each = suffixes.logs[table + s[_HEAD:]].astype(np.float64)
    each[~predicted[_HEAD:]] = 0
    raw = np.frombuffer(data, dtype=np.uint8)
    stops = raw == 0x20  # behind a word, or in place of any
    stops[ends] = True
    stop = np.flatnonzero(stops)
    go_on, finish = (
        suffixes.logs[table[stop - _HEAD] + k].astype(np.float64) for k in (int(suffixes.symbol[0x20]), END)
    )
    either = np.logaddexp(go_on * _LN10, finish * _LN10) / _LN10
    sums = np.concatenate((np.zeros(_HEAD + 1), np.cumsum(each)))
    text = np.searchsorted(ends, stop)
    opens = starts[text]
    again = np.flatnonzero(text[1:] == text[:-1])
    opens[again + 1] = stop[again] + 1
    filled = stop > opens  # not the lone stop of an empty text
    words = sums[stop] - sums[opens] + either
    words[1:] += np.where(text[1:] == text[:-1], go_on[:-1] - either[:-1], 0.0)
    last = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, dtype=bool)
    over = np.where(filled, finish - either, finish)[last]
    return words[filled], over, text[filled]


# ---- scores ---------------------------------------------------------------------------

_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(model, n: int, v: int):
    scale = math.log10(n + v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, logs = None, {}
        own, other = math.log(WORD_SHARE), math.log(1 - WORD_SHARE)
        mixed = lambda base, tree: np.logaddexp(base * _LN10 + own, tree * _LN10 + other) / _LN10
        suffixes = Suffixes(model.value)
        for batch in batches:
            chunk = batch.column("chunk").to_numpy()
            is_text = batch.column("kind").to_numpy()
            cuts = np.flatnonzero((chunk[1:] != chunk[:-1]) | (is_text[1:] != is_text[:-1])) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(chunk)]):
                if chunk[low] != at:
                    at, logs = chunk[low], {}
                if not is_text[low]:
                    words = batch.column("body").slice(low, high - low).cast(pa.binary()).to_pylist()
                    c = batch.column("number").slice(low, high - low).to_numpy(zero_copy_only=False)
                    logs.update(zip(words, (np.log10(c + 1.0) - scale).tolist()))
                    continue
                part = batch.slice(low, high - low)
                for start, end in text_slices(part, "body", _SLICE):
                    texts = texts_of(part, start, end, "body")
                    own_words = [text.split() for text in texts]
                    size, stop = np.fromiter(map(len, own_words), np.int64, len(texts)), logs[b""]
                    each = np.fromiter(map(logs.__getitem__, chain.from_iterable(own_words)), np.float64, size.sum())
                    words, over, of = token_logs(texts, suffixes)
                    base = np.bincount(of, each, minlength=len(texts)) + stop
                    known = np.bincount(of, each > -scale, minlength=len(texts)).astype(np.int64) + int(stop > -scale)
                    score = np.bincount(of, mixed(each, words), minlength=len(texts)) + mixed(np.full(len(texts), stop), over)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("number").slice(start, end - start), part.column("held_out").slice(start, end - start),
                         pa.array(size + 1), pa.array(known), pa.array(base),
                         pa.array(score)],
                        names=[c.split()[0] for c in _SCORED.split(", ")],
                    )

    return run


def score(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """One row per document row: counts, base_score, score, training size."""
    chunks = chunked(docs)
    known, n, v = word_counts(chunks)
    model = docs.sparkSession.sparkContext.broadcast(fit(chunks, share))  # bounded by DEPTH / share contexts
    both = known.select("chunk", F.lit(0).alias("kind"), F.col("word").alias("body"), F.col("c").alias("number"), F.lit(None).cast("boolean").alias("held_out")).unionByName(
        chunks.select("chunk", F.lit(1).alias("kind"), F.col("text").alias("body"), F.col("doc_id").alias("number"), "held_out")
    )
    scored = both.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(released(_score(model, n, v)), _SCORED)
    return scored.withColumn("train_tokens", F.lit(n).cast("long"))
