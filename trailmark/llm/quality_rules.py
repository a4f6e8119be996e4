"""Quality rules: a linear-chain CRF marks lines as content or boilerplate.

Every line with a word is a position of the chain; its features are shares of character
classes, word statistics and repetition inside the document. Viterbi decoding labels the lines,
and a document stays when content lines hold at least `share` of its words and no base rule
(too few words, too many repeated word windows) fails.

The CRF is trained here, by maximum likelihood, on a bounded sample of labelled documents
(`SAMPLE_DOCS` ids of `labels` by hash, documents of up to `SAMPLE_LINES` lines): lines of good
documents are content, lines of bad ones and repeated lines are boilerplate. Counts and verdicts
cover all lines of all texts.

Defined cases: null text has no words (fails the word minimum); blank lines are no positions;
without labelled documents of both kinds every line is content; repeated rows come out alike;
labels that are null or name no document are ignored; an empty table gives an empty result;
other columns are ignored or, in `retained`, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import SPACES, free_name, mix64, released, text_slices, texts_of, word_hashes

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
CONTENT_SHARE = 0.5
SAMPLE_DOCS = 2000
SAMPLE_LINES = 300
EPOCHS = 120
_RATE, _PENALTY = 0.1, 1e-3

_SYMBOLS = b"#*$%&|<>"


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.uint8)
    out[np.frombuffer(members, dtype=np.uint8)] = 1
    return out


_CLASSES = np.stack([
    _table(_SYMBOLS),
    _table(bytes(range(65, 91))),
    _table(bytes(range(48, 58))),
    _table(b"!?"),
    _table(b".,;:"),
    (~SPACES & ((np.arange(256) & 0xC0) != 0x80)).astype(np.uint8),  # code points in words
])
FEATURES = 11


class Lines:
    """Lines, words and counts of a list of texts, as flat arrays."""

    def __init__(self, texts: list[bytes]):
        self.n_docs = len(texts)
        text = b"\n".join(texts)
        data = np.frombuffer(text, dtype=np.uint8)
        breaks = np.flatnonzero(data == 10)
        self.line_start = np.concatenate(([0], breaks + 1)).astype(np.int64)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        doc_start = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])) if len(texts) else np.zeros(0, np.int64)
        self.line_doc = np.searchsorted(doc_start, self.line_start, side="right") - 1
        self.hash, at = word_hashes(text)
        self.word_line = np.searchsorted(self.line_start, at, side="right") - 1
        self.word_doc = self.line_doc[self.word_line] if len(at) else np.zeros(0, np.int64)
        bounds = np.minimum(self.line_start, max(len(data) - 1, 0))
        empty = self.line_start >= len(data)
        self.classes = np.zeros((len(_CLASSES), len(self.line_start)), dtype=np.int64)
        if len(data):
            for k, member in enumerate(_CLASSES):
                self.classes[k] = np.add.reduceat(member[data], bounds, dtype=np.int64)
            self.classes[:, empty] = 0
        self.line_words = np.bincount(self.word_line, minlength=len(self.line_start))
        self.repeated = np.zeros(len(self.line_start), dtype=bool)
        line = 0
        for raw in texts:
            seen: set[bytes] = set()
            for piece in raw.split(b"\n"):
                if self.line_words[line]:
                    if piece in seen:
                        self.repeated[line] = True
                    else:
                        seen.add(piece)
                line += 1

    def per_doc(self, of_line: np.ndarray) -> np.ndarray:
        return np.bincount(self.line_doc, weights=of_line, minlength=self.n_docs).astype(np.int64)

    def repeat_words(self) -> np.ndarray:
        """Words per document inside 3-word windows that occur twice or more in it."""
        h, doc = self.hash, self.word_doc
        marked = np.zeros(len(h), dtype=bool)
        if len(h) >= 3:
            key = mix64(h[:-2] * np.uint64(3) + mix64(h[1:-1] * np.uint64(5) + mix64(h[2:] + doc[2:].astype(np.uint64))))
            at = np.flatnonzero(doc[:-2] == doc[2:])
            _, inverse, count = np.unique(key[at], return_inverse=True, return_counts=True)
            at = at[count[inverse] > 1]
            for k in range(3):
                marked[at + k] = True
        return np.bincount(doc[marked], minlength=self.n_docs)

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions, features): indices of the lines with words, and their features."""
        lines = np.flatnonzero(self.line_words)
        words = self.line_words[lines].astype(np.float64)
        symbols, upper, digits, shouts, stops, chars = (c[lines] for c in self.classes)
        key = mix64(self.hash + mix64(self.word_line.astype(np.uint64) + np.uint64(1)))
        _, first = np.unique(key, return_index=True)
        distinct = np.bincount(self.word_line[first], minlength=len(self.line_start))[lines]
        x = np.stack([
            np.ones(len(lines)),
            np.log1p(words) / 4,
            chars / words / 10,
            np.minimum(symbols / words, 3.0),
            upper / chars,
            digits / chars,
            np.minimum(shouts / words, 2.0),
            stops / words,
            distinct / words,
            (distinct / words) * np.log1p(words) / 4,
            self.repeated[lines].astype(np.float64),
        ], axis=1)
        return lines, x


# ---- the CRF --------------------------------------------------------------------------

def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(chains: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights (2, FEATURES) and transitions (2, 2) by likelihood; chains of (features, labels).

    Forward-backward over all chains at once, padded to the longest, Adam steps.
    """
    chains = sorted((c for c in chains if len(c[1])), key=lambda c: -len(c[1]))
    n, longest = len(chains), len(chains[0][1])
    lengths = np.array([len(y) for _, y in chains])
    x = np.zeros((longest, n, FEATURES))
    y = np.zeros((longest, n), dtype=np.int64)
    for k, (fx, fy) in enumerate(chains):
        x[: len(fy), k], y[: len(fy), k] = fx, fy
    live = np.arange(longest)[:, None] < lengths
    truth = np.eye(2)[y] * live[..., None]
    steps = np.einsum("tna,tnb->ab", truth[:-1], truth[1:])
    theta = np.zeros(2 * FEATURES + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    total = lengths.sum()
    for epoch in range(1, EPOCHS + 1):
        w, t = theta[: 2 * FEATURES].reshape(2, FEATURES), theta[2 * FEATURES :].reshape(2, 2)
        e = x @ w.T
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for k in range(1, longest):
            m = int(live[k].sum())
            alpha[k, :m] = e[k, :m] + _log_sum(alpha[k - 1, :m, :, None] + t, 1)
        for k in range(longest - 2, -1, -1):
            m = int(live[k + 1].sum())
            beta[k, :m] = _log_sum(t + (e[k + 1, :m] + beta[k + 1, :m])[:, None, :], 2)
        z = _log_sum(alpha[lengths - 1, np.arange(n)], 1)
        node = np.exp(alpha + beta - z[:, None]) * live[..., None]
        edge = np.exp(alpha[:-1, :, :, None] + t + (e[1:] + beta[1:])[:, :, None, :] - z[:, None, None])
        edge = (edge * live[1:, :, None, None]).sum(axis=(0, 1))
        grad = np.concatenate((np.einsum("tna,tnf->af", truth - node, x).ravel(), (steps - edge).ravel())) / total
        grad -= _PENALTY * theta
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta = theta + _RATE * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.999**epoch)) + 1e-8)
    return theta[: 2 * FEATURES].reshape(2, FEATURES), theta[2 * FEATURES :].reshape(2, 2)


def viterbi(emit: np.ndarray, step: np.ndarray) -> list[int]:
    """Best label sequence; ties go to content (1)."""
    (aa, ab), (ba, bb) = step.tolist()
    back, (s0, s1) = [], emit[0].tolist()
    for e0, e1 in emit[1:].tolist():
        from0, from1 = s0 + aa > s1 + ba, s0 + ab > s1 + bb
        back.append((0 if from0 else 1, 0 if from1 else 1))
        s0, s1 = (s0 + aa if from0 else s1 + ba) + e0, (s0 + ab if from1 else s1 + bb) + e1
    at = 0 if s0 > s1 else 1
    path = [at]
    for pair in reversed(back):
        at = pair[at]
        path.append(at)
    path.reverse()
    return path


# ---- Spark ----------------------------------------------------------------------------

def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        quality = batch.column("quality").to_pylist()
        for start, end in text_slices(batch):
            found = Lines(texts_of(batch, start, end))
            lines, x = found.features()
            doc = found.line_doc[lines]
            rows: list[tuple[bytes, bytes]] = []
            for k in range(end - start):
                own = np.flatnonzero(doc == k)
                if not 0 < len(own) <= SAMPLE_LINES:
                    continue
                good = (quality[start + k] == 1) & ~found.repeated[lines[own]]
                rows.append((x[own].tobytes(), good.astype(np.int8).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["x", "y"])


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, np.ndarray] | None:
    """CRF weights from at most sample_docs labelled documents; None without both kinds."""
    sample = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64(F.col("doc_id"), F.lit("sample")), "doc_id").limit(sample_docs)
    )
    rows = (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .join(F.broadcast(sample), "doc_id")  # at most sample_docs rows
        .select("text", "quality").mapInArrow(released(_sample_rows), "x binary, y binary").toPandas()
    )
    chains = sorted(zip(rows.x, rows.y))
    chains = [(np.frombuffer(x).reshape(-1, FEATURES), np.frombuffer(y, dtype=np.int8)) for x, y in chains]
    if len({int(v) for _, y in chains for v in np.unique(y)}) < 2:
        return None
    return train(chains)


_JUDGED = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, content_share double"
)


def judge(texts: list[bytes], model, share: float = CONTENT_SHARE) -> list[np.ndarray]:
    """The columns after doc_id for a list of texts."""
    found = Lines(texts)
    n_words = np.bincount(found.word_doc, minlength=found.n_docs)
    repeats = found.repeat_words()
    lines, x = found.features()
    good = np.ones(len(lines), dtype=np.int64)
    if model is not None and len(lines):
        emit = x @ model[0].T
        doc = found.line_doc[lines]
        cuts = np.flatnonzero(np.diff(doc)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(doc)]):
            good[start:end] = viterbi(emit[start:end], model[1])
    content = np.bincount(found.line_doc[lines], weights=good * found.line_words[lines], minlength=found.n_docs)
    content = np.where(n_words > 0, content / np.maximum(n_words, 1), 0.0)
    failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)
    return [
        n_words, found.per_doc(found.classes[-1]), found.per_doc(found.classes[0]), found.per_doc(found.repeated), repeats,
        failed, ~failed & (content >= share), content,
    ]


def _judge(model, share: float):
    names = [c.split()[0] for c in _JUDGED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in text_slices(batch):
                columns = judge(texts_of(batch, start, end), model, share)
                arrays = [pa.array(c if c.dtype in (bool, np.float64) else c.astype(np.int64)) for c in columns]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), *arrays], names)

    return run


def assess(docs: DataFrame, labels: DataFrame, share: float = CONTENT_SHARE) -> DataFrame:
    """One row per document row: counts, base verdict, verdict and content share."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(released(_judge(fit(docs, labels), share)), _JUDGED)


def _retained(model, share: float, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in text_slices(batch, text):
                kept = judge(texts_of(batch, start, end, text), model, share)[6]
                rows = batch.slice(start, end - start)
                yield rows.filter(pa.array(kept)).select(batch.schema.names[:-1])

    return run


def retained(docs: DataFrame, labels: DataFrame, share: float = CONTENT_SHARE) -> DataFrame:
    """The documents that pass, with all their columns; decided row by row, without a join."""
    model, text = fit(docs, labels), free_name(docs, "_text")
    return docs.withColumn(text, F.col("text").cast("string")).mapInArrow(released(_retained(model, share, text)), docs.schema)
