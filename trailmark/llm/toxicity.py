"""Toxicity: a weighted finite-state grammar over the clauses of a text.

Tokens are mapped to symbols (insult, threat verb, intent, target, negation, report, quote; a
token may have several). Five small transducers read the symbols of a clause:

    negation   marks what follows a negation for `SCOPE` tokens
    report     marks what follows a verb of saying, and what stands in quotation marks
    target     marks the clause once somebody is addressed
    insult     emits a hit at an insult, with the weight of the token
    threat     emits a hit at a threat verb while an intent is open (`SCOPE` tokens)

`compose` runs them in step as one machine. A hit is plain, negated or reported; the clause's
pattern is (insult or threat, mode, aimed at somebody or not), its weight the sum of its hits.
Isolated words never count: a document is scored by a logistic model over the weights of its
matched clauses per pattern.

Insults are learned: whole words and word beginnings of 3 to 7 letters whose share of toxic
texts is above that of the others beyond chance, besides fixed seed words. Near copies teach
once (one text per smallest shingle hash and label). The words come from three of the four
training folds, the pattern weights from the last, drawn towards `PRIOR`. Both use a bounded
sample: about SAMPLE labelled documents, chosen by hash; at most LEXICON entries.

Defined cases: null and empty texts have no clause and get the score of a text without one; rows
without a label or doc_id teach nothing, of repeated labels the larger counts; without training
rows the seeds and PRIOR score alone; repeated rows come out alike; an empty table gives an empty
result; other columns are ignored. Long texts are read whole, in pieces cut between clauses.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Hashable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import mix64, phrase_hashes, stored, text_slices, texts_of, word_hashes

FOLDS = 5
SAMPLE = 20_000
LEXICON = 20_000
SCOPE = 4
CHANCE = 0.05
CONTINUATIONS, BRANCHING = 3, 0.8  # a beginning goes when its so many largest continuations have this share of all
MIN_WEIGHT = 1.0
SEED_WEIGHT = 2.0
STEMS = range(3, 8)
_PIECE = 1 << 20
_MEMO = 1 << 18
_FLUSH = 1 << 20

INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT, QUOTE = (1 << k for k in range(7))

# Word lists: English, German, French, Spanish.
SEEDS = """idiot idiots moron morons stupid pathetic worthless disgusting scum trash loser losers clown garbage
    idiotisch dumm dummkopf abschaum erbärmlich versager idiote imbécile crétin ordure minable idiota
    imbécil estúpido basura escoria""".split()
THREATS = """kill hurt destroy beat burn hunt töten umbringen schlagen vernichten tuer frapper détruire brûler matar
    golpear destruir quemar""".split()
INTENTS = "will gonna going shall werde werden vais allons voy vamos".split()
TARGETS = """you your yours yourself u du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti tus usted
    vosotros ustedes""".split()
NEGATIONS = """not no never nobody isn aren don doesn won nicht kein keine keiner nie niemals ne pas jamais aucun
    nunca jamás ningún tampoco""".split()
REPORTS = """said says wrote writes called calls claimed claims quoted reported sagte sagt schrieb nannte behauptete dit
    écrit appelé prétend dijo dice escribió llamó""".split()
QUOTES = "\"“”„«»"

_TOKEN = re.compile(rf"[^\W\d_]+|[{QUOTES}]")
_WORD = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"[.!?;\n]+|\b(?:but|aber|mais|pero)\b")
_CLASSES = ((THREATS, THREAT), (INTENTS, INTENT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (QUOTES, QUOTE))
FIXED: dict[str, int] = {}
for _words, _symbol in _CLASSES:
    for _w in _words:
        FIXED[_w] = FIXED.get(_w, 0) | _symbol

KINDS, MODES = ("insult", "threat"), ("plain", "negated", "reported")
PATTERNS = [f"{kind} {mode}{aim}" for kind in KINDS for mode in MODES for aim in ("", " aimed")]
# Weights of the patterns before anything is learned, and of a text without a clause.
PRIOR = np.array([2.0, 2.5, 0.5, 0.6, 0.6, 0.8, 1.5, 2.5, 0.3, 0.4, 0.4, 0.6])
PRIOR_BASE = -3.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


# ---- transducers ----------------------------------------------------------------------

State = Hashable
Transducer = tuple[State, Callable[[State, int], tuple[State, int]]]  # start; step: symbol to state, marks

HIT_INSULT, HIT_THREAT, IS_NEGATED, IS_REPORTED, IS_AIMED = (1 << k for k in range(5))


def _negation(left: int, symbol: int) -> tuple[int, int]:
    after = SCOPE if symbol & NEGATION else max(0, left - 1)
    return after, IS_NEGATED * (left > 0)


def _report(state: tuple[bool, bool], symbol: int) -> tuple[tuple[bool, bool], int]:
    said, quoted = state
    after = (said or bool(symbol & REPORT), quoted ^ bool(symbol & QUOTE))
    return after, IS_REPORTED * (said or quoted)


def _target(seen: bool, symbol: int) -> tuple[bool, int]:
    after = seen or bool(symbol & TARGET)
    return after, IS_AIMED * after


def _insult(state: int, symbol: int) -> tuple[int, int]:
    return 0, HIT_INSULT * bool(symbol & INSULT)


def _threat(left: int, symbol: int) -> tuple[int, int]:
    after = SCOPE if symbol & INTENT else max(0, left - 1)
    return after, HIT_THREAT * (left > 0 and bool(symbol & THREAT))


def compose(*machines: Transducer) -> Transducer:
    """One machine that runs all in step; its arcs are worked out once and kept."""
    arcs: dict[tuple[State, int], tuple[State, int]] = {}

    def step(state: State, symbol: int) -> tuple[State, int]:
        arc = arcs.get((state, symbol))
        if arc is None:
            moved = [run(s, symbol) for s, (_, run) in zip(state, machines)]
            arc = arcs[state, symbol] = (tuple(s for s, _ in moved), functools.reduce(int.__or__, (m for _, m in moved)))
        return arc

    return tuple(start for start, _ in machines), step


START, STEP = compose((0, _negation), ((False, False), _report), (False, _target), (0, _insult), (0, _threat))


def match_clause(symbols: Iterable[tuple[int, float]]) -> dict[int, float]:
    """Weight of each pattern of one clause of (symbol, weight)."""
    state, aimed, hits = START, 0, []
    for symbol, weight in symbols:
        state, marks = STEP(state, symbol)
        aimed = marks & IS_AIMED
        if marks & (HIT_INSULT | HIT_THREAT):
            mode = 2 if marks & IS_REPORTED else 1 if marks & IS_NEGATED else 0
            hits += [(kind, mode, weight) for kind, bit in ((0, HIT_INSULT), (1, HIT_THREAT)) if marks & bit]
    found: dict[int, float] = {}
    for kind, mode, weight in hits:
        pattern = 6 * kind + 2 * mode + bool(aimed)
        found[pattern] = found.get(pattern, 0.0) + weight
    return found


# ---- reading texts --------------------------------------------------------------------

class Lexicon:
    """Symbols and weights of tokens: fixed classes, seed words, learned words and beginnings."""

    def __init__(self, learned: dict[str, float]):
        """Beginnings end in `*`."""
        self.learned = dict.fromkeys(SEEDS, SEED_WEIGHT) | learned
        self.memo: dict[str, tuple[int, float]] = {}

    def look_up(self, token: str) -> tuple[int, float]:
        found = self.memo.get(token)
        if found is None:
            keys = [token, *(token[:n] + "*" for n in STEMS if n <= len(token))]
            weight = max((self.learned[k] for k in keys if k in self.learned), default=0.0)
            symbol = FIXED.get(token, 0) | INSULT * (weight > 0)
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            found = self.memo[token] = (symbol, weight or SEED_WEIGHT)
        return found


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    """A text in pieces that end between clauses, or else between words."""
    start = 0
    while len(text) - start > _PIECE:
        cut = next((m.end() for m in _BREAK.finditer(text, start + _PIECE, start + 2 * _PIECE)), 0)
        if not cut:
            cut = next((m.end() for m in re.compile(r"\s").finditer(text, start + _PIECE)), len(text))
        yield start, text[start:cut]
        start = cut
    yield start, text[start:]


def clauses(text: str, lexicon: Lexicon) -> list[tuple[int, int, int, float]]:
    """(start, end, pattern, weight) of the matched clauses; positions in the lower-cased text."""
    out = []
    for offset, piece in _pieces(text.lower()):
        if not any(lexicon.look_up(t)[0] & (INSULT | THREAT) for t in set(_WORD.findall(piece))):
            continue
        at = 0
        for end, after in [*((m.start(), m.end()) for m in _BREAK.finditer(piece)), (len(piece), len(piece))]:
            symbols = [lexicon.look_up(t) for t in _TOKEN.findall(piece, at, end)]
            if any(s & (INSULT | THREAT) for s, _ in symbols):
                found = match_clause(symbols)
                out += [(offset + at, offset + end, p, w) for p, w in found.items()]
            at = after
    return out


def features(found: list[tuple[int, int, int, float]]) -> np.ndarray:
    total = np.zeros(len(PATTERNS))
    for _, _, pattern, weight in found:
        total[pattern] += weight
    return np.log1p(total)


# ---- learning -------------------------------------------------------------------------

def _entries(text: str) -> set[str]:
    """Words and beginnings that a text holds; beginnings only of longer words."""
    own = {t for t in _WORD.findall(text.lower()) if len(t) <= 30}
    return own | {t[:n] + "*" for t in own for n in STEMS if n < len(t)}


def _entry_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(held)
        batch = pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], pa.string()), pa.array([y for _, y in keys], pa.int32()),
             pa.array([held[k] for k in keys], pa.int64())],
            ["entry", "toxic", "n"],
        )
        held.clear()
        return batch

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            held.update((e, toxic) for e in _entries(text))
            if len(held) >= _FLUSH:
                yield flush()
    if held:
        yield flush()


def _sampled(rows: DataFrame, key: Column, sample: int) -> DataFrame:
    n = max(1, rows.count())
    span = 1 << 53
    place = F.xxhash64(F.lit("sample"), key).bitwiseAND(F.lit(span - 1))
    return rows.where(place < F.lit(min(1.0, sample / n) * span))


def _copy_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the smallest hash of three words: near copies mostly share it."""
    for batch in batches:
        for start, end in text_slices(batch):
            keys = np.zeros(end - start, dtype=np.uint64)
            for k, text in enumerate(texts_of(batch, start, end)):
                shingles = phrase_hashes(word_hashes(text)[0], 3)
                keys[k] = shingles.min() if len(shingles) else mix64(np.uint64([zlib.crc32(text)]))[0]
            yield batch.slice(start, end - start).append_column("key", pa.array(keys.view(np.int64)))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic, last) of the sample; `last` marks the rows that fit the pattern weights."""
    known = stored(
        labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .withColumn("fold", F.crc32(F.col("doc_id").cast("string")) % FOLDS).where("fold <> 0"),
        "toxic-labels",
    )
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.col("text").isNotNull())
    # about `sample` ids of 8 bytes: a bounded broadcast
    taught = texts.join(F.broadcast(_sampled(known, F.col("doc_id"), sample)), "doc_id")
    single = stored(
        taught.select("text", "toxic", "fold").mapInArrow(_copy_keys, "text string, toxic int, fold long, key long")
        .groupBy("key", "toxic").agg(F.min(F.struct("text", "fold")).alias("t"))
        .select("t.text", "toxic", (F.col("t.fold") == FOLDS - 1).alias("last")),
        "toxic-texts",
    )
    return _sampled(single, F.col("text"), sample)  # ids may repeat in documents


def _parent(entry: str) -> str:
    """The next shorter beginning of a word or beginning."""
    stem = entry.rstrip("*")
    return stem[: min(len(stem) - 1, STEMS[-1])] + "*"


def chosen_entries(found: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Weights of entries (texts, weight): a beginning needs several continuations, and replaces them."""
    below: dict[str, list[int]] = {}
    for entry, (texts, _) in found.items():
        below.setdefault(_parent(entry), []).append(texts)
    narrow = {e for e, n in below.items() if sum(sorted(n)[-CONTINUATIONS:]) >= BRANCHING * sum(n)}
    wide = {e: w for e, (_, w) in found.items() if e not in narrow}
    return {
        e: w for e, w in wide.items()
        if not any(wide.get(e[:k] + "*", 0.0) >= w for k in STEMS if k < len(e.rstrip("*")))
    }


def learn_lexicon(rows: DataFrame, size: int = LEXICON) -> dict[str, float]:
    """Entries whose share of toxic texts cannot be chance, with the lower bound of their log odds."""
    totals = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    p, n = totals.get(1, 0), totals.get(0, 0)
    if not p or not n:
        return {}
    counts = stored(
        rows.select("text", "toxic").mapInArrow(_entry_counts, "entry string, toxic int, n long")
        .groupBy("entry")
        .agg(F.sum(F.expr("if(toxic = 1, n, 0)")).alias("pos"), F.sum(F.expr("if(toxic = 0, n, 0)")).alias("neg")),
        "toxic-entries",
    )
    pos, neg, both = F.col("pos"), F.col("neg"), F.col("pos") + F.col("neg")
    toxic, clean = pos + 0.5, neg + 0.5
    odds = F.log(toxic / (p + 1)) - F.log(clean / (n + 1)) - 1.64 * F.sqrt(1 / toxic + 1 / clean)
    # likelihood ratio against the common rate; over all entries tested, one chance hit in 1 / CHANCE
    gain = pos * F.log(pos / both * (p + n) / p) + F.when(neg > 0, neg * F.log(neg / both * (p + n) / n)).otherwise(0.0)
    best = (
        counts.where((pos > 0) & (pos * n > neg * p) & (gain >= math.log(max(1, counts.count()) / CHANCE)))
        .withColumn("weight", odds).where(F.col("weight") >= MIN_WEIGHT)
        .orderBy(F.desc("weight"), "entry").limit(size).collect()
    )
    return chosen_entries({r.entry: (r.pos, r.weight) for r in best})


def fit_patterns(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Base and pattern weights: logistic regression drawn towards PRIOR, by Newton steps."""
    prior = np.append(PRIOR_BASE, PRIOR)
    strength = np.append(0.1, np.ones(len(PRIOR)))
    x1 = np.column_stack([np.ones(len(x)), x])
    w = prior.copy()
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        slope = x1.T @ (y - q) - strength * (w - prior)
        step = np.linalg.solve((x1 * (q * (1 - q))[:, None]).T @ x1 + np.diag(strength), slope)
        w = w + step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _feature_rows(learned: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(learned)
        for batch in batches:
            x = [features(clauses(t, lexicon)).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], np.ndarray]:
    """Learned entries, and the base and pattern weights."""
    rows = training_rows(docs, labels, sample)
    learned = learn_lexicon(rows.where(~F.col("last")))
    kept = rows.where("last").select("text", "toxic").mapInArrow(_feature_rows(learned), "x array<double>, toxic int")
    found = kept.collect()  # bounded by the sample
    found.sort(key=lambda r: (r.toxic, r.x))
    x = np.array([r.x for r in found]).reshape(-1, len(PATTERNS))
    return learned, fit_patterns(x, np.array([r.toxic for r in found], dtype=float))


# ---- scoring --------------------------------------------------------------------------

_CLAUSE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.string()), ("weight", pa.float64())])
_SCORED = "doc_id long, score double, clauses array<struct<start int, end int, pattern string, weight double>>"


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, weights = shared.value
        lexicon = Lexicon(learned)
        for batch in batches:
            for start, end in text_slices(batch):
                scores, matched = [], []
                for text in texts_of(batch, start, end):
                    found = clauses(text.decode("utf-8"), lexicon)
                    z = float(weights[0] + features(found) @ weights[1:])
                    scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                    matched.append([{"start": s, "end": e, "pattern": PATTERNS[p], "weight": w} for s, e, p, w in found])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.array(scores), pa.array(matched, pa.list_(_CLAUSE))],
                    ["doc_id", "score", "clauses"],
                )

    return run


def score(docs: DataFrame, model: tuple[dict[str, float], np.ndarray]) -> DataFrame:
    """doc_id, score and the matched clauses (positions in the lower-cased text), per document row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most LEXICON entries
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_score(shared), _SCORED)


def assess(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learn from the labelled training rows and score all rows: held_out, predicted beside `score`."""
    return score(docs, fit(docs, labels, sample)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses",
    )
