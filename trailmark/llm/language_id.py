"""Language identification: nearest of several TF-IDF n-gram centroids per language.

Texts are lower-cased and reduced to letters and single gaps; character n-grams of 1 to 3 are
hashed into `DIMS` dimensions, damped (1 + log tf), weighted by inverse document frequency and
normalised. Document frequencies cover every training text. Each language's training texts are
clustered (spherical k-means, `CLUSTERS` centroids) on a bounded sample: texts whose hash falls
below SAMPLE / n of the language's n texts, so about `SAMPLE` of them. A text gets the language
of the centroid with the highest cosine. It is marked as rejected when its distance exceeds the
centroid's radius (the REACH-quantile of the sample's distances, widened by SLACK).

Defined cases: null text or a text without a letter is `und` with score 0 and rejected; so is
every text when nothing was learned; the prediction stays the nearest language even when
rejected; rows with null lang or null doc_id teach nothing; ties go to the language that sorts
first; repeated rows come out alike; an empty table gives an empty result; other columns are
ignored. Long texts are counted whole, in pieces.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import mix64, stored, text_slices, texts_of

DIMS = 4096
SAMPLE = 1000
CLUSTERS = 4
ROUNDS = 12
REACH, SLACK = 0.999, 1.25
FOLDS = 5
UNKNOWN = "und"
_PIECE = 1 << 18
_DOCS = 256  # texts counted at once


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _piece_counts(points: np.ndarray, upto: int) -> np.ndarray:
    """Hashed n-gram counts of n-grams that start before `upto` (letters kept, gaps are 0)."""
    out = np.zeros(DIMS, dtype=np.int64)
    code = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, 4):
        if len(points) < n:
            break
        code = code[: len(points) - n + 1] * np.uint64(0x110001) + points[n - 1 :]
        use = code[: min(upto, len(code))]
        use = use[(points[: len(use)] > 0)] if n == 1 else use
        hashed = mix64(use + np.uint64(n << 60)) & np.uint64(DIMS - 1)
        out += np.bincount(hashed.astype(np.int64), minlength=DIMS)
    return out


def ngram_counts(text: str) -> tuple[np.ndarray, bool]:
    """Counts of one text, and whether it has a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(DIMS, dtype=np.int64), False
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one gap after each run of letters
    points = np.where(letter, points, 0)[keep].astype(np.uint64)
    out = np.zeros(DIMS, dtype=np.int64)
    for at in range(0, len(points), _PIECE):
        out += _piece_counts(points[at : at + _PIECE + 2], _PIECE)
    return out, True


def _counts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, counts, has letter) over bounded row ranges."""
    for start, end in text_slices(batch):
        for low in range(start, end, _DOCS):
            high = min(end, low + _DOCS)
            found = [ngram_counts(t.decode("utf-8")) for t in texts_of(batch, low, high)]
            yield low, high, np.stack([f[0] for f in found]), np.array([f[1] for f in found])


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(DIMS, dtype=np.int64), 0
    for batch in batches:
        for _, _, counts, letter in _counts(batch):
            total += (counts > 0).sum(axis=0)
            n += int(letter.sum())
    hit = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(hit, -1)), pa.array(np.append(total[hit], n))], ["dim", "n"]
    )


def cluster(x: np.ndarray, k: int = CLUSTERS) -> tuple[np.ndarray, np.ndarray]:
    """Centroids (unit length) and radii of rows in a fixed order; spherical k-means."""
    picks = [0]
    while len(picks) < min(k, len(x)):  # farthest point first
        nearest = (x @ x[picks].T).max(axis=1)
        if nearest.min() > 1 - 1e-6:
            break
        picks.append(int(nearest.argmin()))
    centers = x[picks].astype(np.float64)
    for _ in range(ROUNDS):
        own = (x @ centers.T).argmax(axis=1)
        centers = np.stack([x[own == c].sum(axis=0) if (own == c).any() else centers[c] for c in range(len(centers))])
        centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    near = x @ centers.T
    own, best = near.argmax(axis=1), 1 - near.max(axis=1)
    radii = np.array([np.quantile(best[own == c], REACH) * SLACK if (own == c).any() else 0.0 for c in range(len(centers))])
    return centers, radii


_CENTROIDS = "lang string, centroid binary, radius double"


def _train_language(idf: np.ndarray):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "text"], kind="stable")
        counts = [ngram_counts(t) for t in rows.text]
        counts = [c for c, letter in counts if letter]
        if not counts:
            return pd.DataFrame({"lang": [], "centroid": [], "radius": []})
        centers, radii = cluster(weigh(np.stack(counts), idf))
        return pd.DataFrame({
            "lang": rows.lang.iloc[0], "centroid": [c.astype(np.float32).tobytes() for c in centers], "radius": radii,
        })

    return run


def fit(docs: DataFrame, sample: int = SAMPLE):
    """(idf, languages of the centroids, centroids, radii); None when there is nothing to learn."""
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string"), F.col("lang").cast("string"))
    taught = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32("id") % FOLDS != 0))
    found = taught.select("text").mapInArrow(_frequencies, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).toPandas()
    n = int(found.n[found.dim == -1].sum())
    if not n:
        return None
    df = np.zeros(DIMS)
    own = found[found.dim >= 0]
    df[own.dim.to_numpy(dtype=np.int64)] = own.n.to_numpy(dtype=np.float64)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    sizes = stored(taught.groupBy(F.col("lang").alias("l")).agg(F.count(F.lit(1)).alias("n")), "languages")
    span = 1 << 53
    picked = (
        taught.withColumn("place", F.xxhash64(F.lit("sample"), "id").bitwiseAND(F.lit(span - 1)))
        .join(sizes, F.col("lang") == F.col("l"))
        .where(F.col("place") < F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n")) * span)
        .select("lang", "text", "place")
    )
    model = picked.groupBy("lang").applyInPandas(_train_language(idf), _CENTROIDS).toPandas()
    if model.empty:
        return None
    model = model.sort_values(["lang", "centroid"]).reset_index(drop=True)
    centers = np.stack([np.frombuffer(c, dtype=np.float32) for c in model.centroid])
    return idf, model.lang.to_numpy(), centers, model.radius.to_numpy()


_PREDICTED = "doc_id long, lang_pred string, score double, rejected boolean"


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for batch in batches:
            for low, high, counts, letter in _counts(batch):
                n = high - low
                lang, score, rejected = np.full(n, UNKNOWN, dtype=object), np.zeros(n), np.ones(n, dtype=bool)
                if fitted is not None:
                    idf, names, centers, radii = fitted
                    near = weigh(counts, idf) @ centers.T
                    best = near.argmax(axis=1)  # the first of equals: languages are sorted
                    cosine = near[np.arange(n), best].astype(np.float64)
                    lang[letter] = names[best[letter]]
                    score[letter] = np.clip(cosine[letter], 0.0, 1.0)
                    rejected = ~letter | (1 - cosine > radii[best])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, n), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                    [c.split()[0] for c in _PREDICTED.split(", ")],
                )

    return run


def predict(docs: DataFrame, model) -> DataFrame:
    """doc_id, lang_pred, score (cosine), rejected; one row per document row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few centroids per language
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_predict(shared), _PREDICTED)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the training rows of docs and predict all rows."""
    return predict(docs, fit(docs)).withColumn("held_out", held_out(F.col("doc_id")))
