"""License scan: MinHash bands over overlapping windows retrieve templates, containment verifies.

Texts and templates are words: A-Z lowered, common punctuation read as white space; shingles are
five words (a shorter text or template is one shingle). Templates of about m shingles (groups
whose sizes differ by less than `SPREAD` times, m the largest) are looked for in windows of 2 m
shingles that start every m / 2, so a copy with up to half as much inserted text lies inside one
window. A window and a template meet when a band of `ROWS` minima agrees. A window that holds
the share c of the n shingles of a template has a Jaccard similarity of at least
j = c n / (2 m + n - c n); the number of bands is chosen so that such a pair is missed with a
probability of at most `MISS`: log(MISS) / log(1 - j^ROWS). Windows are laid over whole slices of
the table; shingles never cross documents, and a window that does is verified by document.
Windows that meet a template are verified: the share of the template's distinct shingles found in
the window, within one document, must reach CONTAINMENT exactly.

The templates are a parameter of bounded size (a license collection, a few MB) and travel with
the tasks; documents are scanned where they lie, without a shuffle.

Defined cases: null or blank text has no matches; a template without words never matches; of two
templates with the same words both are reported; repeated rows repeat; an empty table gives an
empty result; other columns are ignored. Texts are scanned whole.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import SPACES, mix64, text_slices, texts_of, word_hashes

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
ROWS = 1
MISS = 1e-4
SPREAD = 1.5

# Names and wording of public license notices.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
            "and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the "
                   "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of "
                "the GNU General Public License as published by the Free Software Foundation."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)

_GAPS = bytes.maketrans(b".,;:!?()[]{}\"'", b" " * 14)


def prepared(text: bytes) -> bytes:
    return text.lower().translate(_GAPS)  # bytes: A-Z only; positions stay


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five words; of the whole when there are fewer."""
    n = min(SHINGLE_WORDS, len(words))
    if not n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = mix64(out + words[k : len(words) - n + 1 + k] + np.uint64(k + 1))
    return out


def bands_needed(n: int, m: int, containment: float = CONTAINMENT, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands for templates of n or more shingles in windows of 2 m."""
    j = containment * n / (2 * m + n - containment * n)
    return max(1, math.ceil(math.log(miss) / math.log(1 - j**rows)))


def _permuted(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th order of already mixed hashes: exclusive or, then an odd multiplier."""
    a, b = mix64(np.array([2 * k + 1, 2 * k + 2], dtype=np.uint64))
    return (values ^ a) * (b | np.uint64(1))


class Templates:
    """Template shingles, grouped by their number, with band values per group."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.names = [name for name, _ in templates]
        self.sets = [np.unique(shingles(word_hashes(prepared(text.encode("utf-8")))[0])) for _, text in templates]
        self.groups: list[tuple[int, int, list[list[dict[int, list[int]]]]]] = []
        order = sorted((len(own), t) for t, own in enumerate(self.sets) if len(own))
        while order:
            least = order[0][0]
            members = [t for n, t in order if n < SPREAD * least]
            order = order[len(members) :]
            m = max(len(self.sets[t]) for t in members)
            count = bands_needed(least, m)
            bands: list[dict[int, list[int]]] = [{} for _ in range(count)]
            for t in members:
                minima = np.array([_permuted(self.sets[t], k).min() for k in range(count * ROWS)])
                for table, key in zip(bands, band_keys(minima.reshape(count, ROWS).T).tolist()):
                    table.setdefault(key, []).append(t)
            self.groups.append((m, count, bands))


def band_keys(minima: np.ndarray) -> np.ndarray:
    """One key per column of (ROWS, n) minima."""
    key = minima[0]
    for row in minima[1:]:
        key = mix64(key) ^ row
    return key


@functools.lru_cache(maxsize=2)
def _templates(templates: tuple[tuple[str, str], ...]) -> Templates:
    return Templates(templates)


def retrieved(values: np.ndarray, templates: Templates) -> set[tuple[int, int, int]]:
    """(start, end, template) of the windows of shingle hashes that meet a template in a band."""
    out: set[tuple[int, int, int]] = set()
    if not len(values):
        return out
    for m, count, bands in templates.groups:
        step = max(1, m // 2)
        across = -(-2 * m // step)  # steps in a window
        blocks = np.arange(0, len(values), step)
        for b in range(count):
            rows = []
            for r in range(ROWS):
                low = _permuted(values, b * ROWS + r)
                if step > 1:
                    low = np.minimum.reduceat(low, blocks)
                width = 1  # minima over `across` steps, by doubling
                while width < across:
                    by = min(width, across - width)
                    low[:-by] = np.minimum(low[:-by], low[by:]) if by < len(low) else low[:-by]
                    width += by
                rows.append(low)
            key = band_keys(np.stack(rows)) if ROWS > 1 else rows[0]
            known = np.array(sorted(bands[b]), dtype=np.uint64)
            if len(known) <= 8:
                hit = np.zeros(len(key), dtype=bool)
                for value in known:
                    hit |= key == value
            else:
                hit = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
            for w in np.flatnonzero(hit).tolist():
                for t in bands[b][int(key[w])]:
                    out.add((w * step, min(w * step + across * step, len(values)), t))
    return out


def slice_matches(texts: list[bytes], templates: Templates) -> list[list[tuple[int, int, str]]]:
    """Per text: (start, end, name) of verified matches, in code points, end exclusive; sorted."""
    joined = prepared(b"\n".join(texts))
    hashes, at = word_hashes(joined)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begins = np.cumsum(sizes + 1) - sizes - 1
    doc = np.searchsorted(begins, at, side="right") - 1
    first = np.searchsorted(doc, np.arange(len(texts)))
    n_words = np.bincount(doc, minlength=len(texts))
    n = SHINGLE_WORDS
    if len(hashes) >= n:
        inner = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
        values = shingles(hashes)[inner]
    else:
        inner, values = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    short = np.flatnonzero((n_words > 0) & (n_words < n))  # one shingle of all words
    if len(short):
        whole = [shingles(hashes[first[k] : first[k] + n_words[k]])[0] for k in short.tolist()]
        inner, values = np.append(inner, first[short]), np.append(values, np.array(whole, dtype=np.uint64))
        order = np.argsort(inner, kind="stable")
        inner, values = inner[order], values[order]
    owner = doc[inner]
    found: dict[tuple[int, int], set[int]] = {}
    for start, end, t in retrieved(values, templates):
        own = templates.sets[t]
        hit = np.flatnonzero(np.isin(values[start:end], own)) + start
        for k in np.unique(owner[hit]).tolist():
            mine = hit[owner[hit] == k]
            if len(np.unique(values[mine])) >= CONTAINMENT * len(own) - 1e-9:
                found.setdefault((k, t), set()).update(inner[mine].tolist())
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    gaps = SPACES[np.frombuffer(joined + b" ", dtype=np.uint8)]
    for (k, t), places in found.items():
        word = np.array(sorted(places))
        limit = first[k] + n_words[k] - 1
        points = None
        for run in np.split(word, np.flatnonzero(np.diff(word) > len(templates.sets[t])) + 1):  # occurrences
            begin, stop = int(at[run[0]]), int(at[min(run[-1] + n - 1, limit)])
            stop += int(np.argmax(gaps[stop:]))
            if points is None:
                raw = np.frombuffer(texts[k], dtype=np.uint8)
                points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
            out[k].append((int(points[begin - begins[k]]), int(points[stop - begins[k]]), templates.names[t]))
    return [sorted(set(own)) for own in out]


def matches(text: bytes, templates: Templates) -> list[tuple[int, int, str]]:
    return slice_matches([text], templates)[0]


_FOUND = "doc_id long, matches array<struct<start: long, end: long, name: string>>"
_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("name", pa.string())]))


def _scan(templates: tuple[tuple[str, str], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _templates(templates)
        for batch in batches:
            for start, end in text_slices(batch):
                found = [
                    [{"start": a, "end": b, "name": name} for a, b, name in own]
                    for own in slice_matches(texts_of(batch, start, end), known)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.array(found, _TYPE)], ["doc_id", "matches"]
                )

    return run


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """doc_id and the verified matches of every document row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan(templates), _FOUND)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_matches, licenses (distinct names), spans (name:start:end), comma-joined."""
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.sort_array(F.array_distinct("matches.name")), ",").alias("licenses"),
        F.expr("array_join(transform(matches, m -> concat(m.name, ':', m.start, ':', m.end)), ',')").alias("spans"),
    )
