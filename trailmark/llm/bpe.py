"""Exact BPE encoding by per-prefix dynamic programming, and decoding.

A word's encoding is found left to right: for every prefix the unique last token of its own
encoding is stored. The tokens that end at a position come from an automaton over the whole
vocabulary; a token t may end the prefix when the last token of the prefix before t is
compatible with it, that is, when BPE applied to the two tokens' text gives just these two.
Exactly one candidate passes, and following the stored tokens back from the end gives the ids.
No merge loop runs over the word, so a word of any length takes time in proportion to it.

The tokenizer file's own rules are applied around that: added tokens found in the raw text
stand alone, the rest is NFC-normalised, lower-cased code point by code point and cut into
pieces by the file's pattern; pieces are mapped to byte characters and end in the file's suffix.

Defined cases: null text encodes as empty (no ids); empty or blank text likewise; added tokens
in the text become their ids; repeated rows repeat; an empty table gives an empty result; other
columns are ignored. Texts of any length are encoded whole.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import release_memory, text_slices, texts_of

CACHED_WORDS = 160_000  # pieces remembered per worker, half of them for sure the latest ones used
CACHED_PAIRS = 400_000
_LONGEST_CACHED = 48
_SYMBOL = 0xE000  # neither letter nor number nor space


def default_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


# Letters of Unicode 17 and later. The tokenizers library's patterns follow Unicode
# 16 and treat them as symbols; the `regex` module knows them as letters.
LATER_LETTERS = (
    (0x0558, 0x0558), (0x058B, 0x058C), (0x088F, 0x088F), (0x0C5C, 0x0C5C), (0x0CDC, 0x0CDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2),
    (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
)
# First and last capital, and the first small letter, that the interpreter's tables lack.
LATER_CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x019B),
    (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)


@functools.lru_cache(maxsize=1)
def later_letters() -> tuple[regex.Pattern, dict[int, int], dict[int, int]]:
    """A pattern that finds any of them, letters to a symbol, capitals to small letters."""
    ranges = [*LATER_LETTERS, *((a, b) for a, b, _ in LATER_CAPITALS)]
    found = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]")
    symbols = {c: _SYMBOL for a, b in LATER_LETTERS for c in range(a, b + 1)}
    small = {c: low + c - a for a, b, low in LATER_CAPITALS for c in range(a, b + 1)}
    return found, symbols, small


def _is_latin(text: str) -> bool:
    """Whether all code points are below U+0100; much cheaper than a search, and true of most texts."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_characters() -> list[str]:
    """The printable character of every byte: itself where printable, else from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in set(shown)]
    names = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder of one tokenizer file (BPE with word-end suffix, byte characters)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        pattern = next(
            p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"
        )
        self.pieces = regex.compile(pattern)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.bytes = byte_characters()
        # the step at which a pair merges, and the pair that made each token
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int]] = {}
        self.step: dict[int, int] = {}
        for k, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = (vocab[left], vocab[right])
            token = vocab[left + right]
            self.rank.setdefault(pair, k)
            if token not in self.made:
                self.made[token] = pair
                self.step[token] = k
        self.automaton = ahocorasick.Automaton()
        end = "\n"  # stands for the suffix: never a byte character
        for token, i in vocab.items():
            if self.suffix and token.endswith(self.suffix):
                body = token[: -len(self.suffix)]
                if body:
                    self.automaton.add_word(body + end, (len(body) + 1, i))
            else:
                self.automaton.add_word(token, (len(token), i))
        self.automaton.make_automaton()
        self.compatible: dict[int, bool] = {}  # by left << 32 | right
        self.shown = {i: (str(i), name) for i, name in self.names.items()}
        # ids and tokens of pieces: those used since the last turn, and those used in the turn before
        self.words: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}

    def pair_fits(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' text gives these two tokens.

        Undo the later merge of the two sides again and again, looking at the pair that touches
        at the seam: had it merged before the side it belongs to was built, the seam would not
        have stayed.
        """
        key = left << 32 | right
        known = self.compatible.get(key)
        if known is not None:
            return known
        rank, made, step = self.rank, self.made, self.step
        # steps until which the parts at the seam exist unmerged
        left_until = right_until = len(rank) + len(self.names)
        fits = True
        while True:
            at = rank.get((left, right))
            # equal steps: merges go from left to right, so the seam yields to the left side
            if at is not None and at < left_until and at <= right_until:
                fits = False
                break
            left_step, right_step = step.get(left, -1), step.get(right, -1)
            if left_step < 0 and right_step < 0:
                break
            if left_step > right_step:
                left, left_until = made[left][1], left_step
            elif right_step > left_step:
                right, right_until = made[right][0], right_step
            else:  # the same merge on both sides: the right one came last
                right, right_until = made[right][0], right_step
        if len(self.compatible) >= CACHED_PAIRS:
            self.compatible.clear()
        self.compatible[key] = fits
        return fits

    def encode_mapped(self, word: str) -> list[int]:
        """Ids of a non-empty word in byte characters."""
        n = len(word) + bool(self.suffix)  # the last place is that of the suffix
        within = n - 2 if self.suffix else n  # only a token with the suffix may end the word
        last, back, found = [-1] * (n + 1), [0] * (n + 1), -1
        known, fits = self.compatible.get, self.pair_fits
        # matches come by their last place, the longest first; one of them passes
        for at, (size, token) in self.automaton.iter(word + "\n" if self.suffix else word):
            if at == found or at == within:
                continue
            start = at + 1 - size
            if start:
                left = last[start]
                if left < 0:
                    continue
                ok = known(left << 32 | token)
                if not (fits(left, token) if ok is None else ok):
                    continue
            found = at
            last[at + 1], back[at + 1] = token, start
        ids, at = [], n
        while at:
            ids.append(last[at])
            at = back[at]
        ids.reverse()
        return ids

    def piece(self, piece: str) -> tuple[str, str]:
        """Ids and tokens of one pre-token, each joined by one space."""
        both = self.words.get(piece) or self.older.get(piece)
        if both is None:
            mapped = "".join([self.bytes[b] for b in piece.encode("utf-8")]) if not (piece.isascii() and piece.isprintable()) else piece
            ids = self.encode_mapped(mapped)
            both = self.shown[ids[0]] if len(ids) == 1 else (self.ids_text(ids), self.decode(ids))
        if len(piece) <= _LONGEST_CACHED:
            if len(self.words) >= CACHED_WORDS // 2:
                self.words, self.older = {}, self.words
            self.words[piece] = both
        return both

    def normalised(self, text: str) -> str:
        """NFC, then lower case of each code point by itself (no final-sigma rule)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text cut at added tokens; True marks an added token."""
        at = 0
        if self.special is not None and "<|" in text:
            for m in self.special.finditer(text):
                yield text[at : m.start()], False
                yield m[0], True
                at = m.end()
        yield text[at:], False

    def cut(self, text: str) -> list[str]:
        """Pieces of a text, normalised, by the file's pattern."""
        if not text.isascii() and not _is_latin(text):
            found, symbols, small = later_letters()
            if found.search(text):
                text = self.normalised(text).translate(small)
                return [text[m.start() : m.end()] for m in self.pieces.finditer(text.translate(symbols))]
        return self.pieces.findall(self.normalised(text))

    def coded(self, text: str) -> tuple[str, str]:
        """Ids and tokens of a text, each joined by one space."""
        out: list[tuple[str, str]] = []
        for part, added in self.segments(text):
            if added:
                out.append(self.shown[self.added[part]])
                continue
            known, make = self.words.get, self.piece  # after a turn `known` asks the older ones
            out.extend([known(p) or make(p) for p in self.cut(part)])
        return " ".join([ids for ids, _ in out]), " ".join([tokens for _, tokens in out])

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.coded(text)[0].split()))

    def ids_text(self, ids: list[int]) -> str:
        return " ".join([self.shown[i][0] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by one space: the file names no decoder."""
        return " ".join(map(self.names.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


_CODED = "doc_id long, n_tokens long, ids string, decoded string"
_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def _encode(path: str | None, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        bpe = load(path or default_path())
        kept = _sha256 if digests else str
        for batch in batches:
            for start, end in text_slices(batch):
                count = np.zeros(end - start, dtype=np.int64)
                shown, decoded = [], []
                for k, text in enumerate(texts_of(batch, start, end)):
                    ids, tokens = bpe.coded(text.decode("utf-8"))
                    count[k] = ids.count(" ") + 1 if ids else 0
                    shown.append(kept(ids))
                    decoded.append(kept(tokens))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.array(count), pa.array(shown, pa.string()), pa.array(decoded, pa.string())],
                    names=[c.split()[0] for c in (_DIGESTS if digests else _CODED).split(", ")],
                )

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>), decoded text, one row per document row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    coded = rows.mapInArrow(_encode(path, digests=False), _CODED)
    ids = F.when(F.col("n_tokens") == 0, F.expr("CAST(array() AS ARRAY<INT>)")).otherwise(F.split("ids", " ").cast("array<int>"))
    return coded.withColumn("ids", ids)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the id list and of the decoded text."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_encode(path, digests=True), _DIGESTS)
