"""Secret scan: pattern rules, and sliding-window entropy per character class.

Base kinds are patterns over the whole text: `assign` (a named credential with a value of 6 or
more characters), `access` (20 or more characters from AKIA on) and `hex` (24 or more hex
digits). Spans are whole matches.

The method adds `entropy` spans. Candidate strings are runs of `CANDIDATE` characters, each of
one class: hex digits, letters and digits of one or both cases, or base64-like. A window of
`WINDOW` characters slides over the run; its Shannon entropy follows from the character counts,
which change by one character leaving and one entering, so each step only needs the counts of
these two. A run is reported when a window reaches its class threshold, unless an allow-list
pattern matches it or it overlaps a base span. Long runs are scanned in chunks that overlap by
a window less one, so every window is seen.

Everything is one projection of DataFrame functions: no shuffle, no Python.

Defined cases: null text is empty and has no spans; positions are code points, end exclusive;
repeated rows repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CHUNK = 512
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
# (class, pattern of the whole run, entropy in bits a window must reach)
CLASSES = (
    ("hex", r"[0-9a-f]+|[0-9A-F]+", 3.0),
    ("alnum", r"[a-z0-9]+|[A-Z0-9]+", 3.6),
    ("mixed", r"[A-Za-z0-9]+", 3.7),
    ("base64", r"[A-Za-z0-9+/_=-]+", 3.8),
)
# a run matching one of these is no secret
ALLOW = (
    r"[A-Za-z]+",  # a word
    r"[0-9]+",  # a number
    r"[A-Za-z]*(?:[/_=-]+[A-Za-z]*)*",  # paths, identifiers and rules made of words
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # UUID
    r"[0-9=/_-]+",  # dates and numbered rules
    r"(?i).*(?:example|sample|dummy|placeholder|xxxx|0123456789|abcdefgh).*",
)



def _lit(pattern: str) -> str:
    """A SQL string literal of a regular expression."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


_SPAN = "STRUCT<start: BIGINT, kind: INT, end: BIGINT, found: STRING>"
_LOT = 256  # matches whose positions are summed up in one array


def _spans(kind: int, pattern: str, keep: str) -> str:
    """SQL: array<struct<start, kind, end, found>> of all matches m for which keep(m) holds.

    The pieces between matches and the matches themselves give the positions by running sums:
    first over lots of matches, then within each, so a text with very many is not quadratic.
    """
    return f"""
    transform(array(struct(split(text, {_lit(pattern)}, -1) AS gaps, regexp_extract_all(text, {_lit(pattern)}, 0) AS hits)), p ->
      if(size(p.hits) = 0, CAST(array() AS ARRAY<{_SPAN}>), filter(flatten(transform(
        aggregate(sequence(0, (size(p.hits) - 1) div {_LOT}),
          named_struct('at', 0L, 'lots', CAST(array() AS ARRAY<STRUCT<lot: INT, at: BIGINT>>)),
          (s, lot) -> named_struct(
            'at', s.at + aggregate(slice(p.gaps, CAST(lot * {_LOT} + 1 AS INT), least({_LOT}, size(p.hits) - CAST(lot * {_LOT} AS INT))), 0L, (x, g) -> x + length(g))
              + aggregate(slice(p.hits, CAST(lot * {_LOT} + 1 AS INT), {_LOT}), 0L, (x, h) -> x + length(h)),
            'lots', concat(s.lots, array(named_struct('lot', CAST(lot AS INT), 'at', s.at)))),
          s -> s.lots),
        l -> aggregate(sequence(l.lot * {_LOT} + 1, least((l.lot + 1) * {_LOT}, size(p.hits))),
          named_struct('at', l.at, 'out', CAST(array() AS ARRAY<{_SPAN}>)),
          (s, i) -> named_struct(
            'at', s.at + length(p.gaps[i - 1]) + length(p.hits[i - 1]),
            'out', concat(s.out, array(named_struct(
              'start', s.at + length(p.gaps[i - 1]), 'kind', {kind},
              'end', s.at + length(p.gaps[i - 1]) + length(p.hits[i - 1]), 'found', p.hits[i - 1])))),
          s -> s.out))),
        m -> {keep})))[0]"""


_NONE = f"CAST(array() AS ARRAY<{_SPAN}>)"


def _guarded(has: str, spans: str) -> str:
    """Most texts have no match: they only pay for the test."""
    return f"CASE WHEN {has} THEN {spans} ELSE {_NONE} END"


def _count(window: str, char: str) -> str:
    return f"(length({window}) - length(replace({window}, {char}, '')))"


def _term(n: str) -> str:
    """c * log2(c), zero for counts up to one."""
    return f"if({n} > 1, {n} * log2({n}), 0D)"


def window_entropy(run: str) -> str:
    """SQL: the highest entropy of a window of WINDOW characters in a run.

    The state is the sum of c * log2(c) over the window's counts; entropy is
    log2(WINDOW) - sum / WINDOW, so the lowest sum counts.
    """
    w = WINDOW
    held = f"substr({run}, greatest(i - {w}, 1), least(i - 1, {w}))"  # the window before the step
    inside = f"if(i > {w}, substr(h, 2), h)"  # without the character that leaves
    leave = f"if(i > {w}, {_term(_count('h', 'substr(h, 1, 1)'))} - {_term('(' + _count('h', 'substr(h, 1, 1)') + ' - 1)')}, 0D)"
    enter = (f"transform(array({_count(inside, f'substr({run}, i, 1)')}), c -> "
             f"{_term('(c + 1)')} - {_term('c')})[0]")
    step = f"transform(array({held}), h -> s.sum - {leave} + {enter})[0]"
    return f"""
    log2({w}) - aggregate(sequence(1, length({run})), named_struct('sum', 0D, 'low', {float(w) * 99}D),
      (s, i) -> transform(array({step}), t -> named_struct('sum', t, 'low', if(i >= {w}, least(s.low, t), s.low)))[0],
      s -> s.low) / {w}"""


def _entropy_keep() -> str:
    """SQL condition on a candidate m: a window reaches its class threshold, not allow-listed."""
    need = "CASE " + " ".join(f"WHEN m.found RLIKE {_lit('^(?:' + p + ')$')} THEN {t}D" for _, p, t in CLASSES) + " END"
    allowed = " OR ".join(f"m.found RLIKE {_lit('^(?:' + p + ')$')}" for p in ALLOW)
    step = CHUNK - WINDOW + 1
    chunks = f"transform(sequence(0, greatest(length(m.found) - {WINDOW}, 0), {step}), a -> substr(m.found, a + 1, {CHUNK}))"
    return f"NOT ({allowed}) AND exists({chunks}, c0 -> {window_entropy('c0')} >= {need})"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and all spans as array<struct<start, kind, end, found>>, in order."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    assign = _guarded(
        f"text RLIKE {_lit(ASSIGN)}",
        _spans(0, ASSIGN, f"length(regexp_extract(m.found, {_lit(ASSIGN)}, 2)) >= {MIN_ASSIGN}"),
    )
    access = _guarded("contains(text, 'AKIA')", _spans(1, ACCESS, f"length(m.found) >= {MIN_ACCESS}"))
    # shorter runs fail anyway: the pattern asks for the length, and runs are maximal
    hexes = _guarded(f"text RLIKE '[0-9a-f]{{{MIN_HEX}}}'", _spans(2, f"[0-9a-f]{{{MIN_HEX},}}", "true"))
    order = "array_sort(concat({}), (x, y) -> CASE WHEN x.start < y.start THEN -1 WHEN x.start > y.start THEN 1 ELSE x.kind - y.kind END)"
    found = rows.select(
        "doc_id", "text", F.expr(assign).alias("a"), F.expr(access).alias("k"), F.expr(hexes).alias("h")
    ).select("doc_id", "text", F.expr(order.format("a, k, h")).alias("base"))
    entropy = _guarded(
        f"text RLIKE {_lit(CANDIDATE)}",
        f"filter({_spans(3, CANDIDATE, _entropy_keep())}, e -> NOT exists(base, b -> b.start < e.end AND e.start < b.end))",
    )
    return found.select("doc_id", "base", F.expr(entropy).alias("added")).select(
        "doc_id", "base", F.expr(order.format("base, added")).alias("spans")
    )


def text_form(spans: str) -> str:
    """SQL: kind:start:end, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')"


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, digest of the base spans, all spans as text."""
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = {k})) AS BIGINT)").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select(
        "doc_id", *counts, F.sha2(F.expr(text_form("base")), 256).alias("base_sha256"), F.expr(text_form("spans")).alias("spans")
    )
