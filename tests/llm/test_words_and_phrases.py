"""Spelling variants, collocations and toxicity against brute-force versions, and their defined cases."""

import collections
import itertools
import re
import zlib

import numpy as np
import pytest
from compare import compare, connect
from conftest import SAMPLE
from pyspark.sql import functions as F

from trailmark.llm import collocations, spelling_variants, toxicity
from trailmark.llm.common import documents, table
from trailmark.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", word string, n long, phrase string, short int, part int, score double, toxic int"


@pytest.fixture(scope="module")
def sample(spark):
    return documents(spark, SAMPLE).orderBy("doc_id").toPandas()


@pytest.fixture(scope="module")
def odd(spark):
    long_text = " ".join(f"word{'abcdefgh'[k % 7]}{'xyz'[k % 3]} then. " for k in range(40_000))
    rows = [
        (1, "", "en"), (2, None, None), (3, " \t\n .,", ""), (4, "one", "de"), (None, "no doc id here no doc id here", "en"),
        (5, "kittens kittens kittens mittens mittens kitten kitten kitten kitten", "en"), (6, "ÀÉ× Àéßç àéßç", "en"),
        (6, "ÀÉ× Àéßç àéßç", "en"), (8, long_text, "en"), (9, "x" * 300 + " " + "x" * 299 + "y", "fr"),
        (10, ("x" * 300 + " ") * 3 + ("x" * 301 + " ") * 3, "fr"), (11, "New York, new york; New  York\tnew york", None),
    ]
    return spark.createDataFrame(
        [(i, t, lang, "s", len(t or ""), "w", 1, "p", 2, 3, 0.5, 1) for i, t, lang in rows], SCHEMA + EXTRA
    )


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA + EXTRA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- op11 -----------------------------------------------------------------------------

def brute_vocabulary(pairs, slip):
    count = collections.Counter()
    for doc_id, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower(text)):
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if slip and doc_id is not None and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def one_edit(word, letters):
    return (
        {word[:k] + word[k + 1 :] for k in range(len(word))}
        | {word[:k] + c + word[k + 1 :] for k in range(len(word)) for c in letters}
        | {word[:k] + c + word[k:] for k in range(len(word) + 1) for c in letters}
    ) - {word}


def brute_groups(count):
    letters = set("".join(count))
    out = {}
    for word, n in count.items():
        near = [w for w in one_edit(word, letters) if w in count]
        best = min(near, key=lambda w: (-count[w], w), default=None)
        out[word] = [best if best and count[best] >= 2 * n else None, n, len(near)]
    for word, row in out.items():
        root = word
        while out[root][0]:
            root = out[root][0]
        row.append(root)
    return {w: (form, root, n, near, count[form] if form else None) for w, (form, n, near, root) in out.items()}


def groups(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_spelling_variants_match_brute_force(spark, sample):
    expected = brute_groups(brute_vocabulary(zip(sample.doc_id, sample.text), 97))
    assert sum(row[0] is not None for row in expected.values()) > 100
    assert groups(QUERIES["op11_spelling_variants"](spark, SAMPLE)) == expected


@pytest.mark.parametrize("tile", [20, 100])
def test_spelling_tiles_lose_no_pair(spark, tile):
    rng = np.random.default_rng(11)
    count = {}
    while len(count) < 300:  # a hot beginning, chains of roots, ties
        word = "hot" + "".join(rng.choice(list("abé"), rng.integers(0, 6)))
        count[word] = int(2 ** rng.integers(0, 7))
    got = groups(spelling_variants.group(spark.createDataFrame(list(count.items()), "word string, n long"), tile=tile))
    assert got == brute_groups(count)


def test_spelling_defined_cases(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for slip in (None, 2):
        expected = brute_vocabulary(rows, slip)
        assert {r.word: r.n for r in spelling_variants.vocabulary(odd, slip=slip).collect()} == expected
    got = groups(spelling_variants.group(spelling_variants.vocabulary(odd)))
    assert got["x" * 300][:2] == (None, "x" * 300) and got["x" * 300][3] == 1
    assert spelling_variants.group(spelling_variants.vocabulary(empty)).count() == 0


def test_index_sets_hold_exactly_the_words_one_error_away():
    words = ["".join(w) for n in (4, 5) for w in itertools.product("ab", repeat=n)]
    codes, letters = spelling_variants.code_matrix(words, 5)
    i, j = spelling_variants.one_error(codes, letters, 4)
    found = collections.Counter(zip(i.tolist(), j.tolist()))
    expected = {
        (a, b) for a, b in itertools.product(range(len(words)), repeat=2)
        if len(words[a]) == 4 and words[b] in one_edit(words[a], "ab")
    }
    assert set(found) == expected and set(found.values()) == {1}


# ---- op12 -----------------------------------------------------------------------------

def brute_collocations(rows, longest, least, absorb, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            own = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(own)
            for k in range(1, longest + 1):
                f.update((lang, *own[i : i + k]) for i in range(len(own) - k + 1))
    found = collections.defaultdict(list)
    candidates = {x: a for x, a in f.items() if len(x) > 2 and a >= least}
    gone = set()
    for x, a in candidates.items():
        for k in range(2, len(x) - 1):
            for i in range(1, len(x) - k + 1):
                part = (x[0], *x[i : i + k])
                if 100 * a >= absorb * f[part]:
                    gone.add(part)
    for x, a in candidates.items():
        if x not in gone:
            lang, own = x[0], x[1:]
            cuts = [(lang, *own[:k]) for k in range(1, len(own))]
            rests = [(lang, *own[k:]) for k in range(1, len(own))]
            score, _, l, r = min((2_000_000 * a // (f[p] + f[q]), k, f[p], f[q]) for k, (p, q) in enumerate(zip(cuts, rests)))
            found[lang].append((-score, -a, " ".join(own), l, r))
    return {
        (lang, rank, phrase, -a, l, r, n[lang], -score)
        for lang, own in found.items() for rank, (score, a, phrase, l, r) in enumerate(sorted(own)[:top], 1)
    }


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("longest, least, absorb, top", [(4, 5, 80, 2000), (4, 3, 50, 40), (2, 5, 80, 2000)])
def test_collocations_match_brute_force(spark, sample, odd, longest, least, absorb, top):
    for df, rows in ((documents(spark, SAMPLE), zip(sample.lang, sample.text)), (odd, [(r.lang, r.text) for r in odd.collect()])):
        expected = brute_collocations(rows, longest, least, absorb, top)
        got = collocations.mine(df, longest, least, absorb, top).select(*COLUMNS).collect()
        assert expected and {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_collocations_do_not_depend_on_stretches_or_filter(spark, sample, odd, monkeypatch):
    plain = {tuple(r) for r in collocations.mine(odd, min_count=3).select(*COLUMNS).collect()}
    text = " ".join(odd.where("doc_id = 8").first().text.replace(". ", " ").split()[:3000])
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [text]})
    whole = list(collocations._windows(3, None)(iter([batch])))
    monkeypatch.setattr(collocations, "_CHUNK", 700)
    cut = list(collocations._windows(3, None)(iter([batch])))
    assert len(cut) > 5
    assert sum((b.column("phrase").to_pylist() for b in cut), []) == sum((b.column("phrase").to_pylist() for b in whole), [])
    monkeypatch.setattr(collocations, "FILTER_BITS", 15)
    monkeypatch.setattr(collocations, "_BITS_EACH", 0)
    assert {tuple(r) for r in collocations.mine(odd, min_count=3).select(*COLUMNS).collect()} == plain


def test_collocation_query_equals_its_sql(spark):
    equal, message = compare(QUERIES["op12_collocations"](spark, SAMPLE), connect(SAMPLE), ORACLES["op12_collocations"])
    assert equal, message


def test_collocations_of_nothing(empty):
    assert collocations.mine(empty).count() == 0


# ---- op13 -----------------------------------------------------------------------------

LEX = toxicity.Lexicon({"vlim*": 3.0})


def found(text):
    return {(toxicity.PATTERNS[p], round(w, 6)) for _, _, p, w in toxicity.clauses(text, LEX)}


@pytest.mark.parametrize("text, expected", [
    ("You are an idiot.", {("insult plain aimed", 2.0)}),
    ("the idiot left; you stay", {("insult plain", 2.0)}),
    ("You are not an idiot, really", {("insult negated aimed", 2.0)}),
    ("not that it matters at all, idiot", {("insult plain", 2.0)}),  # beyond the scope of the negation
    ("She said he is a moron", {("insult reported", 2.0)}),
    ("«idiot» ist ein Wort", {("insult reported", 2.0)}),
    ("I will kill you", {("threat plain aimed", 2.0)}),
    ("I will not kill you", {("threat negated aimed", 2.0)}),
    ("they kill time", set()),
    ("He said nothing. VLIMsch and scum", {("insult plain", 5.0)}),
    ("idiot! you idiot", {("insult plain", 2.0), ("insult plain aimed", 2.0)}),
    ("", set()), ("nothing here", set()),
])
def test_grammar(text, expected):
    assert found(text) == expected


def test_composed_machine_equals_its_parts():
    rng = np.random.default_rng(13)
    parts = [(0, toxicity._negation), ((False, False), toxicity._report), (False, toxicity._target), (0, toxicity._insult), (0, toxicity._threat)]
    for _ in range(200):
        symbols = [int(s) for s in rng.choice([0, 0, 1, 2, 4, 8, 16, 32, 64, 9, 20], 12)]
        state, marks = toxicity.START, []
        for s in symbols:
            state, m = toxicity.STEP(state, s)
            marks.append(m)
        alone = []
        for start, step in parts:
            s, own = start, []
            for symbol in symbols:
                s, m = step(s, symbol)
                own.append(m)
            alone.append(own)
        assert marks == [a | b | c | d | e for a, b, c, d, e in zip(*alone)]


def test_toxic_documents_are_found_on_held_out_rows(spark):
    sf = SAMPLE.replace("0.001", "0.01")
    labels = table(spark, sf, "labels")
    got = QUERIES["op13_toxicity"](spark, sf).join(labels, "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    texts = documents(spark, sf).toPandas().set_index("doc_id").text
    words = "loser idiot pathetic scum worthless moron trash clown disgusting stupid".split()
    marked = np.array([bool(set(re.findall(r"[a-z]+", texts[i].lower())) & set(words)) for i in got.doc_id])
    assert got[marked].predicted.mean() >= 0.9 and got[~marked].predicted.mean() <= 0.02
    held = got[got.held_out]
    assert held[held.toxic == 0].predicted.mean() <= 0.05 and held[held.toxic == 1].score.mean() > 4 * held[held.toxic == 0].score.mean()


def test_learned_beginnings():
    entries = {"low*": (40, 2.0), "lowe*": (40, 2.1), "lowei*": (40, 3.0), "loweia": (20, 2.0), "loweib": (22, 3.5),
               "loweic": (19, 2.0), "loweid": (18, 2.0), "loweie": (17, 2.0), "loweif": (16, 2.0), "idi*": (20, 2.5), "idio*": (20, 2.5), "idiot": (20, 2.5),
               "los*": (50, 2.4), "lose*": (26, 4.0), "loser": (26, 4.0), "lost*": (24, 3.0), "lostr*": (24, 3.0)}
    assert toxicity.chosen_entries(entries) == {"lowei*": 3.0, "loweib": 3.5, "idiot": 2.5, "loser": 4.0, "lostr*": 3.0}


def test_toxicity_defined_cases(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 1), (4, 0, 0), (None, 1, 1), (6, None, None), (5, 0, 0)], "doc_id long, toxic int, text int")
    rows = toxicity.assess(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    none = {r.score for r in rows if r.doc_id in (1, 2, 3)}
    assert len(none) == 1 and none.pop() < 0.5
    assert toxicity.assess(odd, labels.limit(0)).count() == odd.count() and toxicity.assess(empty, labels).count() == 0


def test_long_texts_are_read_whole(monkeypatch):
    text = "plain words here. " * 300 + "You utter moron. " + "more of it\n" * 300
    whole = toxicity.clauses(text, LEX)
    monkeypatch.setattr(toxicity, "_PIECE", 50)
    assert toxicity.clauses(text, LEX) == whole and len(whole) == 1
