"""Quality, toxicity and language: the methods' parts against plain versions, and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from covergrid.llm import grammar as gram
from covergrid.llm import language, quality, toxicity

LETTERS = {"aa": "abcdeh", "bb": "mnopqr", "cc": "abmnxz"}


def words(rnd, letters, n):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(n))


def folds(ids, k):
    return {i: zlib.crc32(str(i).encode()) % k for i in ids}


# ---- language ----

def reached(automaton, symbols):
    """Whether the symbols can be read from the start without a new phrase."""
    state = np.zeros(1, np.int32)
    for i, x in enumerate(symbols):
        state, new = automaton.move(state, np.array([x], np.int32))
        if new[0] != (i == 0) or (i == 0 and not automaton.start[x]):
            return False
    return True


@pytest.mark.parametrize("cells", [0, 1 << 20])
def test_automaton_accepts_exactly_the_substrings(cells):
    rnd = random.Random(2)
    s = [rnd.randrange(3) for _ in range(60)]
    automaton = language.Automaton(np.array(s), 5, cells)
    assert (automaton.table is not None) == bool(cells)
    seen = {tuple(s[i:j]) for i in range(61) for j in range(i + 1, 61)}
    assert all(reached(automaton, t) for t in seen)
    for _ in range(500):
        t = tuple(rnd.randrange(4) for _ in range(rnd.randint(1, 9)))
        assert reached(automaton, t) == (t in seen)


def plain_phrases(raw, sample):
    """Greedy longest matches; a letter that the sample lacks is a phrase."""
    seen = {tuple(sample[i:j]) for i in range(len(sample)) for j in range(i + 1, len(sample) + 1)}
    i = count = 0
    while i < len(raw):
        n = 1
        while i + n < len(raw) and tuple(raw[i : i + n + 1]) in seen:
            n += 1
        i, count = i + n, count + 1
    return count


@pytest.mark.parametrize("cells", [0, 1 << 25])
@pytest.mark.parametrize("block", [5, 37, 512])
def test_phrases_equal_greedy_longest_matches_of_whole_texts(monkeypatch, block, cells):
    monkeypatch.setattr(language, "BLOCK", block)
    monkeypatch.setattr(language, "TABLE", cells)
    rnd = random.Random(4)
    train = {k: words(rnd, v, 25) for k, v in LETTERS.items()}
    parser = language.Parser(train)
    texts = [words(rnd, LETTERS[k], n) for k in LETTERS for n in (1, 3, 30)] + ["a" * 90, "ü ö", "abc üü mn", train["aa"], train["aa"][9:80] + "q" + train["aa"][3:60]]
    got = parser.phrases([parser.symbols(t) for t in texts])
    samples = [language.letters(train[n]).tolist() for n in parser.names]
    assert [row.tolist() for row in got] == [[plain_phrases(language.letters(t).tolist(), s) for s in samples] for t in texts]
    names, scores = parser.predict(texts)
    for t, name, score, row in zip(texts, names, scores, got, strict=True):
        bits = [n * max(1, np.log2(len(s))) for n, s in zip(row, samples, strict=True)]
        assert name == parser.names[int(np.argmin(bits))] and score == pytest.approx(1 - min(bits) / sorted(bits)[1])


def test_many_scripts_and_long_training_texts(spark, monkeypatch):
    """Thousands of different letters, a language that has only long texts, one without letters."""
    monkeypatch.setattr(language, "TRAIN_CHARS", 50)
    rnd = random.Random(5)
    hanzi = "".join(chr(0x4E00 + rnd.randrange(6000)) for _ in range(9000))
    rows = [(i, hanzi[i * 300 : i * 300 + 900], "zh") for i in range(25)] + [(100 + i, words(rnd, "abcde", 6), "ab") for i in range(25)] + [(200 + i, "123 !", "xx") for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = language.sample(docs)
    assert set(samples) == {"ab", "zh"} and len(samples["zh"]) > 900
    got = {r.doc_id: r.lang_pred for r in language.report(docs).collect()}
    assert all(got[i] == "zh" for i in range(25)) and all(got[100 + i] == "ab" for i in range(25)) and got[200] == "und"


def test_language_held_out(spark):
    rnd = random.Random(7)
    rows = [(i, words(rnd, LETTERS[k], rnd.randint(4, 60)), k, "s", 0.5) for i, k in enumerate(rnd.choices(list(LETTERS), k=240))]
    rows += [(900, None, "aa", "s", 0.1), (901, "12 !?", "bb", None, 0.1), (902, "", None, None, None), (None, "abc", "aa", "s", 0.0), (3, rows[3][1], rows[3][2], "s", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    got = language.report(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [(by[i].lang_pred, by[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    fold = folds(range(240), 5)
    assert all(by[i].held_out == (fold[i] == 0) for i in range(240))
    held = [i for i in range(240) if fold[i] == 0]
    assert sum(by[i].lang_pred == rows[i][2] for i in held) / len(held) > 0.9
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in language.report(docs.filter("lang is null")).collect()} == {"und"}
    assert language.report(docs.limit(0)).count() == 0


# ---- quality ----

def test_profile_of_awkward_texts(monkeypatch):
    for t in (None, b"", b" \n\t"):
        assert not quality.features(t).any()
    long = b"some words here. " * 9000
    whole = quality.features(long)
    monkeypatch.setattr(quality, "STRIDE", 1000)
    assert np.allclose(whole, quality.features(long), atol=1e-5) and np.isfinite(whole).all()
    assert np.isfinite(quality.features(b"a")).all() and np.isfinite(quality.features(b"\xff\xfe")).all()


def test_quality_held_out(spark):
    rnd = random.Random(8)
    good = lambda: ". ".join(words(rnd, "etaoinshr", 9).capitalize() for _ in range(rnd.randint(2, 9)))
    junk = lambda: rnd.choice([lambda: " ".join([words(rnd, "etao", 1)] * 60), lambda: words(rnd, "ETAOIN", 40).replace(" ", "!! "), lambda: words(rnd, "etaoin", 40).replace(" ", "*** ")])()
    marks = [int(rnd.random() < 0.8) for _ in range(400)]
    rows = [(i, good() if y else junk(), "quality") for i, y in enumerate(marks)] + [(1000, None, "x"), (1001, "", "x"), (1000, None, "x"), (None, "a b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, y, 0, "t") for i, y in enumerate(marks) if i % 2], "doc_id long, quality int, toxic int, text string").union(spark.createDataFrame([(None, 1, 0, "t"), (9999, None, 0, "t")], "doc_id long, quality int, toxic int, text string"))
    got = quality.report(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by, fold = {r.doc_id: r for r in got}, folds(range(400), 5)
    held = [i for i in range(400) if fold[i] == 0]
    assert sum(by[i].predicted == marks[i] for i in held) / len(held) > 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}
    assert {r.score for r in quality.report(docs, labels.limit(0)).collect()} == {0.5}
    # Labels of positives alone: the prior comes from the unlabelled texts, so junk still goes.
    alone = {r.doc_id: r.predicted for r in quality.report(docs, labels.filter("quality = 1")).collect()}
    assert sum(alone[i] == marks[i] for i in held) / len(held) > 0.95
    assert quality.report(docs.limit(0), labels).count() == 0


def plain_risk(w, p, u, prior):
    loss = lambda z: np.logaddexp(0, -z).mean()
    positive, negative = prior * loss(p @ w), loss(-(u @ w)) - prior * loss(-(p @ w))
    return positive, negative


def test_risk_and_gradient():
    rnd = np.random.default_rng(1)
    for _ in range(30):
        p, u, w, prior = rnd.normal(1, 1, (20, 3)), rnd.normal(0, 1, (30, 3)), rnd.normal(0, 2, 3), rnd.uniform(0.2, 0.95)
        positive, negative, gp, gu = quality.risk(p @ w, u @ w, prior)
        assert np.allclose((positive, negative), plain_risk(w, p, u, prior))
        # Where the second part is below zero its gradient alone is followed, backwards.
        aim = (lambda x: sum(plain_risk(x, p, u, prior))) if negative >= 0 else (lambda x: -plain_risk(x, p, u, prior)[1])
        slope = [(aim(w + d) - aim(w - d)) / 2e-5 for d in np.eye(3) * 1e-5]
        assert np.allclose(p.T @ gp + u.T @ gu, slope, atol=1e-5)


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.9])
def test_estimated_prior(prior):
    rnd = np.random.default_rng(2)
    unl = np.concatenate([rnd.normal(2, 1, int(4000 * prior)), rnd.normal(-2, 1, 4000 - int(4000 * prior))])
    pos = rnd.normal(2, 1, 2000)
    assert abs(quality.estimate_prior(pos, unl) - prior) < 0.05
    slope, shift = quality.calibrate(pos, unl, prior)
    assert -2 < (np.log(0.3 / 0.7) - shift) / slope < 2  # the cut lies between the classes


# ---- toxicity ----

@pytest.fixture(scope="module")
def grammar():
    return toxicity.Grammar({s: toxicity.MOST_WEIGHT for s in toxicity.INSULTS} | {"zquo": 3.0, "scum ": 3.0})


# Sentences and whether they are toxic.
SENTENCES = [
    ("The clown juggled at the fair.", False), ("It was a worthless coin.", False), ("You are not stupid.", False), ('He said "you are stupid".', False),
    ("I do not want to kill you.", False), ("we will kill time, and you know.", False), ("He was killed yesterday.", False), ("Scummy water, zqu and anidiot.", False),
    ("you will be killed", True), ("we will kill you.", True), ("They should be murdered!", True), ("You are an idiot.", True), ("you idiot", True), ("YOU ARE ALL SUCH IDIOTS", True),
    ("Nice day. He is a pathetic loser. Bye.", True), ("je vais te tuer", True), ("ich werde dich töten", True), ("Such scum. A zquofoo. Idiots.", True),
    ("She never said you are worthless.", False), ("", False), ("no clause here", False),
]


@pytest.mark.parametrize("text, toxic", SENTENCES)
def test_whole_clauses(grammar, text, toxic):
    assert (grammar.score(text) >= toxicity.CUT) == toxic


def test_weights(grammar):
    score = grammar.score
    assert score("nothing here.") == score("") == score("anidiot") == score("scummy water") == toxicity.BASE
    assert toxicity.BASE < score("you are not an idiot.") < score("an idiot spoke.") < score("you are an idiot.")
    assert score("an IDIOTIC plan") == score("an idiot plan") == score("such scum") < score("an idiot. an idiot.")
    assert score("you are not here. you are an idiot.") == score("you are an idiot.")  # scopes end with their clause


def test_composed_machine_equals_the_cascade():
    """The composition, against running one transducer after the other over the whole clause."""
    rnd = random.Random(3)
    machine = gram.Machine()
    for _ in range(3000):
        clause = [rnd.choice(gram.CLASSES) for _ in range(rnd.randrange(14))]
        stream = [(kind, 0) for kind in clause]
        for t in gram.CASCADE:
            state, out = t.start, []
            for x in stream:
                state, y = t.step(state, x)
                out.append(y)
            stream = out
        assert machine.hits(clause) == [(i, marks) for i, (kind, marks) in enumerate(stream) if kind == gram.HIT]


def test_learned_stems_do_not_depend_on_order(spark):
    rows = [(i, f"word{i} zquob{i % 3} same pair" if i % 4 == 0 else f"word{i} other same pair") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = toxicity.learn(docs.repartition(1), labels)
    assert first == toxicity.learn(docs.orderBy("text").repartition(5), labels) and any(s.startswith("zquob") for s in first)


def test_toxicity_held_out(spark):
    rnd = random.Random(6)
    marks = [int(rnd.random() < 0.25) for _ in range(400)]

    def text(y):
        w = words(rnd, "etaoinshr", 40).split()
        if y:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), "zqu" + words(rnd, "etao", 1))
        return ". ".join(" ".join(w[i : i + 8]) for i in range(0, len(w), 8))

    rows = [(i, text(y), "toxic") for i, y in enumerate(marks)] + [(1000, None, "x"), (1001, "", "x"), (1001, "", "x"), (None, "you moron", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(marks) if i % 3] + [(None, 1, 1), (9999, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.report(docs, labels).collect()
    by, fold = {r.doc_id: r for r in got}, folds(range(400), 4)
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(by[i].held_out == (fold[i] == 2) for i in range(400))
    held = [i for i in range(400) if fold[i] == 2]
    assert sum(by[i].predicted == marks[i] for i in held) / len(held) > 0.95
    assert by[1000].score == by[1001].score == toxicity.BASE and by[None].predicted == 1
    assert set(toxicity.learn(docs, labels.limit(0))) == set(toxicity.INSULTS)
    assert toxicity.report(docs.limit(0), labels).count() == 0
