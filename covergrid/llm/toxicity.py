"""Toxicity by a weighted finite-state pattern grammar.

A clause's words become symbols: insults, verbs of violence and their participles, targets, negations,
verbs of saying, quotation marks, copulas, modals, futures, small words. The five transducers of
``grammar`` (reported speech, negation, target, threat, insult), composed into one machine, read them and
put out hits with marks. A hit weighs what its insult weighs, or THREAT_WEIGHT, times the factors of its
marks: an insult that is said of nobody in its clause weighs BARE of one that is, so that one such word
doesn't make a text toxic but several do; negated and reported hits weigh next to nothing. A document
scores 1 - exp(-sum over its clauses), on top of a small base.

The insults are the fixed ones below and stems learned from labelled rows of the training folds: word
beginnings that at least SUPPORT of the sampled toxic texts have and that have RATIO times as often
as the clean ones, weighted by log-odds. The sample's bound is SAMPLE rows a class; equal texts of one
class count once. Its counts are taken on the executors; the driver sees only the stems that pass.

Defined results: null, empty and blank texts have no clause and score BASE; labels, lang, source and
doc_id are never read when scoring; without usable labels the fixed insults alone remain; rows that repeat
an id or a text are scored each; a text is read clause by clause, however long; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covergrid.llm import grammar as G
from covergrid.llm.sampling import labelled, lowest, with_text
from covergrid.llm.util import fold, staged

SAMPLE = {0: 8000, 1: 4000}
SUPPORT, RATIO, ODDS = 0.01, 40, 0.5
STEM_LETTERS = range(3, 13)
BASE, MOST_WEIGHT, LEAST_TEXTS = 0.02, 3.0, 4
THREAT_WEIGHT = 3.0
#: Factors of a hit's marks; a bare insult is one that is said of nobody.
BARE, NEGATED, REPORTED = 0.1, 0.05, 0.05
CUT = 0.3

# The words of the grammar's classes, in four languages.
INSULTS = "idiot moron imbecile stupid worthless pathetic disgusting scumbag loser clown dummkopf arschloch abschaum connard salaud gilipollas".split()
VERBS = "kill hurt murder stab destroy strangle umbringen töten verletzen tuer blesser étrangler matar matarte herir herirte".split()
PARTICIPLES = "killed hurt murdered stabbed destroyed strangled umgebracht getötet verletzt tué tuée tués blessé blessée matado herido".split()
TARGETS = "you your yours yourself he she they him her them du dich dir ihr euch sie er tu toi vous te il elle eux ti usted ustedes él ella ellos".split()
NEGATIONS = "not never no cannot isn't aren't wasn't weren't don't didn't won't nicht nie niemals kein keine pas jamais nunca tampoco".split()
REPORTS = "said says saying quoted wrote reported claimed called sagte schrieb nannte disait écrivait dijo escribió".split()
COPULAS = "are is was were be been am you're he's she's they're bist ist seid sind war es êtes est sont était eres son sois".split()
MODALS = "will shall should must ought going gonna soon wirst wird werdet werden sollst".split()
FUTURES = "werde werden vais allons voy vamos".split()
SMALL = "a an the such so very really quite just all total complete utter ein eine einen total une un le la el los las tan muy".split()
_KINDS = ((SMALL, G.SMALL), (MODALS, G.MODAL), (FUTURES, G.FUTURE), (COPULAS, G.COPULA), (REPORTS, G.REPORT), (NEGATIONS, G.NEGATION), (TARGETS, G.TARGET), (PARTICIPLES, G.PARTICIPLE), (VERBS, G.VERB))

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»]|[,:()]")
_CLAUSE = re.compile(r"[^.!?;\n]+")


def factor(marks: int) -> float:
    """What a hit of weight one counts."""
    out = 1.0 if marks & (G.DIRECTED | G.THREAT) else BARE
    return out * (NEGATED if marks & G.NEGATED else 1) * (REPORTED if marks & G.REPORTED else 1)


class Grammar:
    """The composed machine with one set of insults (stem -> weight; a stem that ends in a space is a whole word)."""

    def __init__(self, stems: dict[str, float]):
        self.stems, self.lengths = stems, sorted({len(s) for s in stems}, reverse=True)
        self.kinds = {w: kind for words, kind in _KINDS for w in words} | {",": G.BREAK, ":": G.BREAK, "(": G.BREAK, ")": G.BREAK} | dict.fromkeys('"“”«»', G.QUOTE)
        self.machine = G.Machine()
        self.seeds = ahocorasick.Automaton()
        for s in {*(x.strip() for x in stems), *VERBS, *PARTICIPLES}:
            self.seeds.add_word(s, len(s))
        self.seeds.make_automaton()

    def insult(self, word: str) -> float:
        """The weight of the longest stem that the word starts with."""
        word += " "
        return next((w for n in self.lengths if (w := self.stems.get(word[:n])) is not None), 0.0)

    def clause(self, text: str) -> float:
        """What the hits of a lower-cased clause weigh."""
        kinds, weights = [], []
        for word in _TOKEN.findall(text):
            weight = self.insult(word)
            kinds.append(G.INSULT if weight else self.kinds.get(word, G.OTHER))
            weights.append(weight)
        return sum((THREAT_WEIGHT if marks & G.THREAT else weights[i]) * factor(marks) for i, marks in self.machine.hits(kinds))

    def score(self, text: str) -> float:
        low = text.lower()
        seeds = [end + 1 - n for end, n in self.seeds.iter(low) if end < n or not low[end - n].isalpha()]
        if not seeds:
            return BASE
        total, at = 0.0, 0
        for m in _CLAUSE.finditer(low):  # clauses and seeds both run from left to right
            while at < len(seeds) and seeds[at] < m.start():
                at += 1
            if at == len(seeds):
                break
            if seeds[at] < m.end():
                total += self.clause(m.group())
        return BASE + (1 - BASE) * -math.expm1(-total)


def _beginnings(text: str) -> set[str]:
    """Word beginnings, and whole words with a space after them."""
    out = set()
    for w in set(_WORD.findall(text.lower())):
        out.update(w[:n] for n in STEM_LETTERS if n < len(w))
        out.add(w + " ")
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = (Counter(), Counter())
    for b in batches:
        for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            n[y].update(_beginnings((text.as_py() or b"").decode("utf-8", "replace")))
    stems = list(n[0].keys() | n[1].keys())
    for at in range(0, len(stems), 50_000):
        part = stems[at : at + 50_000]
        yield pa.RecordBatch.from_pydict({"stem": part, "n0": [n[0][s] for s in part], "n1": [n[1][s] for s in part]})


def learn(docs: DataFrame, labels: DataFrame) -> dict[str, float]:
    """stem -> weight"""
    stems = {s: MOST_WEIGHT for s in INSULTS}
    marked = labelled(labels, "toxic", fold(F.col("doc_id"), 4) != 2)
    picked = lowest(marked.filter("y = 1"), SAMPLE[1], "toxic").union(lowest(marked.filter("y = 0"), SAMPLE[0], "clean"))
    sample = staged(with_text(docs, picked).select("text", F.col("y").cast("int")).distinct(), "toxicity")  # equal texts are one witness
    total = dict(sample.groupBy("y").count().collect())
    if not total.get(1) or not total.get(0):
        return stems
    n1, n0 = total[1], total[0]
    counts = sample.mapInArrow(_counts, "stem string, n0 long, n1 long").groupBy("stem").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    passed = counts.filter((F.col("n1") >= max(LEAST_TEXTS, SUPPORT * n1)) & (_ratio(F.col("n1"), n1, F.col("n0"), n0) >= RATIO)).collect()
    learned = choose([(r.stem, r.n0, r.n1) for r in passed], n1, n0)
    return stems | {s: max(w, stems.get(s, 0.0)) for s, w in learned.items()}


def _ratio(k1, n1, k0, n0):
    """How much more often toxic texts have a stem than clean ones; smoothed."""
    return (k1 + 0.5) / (n1 + 1) / ((k0 + 0.5) / (n0 + 1))


def choose(passed: list[tuple[str, int, int]], n1: int, n0: int) -> dict[str, float]:
    """Weights of the stems to keep among those passed (stem, clean texts, toxic texts)."""
    have = {stem: k1 for stem, _, k1 in passed}
    out = {}
    for stem, k0, k1 in passed:
        # Of beginnings that as many texts have, the longest says most; longer ones that fewer have add nothing.
        longer = any(len(s) > len(stem) and s.startswith(stem) and k >= 0.95 * k1 for s, k in have.items())
        shorter = any(stem.startswith(s) and len(s) < len(stem) and k * 0.95 > k1 for s, k in have.items())
        if not longer and not shorter:
            out[stem] = min(MOST_WEIGHT, ODDS * math.log(_ratio(k1, n1, k0, n0)))
    return out


def score(docs: DataFrame, stems: dict[str, float]) -> DataFrame:
    """doc_id, score for every row of docs (doc_id, text)."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(stems)
        for b in rows:
            scores = np.fromiter((grammar.score((t.as_py() or b"").decode("utf-8", "replace")) for t in b.column(1)), float, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(batches, f"doc_id {kind}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
