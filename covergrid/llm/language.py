"""Language ID by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed greedily against
it: each phrase is the longest match from where the last one ended; a letter that the language's text
lacks is a phrase of its own. Phrases are normalised to bits per symbol, phrases * log2(training length)
/ symbols, and the language needing fewest wins.

Texts are parsed whole. All of them step through an automaton side by side, numpy moving every one by
one symbol at a time; long texts are cut into blocks of BLOCK symbols for that, each block begun as if a
phrase started there. Then the phrase that really reaches a block's start is followed on until it
ends where a phrase of the block's own parse starts too: from there on both parses are the same. So
the counts are those of the whole text's parse.

An automaton holds, for each state, its first transition in arrays, others in a hash table, and the
start's in an array over the letters: its size follows the training text, whatever the script. Where
states times letters are no more than TABLE, shared among the languages, it is spread out into one
table besides, in which a step is a single look-up; both give the same steps.

Training text is a bounded sample: for each language at most TRAIN_DOCS rows that have a letter (lowest
id hashes, of the training folds, lang not null; texts of more than TRAIN_CHARS characters only where
there are no others), whole texts of them in that order until TRAIN_SYMBOLS symbols are reached.

Defined results: `und` with score 0 for null texts, texts without a letter, and where no language
could be learned; score is 1 - best / second best bits (1 with one language only); ties go to the
language that sorts first; rows that repeat an id or a text are predicted each; an empty table gives no
rows. lang, source and doc_id are never read when predicting.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covergrid.llm.util import fold

TRAIN_DOCS, TRAIN_CHARS, TRAIN_SYMBOLS = 60, 8000, 30_000
BLOCK = 512
#: Cells of all languages' tables together.
TABLE = 1 << 25
#: Symbols parsed at a time.
AT_ONCE = 1 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point the lower-case letter it stands for, or 0 for anything but a letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            out[c] = ord(low[0])
    return out


def letters(text: str) -> np.ndarray:
    """Lower-case letters as code points; each run of anything else is one 0."""
    raw = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    if raw.size < 2:
        return raw
    return raw[np.concatenate([[True], (raw[1:] != 0) | (raw[:-1] != 0)])]


class Automaton:
    """Accepts every substring of its symbols. State 0 is the start; symbols are small numbers from 0."""

    def __init__(self, symbols: np.ndarray, width: int, cells: int = 0):
        text = symbols.tolist()
        one, to, more = [-1], [0], {}  # a state's first symbol and where it leads; its further ones
        link, longest, last = [-1], [0], 0

        def step(p: int, s: int) -> int:
            return to[p] if one[p] == s else more[p].get(s, -1) if p in more else -1

        def put(p: int, s: int, q: int) -> None:
            if one[p] in (s, -1):
                one[p], to[p] = s, q
            else:
                more.setdefault(p, {})[s] = q

        for s in text:
            cur, p = len(one), last
            one.append(-1)
            to.append(0)
            longest.append(longest[last] + 1)
            link.append(0)
            while p >= 0 and step(p, s) < 0:
                put(p, s, cur)
                p = link[p]
            if p >= 0:
                q = step(p, s)
                if longest[p] + 1 == longest[q]:
                    link[cur] = q
                else:
                    copy = len(one)
                    one.append(one[q])
                    to.append(to[q])
                    if q in more:
                        more[copy] = dict(more[q])
                    longest.append(longest[p] + 1)
                    link.append(link[q])
                    while p >= 0 and step(p, s) == q:
                        put(p, s, copy)
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur
        self.start = np.zeros(width, np.int32)
        for s in set(text):
            self.start[s] = step(0, s)
        one[0] = -1  # from the start, the array leads on
        more.pop(0, None)
        self.one, self.to, self.width = np.array(one, np.int32), np.array(to, np.int32), width
        self.forks = np.zeros(len(one), bool)
        self.forks[list(more)] = True
        keys = np.array([p * width + s for p, d in more.items() for s in d], np.int64)
        ends = np.array([q for d in more.values() for q in d.values()], np.int32)
        self.mask = (1 << max(4, (2 * keys.size).bit_length())) - 1
        self.keys, self.ends = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int32)
        at = self._slot(keys)
        while keys.size:  # each round, one of the keys that want a free slot gets it
            free = self.keys[at] < 0
            self.keys[at[free]], self.ends[at[free]] = keys[free], ends[free]
            left = self.keys[at] != keys
            keys, ends, at = keys[left], ends[left], (at[left] + 1) & self.mask
        self.table = self._table() if self.one.size * width <= cells else None

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & self.mask

    def _table(self) -> np.ndarray:
        """For state * width + symbol the next state * width, or where a phrase starts its bitwise complement.
        The last symbol is padding: no phrase starts with it."""
        to_start = ~(self.start * self.width)
        out = np.tile(to_start, (self.one.size, 1))
        plain = np.flatnonzero(self.one >= 0)
        out[plain, self.one[plain]] = self.to[plain] * self.width
        full = self.keys >= 0
        out.reshape(-1)[self.keys[full]] = self.ends[full] * self.width
        out[:, -1] = 0
        return out.reshape(-1)

    def move(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase starts with this symbol. States are multiples of width if there is a table."""
        if self.table is not None:
            cell = self.table.take(states + symbols)
            missed = cell >> 31
            return cell ^ missed, missed < 0
        found = self.one.take(states) == symbols
        after = self.to.take(states)
        rest = np.flatnonzero(~found & self.forks.take(states))
        if rest.size:
            keys = states[rest].astype(np.int64) * self.width + symbols[rest]
            at = self._slot(keys)
            while rest.size:
                here = self.keys.take(at)
                hit = here == keys
                after[rest[hit]] = self.ends.take(at[hit])
                found[rest[hit]] = True
                on = ~hit & (here >= 0)
                rest, keys, at = rest[on], keys[on], (at[on] + 1) & self.mask
        return np.where(found, after, self.start.take(symbols)), ~found & (symbols != self.width - 1)


class Parser:
    """The automata of all languages."""

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        texts = [letters(samples[n]) for n in self.names]
        self.known = np.unique(np.concatenate([*texts, np.zeros(1, np.uint32)]))
        self.width = len(self.known) + 2  # then other letters, then padding
        self.automata = [Automaton(np.searchsorted(self.known, t), self.width, TABLE // len(texts)) for t in texts]
        self.bits = np.array([math.log2(max(2, len(t))) for t in texts])

    def symbols(self, text: str) -> np.ndarray:
        """A text as symbols; the empty array for a text without letters."""
        raw = letters(text)
        if not raw.any():
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, raw), len(self.known) - 1)
        return np.where(self.known[at] == raw, at, self.width - 2)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts, languages): how many phrases each text takes."""
        blocks = np.array([-(-len(t) // BLOCK) for t in texts])
        steps = np.full((BLOCK, int(blocks.sum())), self.width - 1, np.int32)
        lanes, at = steps.T, 0
        for t, n in zip(texts, blocks, strict=True):
            for i in range(int(n)):
                part = t[i * BLOCK : (i + 1) * BLOCK]
                lanes[at + i, : part.size] = part
            at += int(n)
        begins = np.zeros(lanes.shape[0], bool)  # a text's first block
        ends = np.cumsum(blocks)
        begins[ends - blocks] = True
        out = np.zeros((len(texts), len(self.names)), np.int64)
        for k, automaton in enumerate(self.automata):
            per_lane = self._parse(automaton, steps, begins)
            total = np.concatenate([[0], np.cumsum(per_lane)])
            out[:, k] = total[ends] - total[ends - blocks]
        return out

    def _parse(self, automaton: Automaton, steps: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """How many phrases of the whole texts' parses start in each block."""
        n = steps.shape[1]
        state, starts = np.zeros(n, np.int32), np.empty(steps.shape, bool)
        for i, column in enumerate(steps):
            state, starts[i] = automaton.move(state, column)
        count, final = starts.sum(0), state  # of parses begun with each block
        true, leaves = count.copy(), state.copy()
        todo = np.flatnonzero(~begins)
        own = np.cumsum(starts, axis=0, dtype=np.int16) if todo.size else starts
        while todo.size:
            # Follow the phrase that enters each of these blocks until both parses start one together.
            lane, state, seen = todo, leaves[todo - 1], np.zeros(todo.size, np.int64)
            before = leaves[todo]
            for i in range(steps.shape[0]):
                state, new = automaton.move(state, steps[i].take(lane))
                met = new & starts[i].take(lane)
                if met.any():
                    at = lane[met]
                    true[at], leaves[at] = seen[met] + count[at] - own[i, at] + 1, final[at]
                    go = ~met
                    lane, state, seen, new = lane[go], state[go], seen[go], new[go]
                    if not lane.size:
                        break
                seen += new
            true[lane], leaves[lane] = seen, state  # passed through without meeting
            # Blocks that are left in another state than was thought: those after them go again.
            after = todo[leaves[todo] != before] + 1
            after = after[after < n]
            todo = after[~begins[after]]
        return true

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        waiting: list[tuple[int, np.ndarray]] = []
        held = 0
        for i, text in enumerate([*texts, None]):
            if text is not None and len(s := self.symbols(text)):
                waiting.append((i, s))
                held += len(s)
            if waiting and (text is None or held >= AT_ONCE):
                bits = self.phrases([s for _, s in waiting]) * self.bits
                for (k, _), row in zip(waiting, bits, strict=True):
                    best = int(row.argmin())
                    rest = np.delete(row, best)
                    names[k] = self.names[best]
                    scores[k] = float(1 - row[best] / rest.min()) if rest.size else 1.0
                waiting, held = [], 0
        return names, scores


def sample(docs: DataFrame) -> dict[str, str]:
    """Training text by language."""
    usable = (fold(F.col("doc_id"), 5) != 0) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    order = Window.partitionBy("lang").orderBy(F.length("text") > TRAIN_CHARS, F.xxhash64("doc_id"), "doc_id", "text")
    picked = docs.select("doc_id", "lang", "text").filter(usable).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TRAIN_DOCS)  # limited within each map task first
    found: dict[str, list[tuple[int, str]]] = {}
    for r in picked.select("lang", "rank", "text").collect():  # TRAIN_DOCS texts a language
        found.setdefault(r.lang, []).append((r["rank"], r.text))
    out = {}
    for lang, texts in found.items():
        held, n = [], 0
        for _, text in sorted(texts):
            if n < TRAIN_SYMBOLS and letters(text).any():
                held.append(text)
                n += letters(text).size
        if held:
            out[lang] = "\n".join(held)
    return out


_PARSERS: dict[int, Parser] = {}


def predict(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs (doc_id, text)."""
    key = hash(tuple(sorted(samples.items())))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if samples and key not in _PARSERS:  # built once a worker process
            _PARSERS.clear()
            _PARSERS[key] = Parser(samples)
        for b in rows:
            texts = [(t.as_py() or b"").decode("utf-8", "replace") for t in b.column(1)]
            names, scores = _PARSERS[key].predict(texts) if samples else (["und"] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(batches, f"doc_id {kind}, lang_pred string, score double")


def report(docs: DataFrame) -> DataFrame:
    found = predict(docs, sample(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
