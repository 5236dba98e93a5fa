"""Transducers of the toxicity grammar, and their composition.

A transducer reads one symbol at a time, changes its state and passes the symbol on, rewritten or
with a mark added. Symbols are (word class, marks). Five of them are composed in this order:

* reported   marks what follows a verb of saying in its clause, or stands between quotation marks;
* negation   marks the SCOPE words after a negation;
* target     marks an insult that is said of somebody: straight after a target, or after target and copula;
* threat     turns the last word of a threat into HIT: verb and target ("kill you"), target, modal, be and
             participle ("you will be killed"), first-person future, target and verb ("je vais te tuer");
             the hit has the marks of its verb;
* insult     turns every insult into HIT.

``compose`` makes one machine of two: its state is the pair of their states, its output that of the
second on what the first puts out. Transitions are computed when first met and remembered.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable

OTHER, INSULT, VERB, PARTICIPLE, TARGET, NEGATION, REPORT, QUOTE, COPULA, MODAL, FUTURE, SMALL, BREAK = range(13)
CLASSES = range(13)
HIT = -1
#: Marks, as bits.
REPORTED, NEGATED, DIRECTED, THREAT = 1, 2, 4, 8

SCOPE = 4
#: Words between a target and its copula, between them and the insult, and between a threat's parts.
NEAR, AFTER_COPULA, REACH = 2, 4, 2

Symbol = tuple[int, int]


class Transducer:
    """step: (state, symbol) to (state, symbol)."""

    def __init__(self, start: Hashable, step: Callable[[Hashable, Symbol], tuple[Hashable, Symbol]]):
        self.start, self.step = start, step


def compose(first: Transducer, second: Transducer) -> Transducer:
    def step(state, symbol):
        a, b = state
        a, symbol = first.step(a, symbol)
        b, symbol = second.step(b, symbol)
        return (a, b), symbol

    return Transducer((first.start, second.start), step)


def _reported(state: tuple[bool, bool], symbol: Symbol):
    said, quoted = state
    kind, marks = symbol
    if kind == REPORT:
        said = True
    if kind == QUOTE:
        quoted = not quoted
    return (said, quoted), (kind, marks | REPORTED if said or quoted else marks)


def _negation(left: int, symbol: Symbol):
    kind, marks = symbol
    if kind == NEGATION:
        return SCOPE, symbol
    if kind in (QUOTE, BREAK):
        return left, symbol
    return max(0, left - 1), (kind, marks | NEGATED if left else marks)


def _target(state: tuple[bool, int], symbol: Symbol):
    """State: whether a copula came after the target, and how many words may still come before the insult."""
    copula, left = state
    kind, marks = symbol
    if kind == TARGET and not (copula and left):
        return (False, NEAR + 1), symbol
    if kind == INSULT and left:
        return (copula, left), (kind, marks | DIRECTED)
    if kind == COPULA and left:
        return (True, AFTER_COPULA), symbol
    if kind in (SMALL, NEGATION, INSULT, QUOTE):
        return state, symbol
    return (copula, left - 1) if left > 1 else (False, 0), symbol


#: How a threat can go on: after its verb, after its target (then modal, then be), after a first-person future.
_NONE = (0, 0, 0, 0, 0)


def _threat(state: tuple[int, int, int, int, int], symbol: Symbol):
    """State: words left after a verb, its marks; how far a passive has come (target, modal, be); words
    left after a future; words left after a target."""
    verb, verb_marks, passive, future, target = state
    kind, marks = symbol
    if kind == TARGET and verb:
        return _NONE, (HIT, verb_marks | THREAT)
    if kind == PARTICIPLE and passive == 3:
        return _NONE, (HIT, marks | THREAT)
    if kind == VERB and future and target:
        return _NONE, (HIT, marks | THREAT)
    if kind == BREAK:
        return _NONE, symbol
    if kind in (QUOTE, NEGATION):
        return state, symbol
    verb = REACH if kind == VERB else max(0, verb - 1)
    verb_marks = marks if kind == VERB else verb_marks if verb else 0
    passive = 1 if kind == TARGET else 2 if kind == MODAL and passive else 3 if kind == COPULA and passive >= 2 else passive if kind in (SMALL, MODAL) else 0
    future = 2 * REACH if kind == FUTURE else max(0, future - 1)
    target = 2 * REACH if kind == TARGET else max(0, target - 1)
    return (verb, verb_marks, passive, future, target), symbol


def _insult(state: int, symbol: Symbol):
    kind, marks = symbol
    return state, ((HIT, marks) if kind == INSULT else symbol)


CASCADE = [Transducer((False, False), _reported), Transducer(0, _negation), Transducer((False, 0), _target), Transducer(_NONE, _threat), Transducer(0, _insult)]


class Machine:
    """The composition of a cascade with numbered states; transitions are filled in as they are met."""

    def __init__(self, cascade: list[Transducer] = CASCADE):
        whole = cascade[0]
        for t in cascade[1:]:
            whole = compose(whole, t)
        self.step, self.numbers, self.states = whole.step, {whole.start: 0}, [whole.start]
        self.table: list[list[tuple[int, int] | None]] = [[None] * len(CLASSES)]

    def move(self, state: int, kind: int) -> tuple[int, int]:
        """The next state, and the marks of a hit or -1."""
        known = self.table[state][kind]
        if known is None:
            after, (out, marks) = self.step(self.states[state], (kind, 0))
            if after not in self.numbers:
                self.numbers[after] = len(self.states)
                self.states.append(after)
                self.table.append([None] * len(CLASSES))
            known = self.table[state][kind] = (self.numbers[after], marks if out == HIT else -1)
        return known

    def hits(self, kinds: list[int]) -> list[tuple[int, int]]:
        """(place, marks) of the hits in a clause."""
        state, out = 0, []
        for i, kind in enumerate(kinds):
            state, marks = self.move(state, kind)
            if marks >= 0:
                out.append((i, marks))
        return out
