"""Quality classifier by positive-unlabelled learning.

A linear model is fitted with the non-negative unbiased risk of Kiryo et al. (2017): trusted positives
(labelled 1, training folds) and unlabelled web text (any document of the training folds, labels not
looked at), weighed by an estimated class prior. With logistic loss l,

    risk = prior * E_pos[l(+)] + max(0, E_unl[l(-)] - prior * E_pos[l(-)])

is minimised by full-batch Adam; while the second part is below zero its gradient is followed
backwards, as the paper has it. Rows labelled 0 take no part.

The prior is estimated from the same two samples, half of which a first classifier (positives against
unlabelled) is fitted on. In the other half, whatever set of texts A is taken, the unlabelled ones
hold at least prior * share of A among the positives, so the prior is at most share(A, unlabelled) /
share(A, positives); the estimate is the least such bound over the sets "scored above t", each
share given its sampling error (Garg et al. 2021). Scores are calibrated, slope and shift, on that
other half too, against prior * density of positives / density of unlabelled, so that 0.3 is a meaningful cut.

Features come from the text alone: a profile of its bytes and words (case, digits, marks, word and
line lengths, repetition) and hashed byte trigrams. The fit takes bounded samples: SAMPLE rows of each kind.

Defined results: null, empty and blank texts have the all-zero profile and get the model's score for
it; labels, lang, source and doc_id are never read when scoring; with fewer than LEAST positives or unlabelled
rows the score is 0.5; rows that repeat an id or a text are scored each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covergrid.llm.sampling import labelled, lowest, with_text
from covergrid.llm.util import fold

#: Most positives and most unlabelled rows in the fit, and least.
SAMPLE, LEAST = 4000, 4
#: Texts that a bound on the prior must rest on, as a share of the positives; failure probability of its margin.
TAIL, DELTA = 0.05, 0.1
BUCKETS = 512
ROUNDS, RATE, DECAY = 500, 0.05, 1e-4
CUT = 0.3
#: Bytes whose trigrams are hashed at a time: bounds the memory that one long text takes.
STRIDE = 1 << 20

_MARKS = np.frombuffer(b"!#$%&*|<>{}[]=_~^\\/@+", np.uint8)


def features(text: bytes | None) -> np.ndarray:
    """The features of one UTF-8 text, float32."""
    out = np.zeros(PROFILE + BUCKETS, np.float32)
    raw = np.frombuffer(text or b"", np.uint8)
    words = (text or b"").split()
    if not words:
        return out
    n = raw.size
    by = np.bincount(raw, minlength=256)
    upper, lower, digits, high = by[65:91].sum(), by[97:123].sum(), by[48:58].sum(), by[128:].sum()
    marks, stops = by[_MARKS].sum(), by[[46, 44, 59, 58, 63]].sum()
    lines = [x for x in text.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    unlike, runs = len(set(words)), sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    share = np.array([upper / (upper + lower + 1), digits / n, high / n, marks / n, by[33] / n, by[124] / n, by[42] / n, by[36] / n, by[35] / n, by[37] / n, by[38] / n, stops / n, by[10] / n])
    out[: share.size] = np.sqrt(share)
    out[share.size : PROFILE] = [
        np.log1p(len(words)) / 10, np.log1p(lengths.mean()) / 3, lengths.std() / 10, unlike / len(words), 1 - (pairs + 1) / len(words),
        np.sqrt(runs / len(words)), len(set(lines)) / len(lines), np.log1p(n / len(lines)) / 8, 1.0 if len(words) < 20 else 0.0, float((lengths > 25).mean()),
    ]
    count = np.zeros(BUCKETS)
    for at in range(0, n, STRIDE):
        x = raw[at : at + STRIDE + 2].astype(np.uint32)
        if x.size > 2:
            gram = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)
            count += np.bincount(gram >> np.uint32(23), minlength=BUCKETS)
    out[PROFILE:] = np.sqrt(count / max(1, count.sum()))
    return out


PROFILE = 23


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model:
    """Standardised features, weights and a Platt calibration."""

    def __init__(self, mean, scale, weights, bias, slope, shift):
        self.mean, self.scale, self.weights, self.bias, self.slope, self.shift = mean, scale, weights, bias, slope, shift

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) * self.scale, -6, 6) @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.margin(x) + self.shift)


def risk(margin_pos: np.ndarray, margin_unl: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The two parts of the risk, and the gradient to follow for each positive's and each unlabelled row's margin."""
    sp, su = _sigmoid(margin_pos), _sigmoid(margin_unl)
    positive = prior * np.logaddexp(0, -margin_pos).mean()
    negative = np.logaddexp(0, margin_unl).mean() - prior * np.logaddexp(0, margin_pos).mean()
    if negative >= 0:
        return positive, negative, prior * (sp - 1 - sp) / sp.size, su / su.size
    return positive, negative, prior * sp / sp.size, -su / su.size


def descend(p: np.ndarray, u: np.ndarray, prior: float, rounds: int = ROUNDS, decay: float = DECAY, start: np.ndarray | None = None, rate: float = RATE) -> np.ndarray:
    """Weights and bias (last) that minimise the risk of rows p and u."""
    w = np.zeros(p.shape[1] + 1) if start is None else start.astype(float)
    m, v = np.zeros(w.size), np.zeros(w.size)
    for step in range(1, rounds + 1):
        slopes = w[:-1].astype(p.dtype)
        _, _, gp, gu = risk((p @ slopes).astype(float) + w[-1], (u @ slopes).astype(float) + w[-1], prior)
        g = np.append(p.T @ gp.astype(p.dtype) + u.T @ gu.astype(u.dtype) + decay * w[:-1], gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of positives among unl from scores of both (of rows that the scorer hasn't seen)."""
    at = np.unique(pos)
    q_pos = 1 - np.searchsorted(np.sort(pos), at) / pos.size
    q_unl = 1 - np.searchsorted(np.sort(unl), at) / unl.size
    margin = np.sqrt(np.log(4 / DELTA) / 2) * (1 / np.sqrt(pos.size) + 1 / np.sqrt(unl.size))
    wide = q_pos >= TAIL
    best = np.argmin(((q_unl + margin) / q_pos)[wide])  # where the bound with its margin is least
    return float(np.clip((q_unl / q_pos)[wide][best], 1 / unl.size, 1 - 1e-3))


def _rising(y: np.ndarray) -> np.ndarray:
    """The closest sequence that never falls (pooled neighbours)."""
    pools: list[list[float]] = []
    for v in y:
        pools.append([v, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            (a, n), (b, m) = pools[-2:]
            pools[-2:] = [[(a * n + b * m) / (n + m), n + m]]
    return np.repeat([v for v, _ in pools], [n for _, n in pools])


def calibrate(pos: np.ndarray, unl: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift from margins of rows that the model hasn't seen. Among unlabelled rows of like margin the
    share of positives is prior * density of positives / density of unlabelled; a logistic curve is fitted to that."""
    z = np.sort(unl)
    bins = np.array_split(z, max(1, z.size // 25))
    edges = np.array([(a[-1] + b[0]) / 2 for a, b in zip(bins, bins[1:], strict=False)])
    here = np.bincount(np.searchsorted(edges, pos, side="right"), minlength=len(bins))
    share = prior * (here / pos.size) / (np.array([b.size for b in bins]) / z.size)
    target = np.repeat(_rising(share), [b.size for b in bins]).clip(1e-3, 1 - 1e-3)
    spread = z.std() + 1e-9
    x, w = np.stack([z / spread, np.ones(z.size)], 1), np.array([1.0, 0.0])
    for _ in range(100):  # Newton's method, with a little weight on where it starts
        y = _sigmoid(x @ w)
        grad = x.T @ (y - target) + 1e-2 * (w - [1, 0])
        w = w - np.linalg.solve((x * (y * (1 - y))[:, None]).T @ x + 1e-2 * np.eye(2), grad).clip(-2, 2)
    return max(w[0], 1e-3) / spread, w[1]


def fit(pos: np.ndarray, unl: np.ndarray) -> Model:
    mean, scale = unl.mean(0, dtype=float), 1 / (unl.std(0, dtype=float) + 1e-3)
    p, u = (np.clip((x - mean) * scale, -6, 6).astype(np.float32) for x in (pos, unl))
    (p1, p2), (u1, u2) = ((x[::2], x[1::2]) for x in (p, u))
    # First classifier: positives against unlabelled, which is the risk of prior 1/2 with unl as negatives.
    first = descend(p1, u1, 0.5, ROUNDS // 3)
    prior = estimate_prior(*((x @ first[:-1]).astype(float) + first[-1] for x in (p2, u2)))
    half = descend(p1, u1, prior)
    slope, shift = calibrate(*(x @ half[:-1] + half[-1] for x in (p2, u2)), prior)
    whole = descend(p, u, prior, ROUNDS // 3, start=half)
    return Model(mean, scale, whole[:-1], whole[-1], slope, shift)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [features(t.as_py()).tobytes() for t in b.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), *b.columns[1:]], ["x", "pos", "unl", "h"])


def learn(docs: DataFrame, labels: DataFrame) -> Model | float:
    train = fold(F.col("doc_id"), 5) != 0
    trusted = labelled(labels, "quality", train).filter("y = 1")
    web = docs.select("doc_id").filter(train & F.col("doc_id").isNotNull())
    kinds = (
        lowest(trusted, SAMPLE, "trusted").select("doc_id", F.lit(True).alias("pos"), F.lit(False).alias("unl"))
        .union(lowest(web, SAMPLE, "web").select("doc_id", F.lit(False), F.lit(True)))
    )
    picked = kinds.groupBy("doc_id").agg(F.max("pos").alias("pos"), F.max("unl").alias("unl"))
    sampled = with_text(docs, picked).select("text", "pos", "unl", F.xxhash64("doc_id", "text").alias("h"))
    rows = sampled.mapInArrow(_features, "x binary, pos boolean, unl boolean, h long").collect()  # two samples' rows
    rows.sort(key=lambda r: (r.h, r.x))
    pos, unl = (np.array([getattr(r, k) for r in rows], bool) for k in ("pos", "unl"))
    if min(pos.sum(), unl.sum()) < LEAST:
        return 0.5
    x = np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(len(rows), -1)
    del rows
    return fit(x[pos], x[unl])


def scorer(model: Model | float) -> "callable":
    """A column function: text (binary) to score."""
    import pandas as pd
    from pyspark.sql.types import DoubleType

    def of(texts: pd.Series) -> pd.Series:
        if isinstance(model, float):
            return pd.Series(np.full(len(texts), model))
        out = np.empty(len(texts))
        for at in range(0, len(texts), 512):
            out[at : at + 512] = model.score(np.stack([features(t) for t in texts[at : at + 512]]).astype(float))
        return pd.Series(out)

    of.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(of, DoubleType())


def score_of(docs: DataFrame, labels: DataFrame) -> Column:
    """The score of the column text, by a model learned from these tables."""
    return scorer(learn(docs, labels))(F.col("text").cast("binary"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = docs.select("doc_id", score_of(docs, labels).alias("score"))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts, all columns kept."""
    return docs.filter(score_of(docs, labels) >= CUT)
