"""Packing by minimum bin slack.

A document's ids are its byte-level BPE ids and END. It is cut at every multiple of WINDOW; full
pieces are windows of their own. What remains of each document is packed: the histogram of remaining
lengths (fewer than WINDOW rows, however many documents) comes to the driver, and there, window by
window, a bitset subset-sum over the multiset of lengths finds the fill closest to the capacity; the
counts are backtracked and the window is repeated as often as the multiset allows. Where even the
best fill leaves GRAIN ids or more, one more document is cut at a multiple of GRAIN to fill it.

Documents find their places by rank among those of equal length, taken in slices of about SLICE rows,
dealt out by where the tokenizing pass met them (so that equal rows are dealt out too), and slices in
blocks of BLOCK: no length, however common, is ranked in one task. The plan's rows name intervals of ranks.

crc32 of a piece that the plan cuts later comes from running crcs at every GRAIN ids, which the
tokenizing pass leaves behind: texts are read and tokenized once.

Tokenizing: a text is cut at the vocabulary's added tokens, and between them falls into units at single spaces between non-spaces, where the tokenizer's own
pattern always splits, and units' ids are remembered (at most REMEMBERED of them).

Defined results: a null text is empty, and an empty text is the one id END; rows that repeat an id or
a text are packed each; an empty table gives no rows; all columns but doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from covergrid.llm.util import staged

WINDOW, GRAIN, END = 2048, 64, 1
SLICE, BLOCK = 250, 1 << 12
REMEMBERED, REMEMBERED_CHARS = 400_000, 40
#: The same vocabulary as byte_bpe_50k.json, as ranks.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens(path: str | None = None) -> dict[str, int]:
    """The tokens that byte_bpe_50k.json matches in the raw text, before it is split into units."""
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in tokens):
        raise ValueError("added tokens that take in more than their own text")
    return {t["content"]: t["id"] for t in tokens}


_TWO_SPACES, _SPLIT = re.compile(r"\s\s"), re.compile(r"(?<!\s) (?!\s)")


class _Units(dict):
    """The ids of units met before, by what follows their first character, which all of them share."""

    def __init__(self, encoding: tiktoken.Encoding, lead: str):
        super().__init__()
        self.encoding, self.lead = encoding, lead

    def __missing__(self, unit: str) -> bytes:
        found = self.encoding.encode_ordinary(self.lead + unit)
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(unit) <= REMEMBERED_CHARS:
            self[unit] = ids
        return ids


class Tokenizer:
    """Texts to ids as little-endian unsigned 32-bit integers; added tokens are recognised wherever they stand."""

    def __init__(self, ranks: str = RANKS, added: dict[str, int] | None = None):
        with open(ranks, "rb") as f:
            vocabulary = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens={})
        self.first, self.later = _Units(self.encoding, ""), _Units(self.encoding, " ")
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in (added or {}).items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None

    def ids(self, text: str) -> bytes:
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        return b"".join(self.added[p] if i % 2 else self._plain(p) for i, p in enumerate(self.cut.split(text)))

    def _plain(self, text: str) -> bytes:
        parts = _SPLIT.split(text) if _TWO_SPACES.search(text) else text.split(" ")
        for units in (self.first, self.later):
            if len(units) > REMEMBERED:
                units.clear()
        head = self.first[parts[0]] if parts[0] else b""
        return head + b"".join(map(self.later.__getitem__, parts[1:]))


def pieces_of(ids: bytes) -> Iterator[tuple[int, int, int, list[int] | None]]:
    """(start, length, crc32, running crcs at every GRAIN ids of a piece shorter than WINDOW)"""
    for start in range(0, len(ids) // 4, WINDOW):
        part = ids[4 * start : 4 * (start + WINDOW)]
        if len(part) == 4 * WINDOW:
            yield start, WINDOW, zlib.crc32(part), None
            continue
        running, crc = [], 0
        for at in range(0, len(part), 4 * GRAIN):
            crc = zlib.crc32(part[at : at + 4 * GRAIN], crc)
            running.append(crc)
        yield start, len(part) // 4, crc, running[: (len(part) - 1) // (4 * GRAIN)]


def pieces(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, start, length, crc, doc_tokens, running, met (which piece of which task it is): each document
    cut at multiples of WINDOW."""

    added = added_tokens()

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = Tokenizer(ranks, added), np.array([END], "<u4").tobytes()
        met = TaskContext.get().partitionId() << 40
        for b in rows:
            at, cols = [], ([], [], [], [], [])
            for i, text in enumerate(b.column(1)):
                ids = tokenizer.ids((text.as_py() or b"").decode("utf-8", "replace")) + end
                for start, n, crc, running in pieces_of(ids):
                    at.append(i)
                    for c, v in zip(cols, (start, n, crc, len(ids) // 4, running), strict=True):
                        c.append(v)
            made = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)]
            count = pa.array(np.arange(met, met + len(at)))
            met += len(at)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), *made, count], ["doc_id", "start", "length", "crc", "doc_tokens", "running", "met"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(batches, f"doc_id {kind}, start long, length int, crc long, doc_tokens long, running array<long>, met long")


def best_fill(have: dict[int, int], room: int) -> dict[int, int]:
    """length -> count with the largest sum up to room, of at most have[length] each."""
    reach, mask, steps = 1, (1 << room + 1) - 1, []
    for n in sorted((n for n, k in have.items() if k and n <= room), reverse=True):
        left, batch = min(have[n], room // n), 1
        while left:
            take = min(batch, left)
            steps.append((n, take, reach))
            reach |= reach << n * take & mask
            left, batch = left - take, batch * 2
        if reach >> room:
            break
    total, out = reach.bit_length() - 1, defaultdict(int)
    for n, take, before in reversed(steps):
        if not before >> total & 1:
            out[n] += take
            total -= n * take
    return dict(out)


def plan(histogram: dict[int, int], window: int = WINDOW, grain: int = GRAIN) -> list[tuple[int, int, int, int, int, int, int]]:
    """(length, lo, hi, first rank, last rank + 1, first sequence, offset): ids lo to hi of the pieces of
    that length and those ranks go to that place, each rank to the next sequence."""
    rows, sequence = [], histogram.get(window, 0)
    if sequence:
        rows.append((window, 0, window, 0, sequence, 0, 0))
    # What is left, by how long it is: runs (piece length, lo, first rank, last rank + 1).
    runs = {n: deque([(n, 0, 0, k)]) for n, k in histogram.items() if n < window and k}
    have = {n: k for n, k in histogram.items() if n < window and k}
    largest = sorted(have)

    def take(n: int, times: int, offset: int, size: int) -> None:
        """The next times items that are n long, size ids of each, into the sequences from here on; the rest of them goes back."""
        done = 0
        while done < times:
            piece, lo, first, last = runs[n].popleft()
            k = min(times - done, last - first)
            rows.append((piece, lo, lo + size, first, first + k, sequence + done, offset))
            if first + k < last:
                runs[n].appendleft((piece, lo, first + k, last))
            if size < n:
                if n - size not in have:
                    largest.append(n - size)
                    largest.sort()
                runs.setdefault(n - size, deque()).append((piece, lo + size, first, first + k))
                have[n - size] = have.get(n - size, 0) + k
            done += k
        have[n] -= times

    while True:
        while largest and not have[largest[-1]]:
            have.pop(largest.pop())
        if not largest:
            return rows
        seed = largest[-1]
        have[seed] -= 1
        fill = best_fill(have, window - seed)
        have[seed] += 1
        fill[seed] = fill.get(seed, 0) + 1
        slack = window - sum(n * k for n, k in fill.items())
        cut = slack // grain * grain
        times = min(have[n] // k for n, k in fill.items())
        spare = None
        if cut:
            left = {n: have[n] - fill.get(n, 0) for n in largest if n > cut}
            spare = next((n for n in reversed(largest) if n > cut and left[n] > 0), None)
            if spare is not None:
                times = min(times, have[spare] // (fill.get(spare, 0) + 1))
        offset = 0
        for n, k in sorted(fill.items(), reverse=True):
            for _ in range(k):
                take(n, times, offset, n)
                offset += n
        if spare is not None:
            take(spare, times, offset, cut)
        sequence += times


@F.pandas_udf(LongType())
def _crc_between(running: pd.Series, crc: pd.Series, length: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
    """crc32 of ids lo to hi from running crcs: crc32 is affine in what came before."""
    out = []
    for r, c, n, a, b in zip(running, crc, length, lo, hi, strict=True):
        if a == 0 and b == n:
            out.append(c)
            continue
        before, to = (int(r[a // GRAIN - 1]) if a else 0), (int(c) if b == n else int(r[b // GRAIN - 1]))
        zeros = bytes(4 * (b - a))
        out.append(to ^ zlib.crc32(zeros, before) ^ zlib.crc32(zeros))
    return pd.Series(out, dtype="int64")


def pack(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece."""
    spark = docs.sparkSession
    cut = staged(pieces(docs, ranks), "pieces")
    histogram = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}  # WINDOW rows at most
    places = spark.createDataFrame(plan(histogram), "length int, lo int, hi int, first long, last long, sequence long, offset long")
    slices = spark.createDataFrame([(n, 1 + k // SLICE) for n, k in histogram.items()], "length int, slices long")
    sliced = cut.join(F.broadcast(slices), "length").withColumn("slice", F.pmod(F.xxhash64("met"), F.col("slices"))).withColumn("block", F.floor(F.col("slice") / BLOCK))
    sizes = staged(sliced.groupBy("length", "block", "slice").count(), "slices")
    upto = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.groupBy("length", "block").agg(F.sum("count").alias("n"))
    blocks = blocks.select("length", "block", F.coalesce(F.sum("n").over(upto("length", "block")), F.lit(0)).alias("first_of_block"))
    inside = F.coalesce(F.sum("count").over(upto("length", "block", "slice")), F.lit(0))
    sizes = sizes.withColumn("inside", inside).join(blocks, ["length", "block"]).select("length", "slice", (F.col("first_of_block") + F.col("inside")).alias("before"))
    order = Window.partitionBy("length", "slice").orderBy("met")
    ranked = sliced.withColumn("nth", F.row_number().over(order)).join(sizes, ["length", "slice"]).withColumn("rank", F.col("before") + F.col("nth") - 1)
    placed = ranked.join(F.broadcast(places), (ranked.length == places.length) & (ranked["rank"] >= places["first"]) & (ranked["rank"] < places["last"])).drop(places.length)
    return placed.select(
        "doc_id", (F.col("start") + F.col("lo")).alias("start"), (F.col("hi") - F.col("lo")).cast("long").alias("length"),
        _crc_between("running", "crc", "length", "lo", "hi").alias("ids_crc32"), "doc_tokens",
        (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset",
    )
