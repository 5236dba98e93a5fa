"""Substring dedup by seed and extend.

Seeds.   Words are hashed; of each WINDOW consecutive words the smallest hash of ANCHOR consecutive
         ones is the window's anchor (winnowing). Equal windows have equal anchors, and neighbouring
         windows mostly share theirs, so a text has about a fifth as many anchors as words.
Join.    Anchors meet those of all other documents. An anchor that no second document has rules out
         every window it stands for; what remains is a small part of the corpus.
Extend.  Around each shared anchor the windows that it stands for are compared to both sides by a
         96-bit hash of all their words, and a window that starts in a document with a smaller id is
         a repeat. Adjacent and overlapping repeats merge into maximal ones, WINDOW words or longer.

Both meetings send one row per key and task: within a task the smallest id answers for all, so a
passage that a third of all documents share costs each task one row of it, and no group is larger
than the number of tasks. Texts travel compressed.

Defined results: null texts have no words; a document of fewer than WINDOW words loses nothing; a
null id counts as larger than every id; documents under one id are not each other's copies (neither is
smaller), and are told apart by their text; ids are taken as longs; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WINDOW, ANCHOR = 13, 5
#: Anchors or windows that a task gathers before it sends them on.
AT_ONCE = 1 << 20
_LAST = (1 << 63) - 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def rolling(x: np.ndarray, width: int, factor: np.uint64) -> np.ndarray:
    """A hash of each run of ``width`` consecutive values."""
    n = x.size - width + 1
    out = x[:n].copy()
    for i in range(1, width):
        out *= factor
        out += x[i : i + n]
    out ^= out >> np.uint64(31)
    out *= _B
    out ^= out >> np.uint64(29)
    return out


def anchors(x: np.ndarray) -> np.ndarray:
    """The anchor of each window of WINDOW words, given their hashes."""
    grams = rolling(x, ANCHOR, _A)
    span = WINDOW - ANCHOR + 1
    n = grams.size - span + 1
    out = grams[:n].copy()
    for i in range(1, span):
        np.minimum(out, grams[i : i + n], out=out)
    return out


def _first_of(keys: list[np.ndarray]) -> np.ndarray:
    """True where a row of the sorted columns differs from the row before."""
    new = np.zeros(keys[0].size, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _spread(ids: np.ndarray) -> pa.Array:
    """Keys for rows that are answered already, so that they don't crowd one partition."""
    return pa.array((ids.view(np.uint64) * _A).view(np.int64))


def _meet_anchors(found: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """found: id, text hash, anchors. Rows to send: one for each anchor, with its smallest id; known to
    be shared: one row a document, with its anchors as bytes."""
    h = np.concatenate([f[2] for f in found])
    of = np.repeat(np.arange(len(found)), [f[2].size for f in found])
    ids, rks = np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64)
    order = np.lexsort((of, ids[of], h))
    h, of = h[order], of[order]
    first = _first_of([h])
    size = np.diff(np.append(np.flatnonzero(first), h.size))
    crowd = np.repeat(size > 1, size)
    at = of[first]
    names = ["k", "doc", "rk", "shared", "known"]
    yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(ids[at]), pa.array(rks[at]), pa.array(crowd[first]), pa.nulls(at.size, pa.binary())], names)
    rest, ro = h[~first], of[~first]
    order = np.argsort(ro, kind="stable")
    rest, ro = rest[order], ro[order]
    at = np.flatnonzero(_first_of([ro])) if ro.size else np.zeros(0, np.int64)
    ends = np.append(at, ro.size)[1:]
    blobs = [rest[i:e].tobytes() for i, e in zip(at, ends, strict=True)]
    yield pa.RecordBatch.from_arrays([_spread(ids[ro[at]]), pa.array(ids[ro[at]]), pa.array(rks[ro[at]]), pa.array(np.ones(at.size, bool)), pa.array(blobs, pa.binary())], names)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, n = [], 0
    for b in batches:
        for doc, rk, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            words = (text.as_py() or b"").split()
            if len(words) >= WINDOW:
                a = np.unique(anchors(word_hashes(words)))
                found.append((doc, rk, a))
                n += a.size
            if n >= AT_ONCE:
                yield from _meet_anchors(found)
                found, n = [], 0
    if found:
        yield from _meet_anchors(found)


def _meet_windows(found: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """found: id, text hash, window hash, check, position. Rows to send: one for each window and its
    smallest id, with all its positions there; known repeats: one row a document, with their positions."""
    w, c, pos = (np.concatenate([f[i] for f in found]) for i in (2, 3, 4))
    of = np.repeat(np.arange(len(found)), [f[4].size for f in found])
    ids, rks = np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64)
    order = np.lexsort((pos, of, ids[of], c, w))
    w, c, pos, of = w[order], c[order], pos[order], of[order]
    group = _first_of([w, c])
    least = ids[of[np.flatnonzero(group)]][np.cumsum(group) - 1]
    asks = ids[of] == least
    known = ~asks
    w, c, asked_pos, asked_of = w[asks], c[asks], pos[asks], of[asks]
    lead = _first_of([w, c, asked_of])
    at = np.flatnonzero(lead)
    ends = np.append(at, w.size)[1:]
    more: list[bytes | None] = [None] * at.size
    for i in np.flatnonzero(ends - at > 1):
        more[i] = asked_pos[at[i] + 1 : ends[i]].astype("<i4").tobytes()
    names = ["w", "c", "doc", "rk", "pos", "more", "known"]
    yield pa.RecordBatch.from_arrays(
        [pa.array(w[at].view(np.int64)), pa.array(c[at]), pa.array(ids[asked_of[at]]), pa.array(rks[asked_of[at]]), pa.array(asked_pos[at].astype(np.int32)), pa.array(more, pa.binary()), pa.array(np.zeros(at.size, bool))], names
    )
    order = np.lexsort((pos[known], of[known]))
    kp, ko = pos[known][order], of[known][order]
    at = np.flatnonzero(_first_of([ko])) if ko.size else np.zeros(0, np.int64)
    ends = np.append(at, ko.size)[1:]
    blobs = [kp[a + 1 : e].astype("<i4").tobytes() for a, e in zip(at, ends, strict=True)]
    yield pa.RecordBatch.from_arrays(
        [_spread(ids[ko[at]]), pa.array(np.zeros(at.size, np.int32)), pa.array(ids[ko[at]]), pa.array(rks[ko[at]]), pa.array(kp[at].astype(np.int32)), pa.array(blobs, pa.binary()), pa.array(np.ones(at.size, bool))], names
    )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack, found, n = zstandard.ZstdDecompressor(), [], 0
    for b in batches:
        for i in range(b.num_rows):
            doc, rk, z, shared, known = (b.column(k)[i] for k in range(5))
            words = unpack.decompress(z.as_py()).split()
            if len(words) < WINDOW:
                continue
            x = word_hashes(words)
            wanted = np.concatenate([shared.values.to_numpy(zero_copy_only=False).view(np.uint64), *(np.frombuffer(k, np.uint64) for k in known.as_py())])
            at = np.flatnonzero(np.isin(anchors(x), wanted))
            if at.size:
                w = rolling(x, WINDOW, _A)[at]
                c = (rolling(x >> np.uint64(7), WINDOW, _B)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                found.append((doc.as_py(), rk.as_py(), w, c, at))
                n += at.size
            if n >= AT_ONCE:
                yield from _meet_windows(found)
                found, n = [], 0
    if found:
        yield from _meet_windows(found)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges repeats, cuts them out: n_words, n_removed, kept, spans."""
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        n_words, n_removed, kept, spans = [], [], [], []
        for i in range(b.num_rows):
            z, pos, more = (b.column(k)[i] for k in (1, 2, 3))
            words = unpack.decompress(z.as_py()).split()
            n_words.append(len(words))
            if not pos.is_valid or not len(pos.values):
                n_removed.append(0)
                kept.append(b" ".join(words))
                spans.append([])
                continue
            first = [pos.values.to_numpy(zero_copy_only=False)]
            first += [np.frombuffer(m, "<i4") for m in more.as_py() or ()]
            starts = np.unique(np.concatenate(first))
            edge = np.flatnonzero(np.append(True, starts[1:] > starts[:-1] + WINDOW))
            runs = list(zip(starts[edge].tolist(), (starts[np.append(edge[1:], starts.size) - 1] + WINDOW).tolist(), strict=True))
            out, at = [], 0
            for a, e in runs:
                out += words[at:a]
                at = e
            out += words[at:]
            n_removed.append(len(words) - len(out))
            kept.append(b" ".join(out))
            spans.append([{"first": a, "last": e - 1} for a, e in runs])
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))],
            ["doc", "n_words", "n_removed", "kept", "spans"],
        )


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(3)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pack.compress(t.as_py() or b"") for t in b.column(2)], pa.binary())], ["doc", "rk", "z"])


def cut_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, UTF-8, single spaces) and spans (the maximal
    repeats cut, by their first and last word) for every row of docs (doc_id, text)."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    repeated = not docs.select(doc.alias("doc")).groupBy("doc").count().filter("count > 1").isEmpty()
    # The text's hash is carried along only where ids don't tell documents apart.
    key = ["doc", "rk"] if repeated else ["doc"]
    rk = F.coalesce(F.xxhash64("text"), F.lit(0)) if repeated else F.lit(0).cast("long")
    text = docs.select(doc.alias("doc"), rk.alias("rk"), F.col("text").cast("binary").alias("text"))

    seeds = text.mapInArrow(_seeds, "k long, doc long, rk long, shared boolean, known binary").select("k", *key, "shared", "known")
    asks = F.col("known").isNull()
    met = seeds.withColumn("met", F.count_if(asks).over(Window.partitionBy("k"))).filter(~asks | F.col("shared") | (F.col("met") > 1))
    shared = met.groupBy(*key).agg(F.collect_list(F.when(asks, F.col("k"))).alias("shared"), F.collect_list("known").alias("known"))

    # No key is null; said here, both joins below read one and the same shuffle of the texts.
    packed = text.mapInArrow(_compressed, "doc long, rk long, z binary").select(*key, "z").filter(" and ".join(f"{k} is not null" for k in key))
    rk = F.col("rk") if repeated else F.lit(0).cast("long")
    windows = packed.join(shared, key).select("doc", rk.alias("rk"), "z", "shared", "known").mapInArrow(_windows, "w long, c int, doc long, rk long, pos int, more binary, known boolean")
    windows = windows.select("w", "c", *key, "pos", "more", "known")
    least = F.min(F.when(~F.col("known"), F.col("doc"))).over(Window.partitionBy("w", "c"))
    repeats = windows.withColumn("least", least).filter("known or least < doc")
    repeats = repeats.groupBy(*key).agg(F.collect_list("pos").alias("pos"), F.collect_list("more").alias("more"))

    joined = packed.join(repeats, key, "left").select("doc", "z", "pos", "more")
    done = joined.mapInArrow(_cut, "doc long, n_words long, n_removed long, kept binary, spans array<struct<first:long,last:long>>")
    return done.select(F.when(F.col("doc") != _LAST, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept", "spans")
