"""Packing against the tokenizers library and its own invariants."""

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Oracle

from covergrid.llm import packing

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.fixture(scope="module")
def oracle():
    return Oracle.from_file(public_tokenizers.path("byte_bpe_50k.json"))


AWKWARD = [
    "", " ", "a", " a", "a ", "a  b", "a \n b", "\n\n x", "it's  we'll 'tis", "x\t y", "<|endoftext|> a<|endoftext|>", "é à ü", "1 234  5",
    "a  b", "a 　b", "…  !! ?", "a\x1c b \x85 c", "\U0001f600 \U0001f600", "tail  ",
]


def test_ids_equal_the_tokenizer(oracle):
    t = packing.Tokenizer(added=packing.added_tokens())
    for text in AWKWARD * 2:
        assert np.frombuffer(t.ids(text), "<u4").tolist() == oracle.encode(text, add_special_tokens=False).ids, repr(text)


@given(st.text(alphabet=st.sampled_from(list("ab 1'\n\t.é s")), max_size=40))
@settings(max_examples=300, deadline=None)
def test_ids_of_any_text(text):
    t = _shared()
    assert np.frombuffer(t.ids(text), "<u4").tolist() == t.encoding.encode_ordinary(text)


_T = []


def _shared():
    if not _T:
        _T.append(packing.Tokenizer())
    return _T[0]


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 6), max_size=12), st.integers(0, 64))
@settings(max_examples=200, deadline=None)
def test_best_fill_is_best(have, room):
    sums = {0}
    for n, k in have.items():
        sums = {s + n * i for s in sums for i in range(k + 1)}
    got = packing.best_fill(have, room)
    assert all(k <= have[n] for n, k in got.items())
    assert sum(n * k for n, k in got.items()) == max(s for s in sums if s <= room)


@given(st.dictionaries(st.integers(1, 128), st.integers(1, 40), max_size=30))
@settings(max_examples=200, deadline=None)
def test_plan_places_every_id_once(histogram):
    rows = packing.plan(histogram, 128, 8)
    sequences, parts = {}, {}
    for length, lo, hi, first, last, seq, offset in rows:
        for rank in range(first, last):
            sequences.setdefault(seq + rank - first, []).append((offset, hi - lo))
            parts.setdefault((length, rank), []).append((lo, hi))
    assert set(parts) == {(n, r) for n, k in histogram.items() for r in range(k)}
    for (n, _), p in parts.items():
        p.sort()
        assert p[0][0] == 0 and p[-1][1] == n and all(a[1] == b[0] for a, b in zip(p, p[1:]))
    fills = []
    for p in sequences.values():
        p.sort()
        assert p[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(p, p[1:]))
        fills.append(p[-1][0] + p[-1][1])
    assert all(f <= 128 for f in fills)
    assert sum(f <= 120 for f in fills) <= 1  # all but the last are filled to within a grain


def check(rows, texts, oracle):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, text in texts.items():
        ids = np.array([*oracle.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc.pop(i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for p in by_seq.values():
        at = 0
        for r in sorted(p, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_pack_end_to_end(spark, oracle):
    rnd = random.Random(5)
    texts = {i: " ".join(rnd.choice(["lorem", "ipsum", "dolor\n", "sit,"]) for _ in range(rnd.choice([0, 3, 700, 1500, 3000]))) for i in range(60)}
    texts |= {100 + i: "same words again " * 350 for i in range(25)} | {200: None, 201: ""}
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in texts.items()], "doc_id long, text string, length string, rank int")
    rows = packing.pack(docs).collect()
    check(rows, texts, oracle)
    fill = sum(r.length for r in rows) / (2048 * len({r.sequence_id for r in rows}))
    assert fill > 0.93
    assert packing.pack(docs.limit(0)).count() == 0


def test_slices_and_blocks(spark, oracle, monkeypatch):
    """Many equal rows under one id: ranks run through all slices and blocks without a gap."""
    monkeypatch.setattr(packing, "SLICE", 3)
    monkeypatch.setattr(packing, "BLOCK", 4)
    docs = spark.range(400).select(packing.F.lit(7).cast("long").alias("doc_id"), packing.F.lit("same words").alias("text")).repartition(5)
    rows = packing.pack(docs).collect()
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    assert len(rows) == 400 and len({p[:2] for p in places}) == 400
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(places, places[1:]))


def test_repeated_rows_are_packed_each(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 3 + [(None, "x")], "doc_id long, text string")
    rows = packing.pack(docs).collect()
    assert len(rows) == 4 and len({(r.sequence_id, r.offset) for r in rows}) == 4
