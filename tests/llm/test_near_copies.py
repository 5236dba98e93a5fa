"""The pipeline's near-dedup against brute force over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from covergrid.llm import near_copies
from tests.llm.test_dedup import plain_components

import corpus_pipeline


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def plain_kept(texts):
    """Indexes that stay, by comparing all pairs."""
    sets = [plain_shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if not sets[a] and not sets[b] or len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i for i in range(len(texts)) if parent[i] == i}


def variant(rnd, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rnd.randrange(len(out))] = f"w{rnd.randrange(5000)}"
    return " ".join(out)


@pytest.mark.parametrize("edits", [(1, 2, 4, 6, 9), (3, 4, 5, 5, 6)])
def test_whole_near_copies(spark, edits):
    """Groups of copies of an original, of copies of copies, and groups whose originals are alike but not similar."""
    rnd = random.Random(3)
    texts = [None, "", " \t ", "a b", "A  b", "a b c d e", "a b c d e f"]
    shared = [f"w{rnd.randrange(5000)}" for _ in range(130)]
    for n in edits:
        words = shared + [f"w{rnd.randrange(5000)}" for _ in range(70)]
        texts += [variant(rnd, words, n) for _ in range(12)]
        for _ in range(5):
            texts.append(variant(rnd, texts[-1].split(), 2))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    kept = near_copies.keep_representatives(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == plain_kept(texts)
    assert near_copies.keep_representatives(docs.limit(0)).count() == 0


def test_members_of_one_centre(spark):
    """All similar members of which one at least is not similar to the centre, and no pair of two that are."""
    import numpy as np

    rnd = random.Random(11)
    centre = [f"w{rnd.randrange(400)}" for _ in range(60)]
    texts = [variant(rnd, centre, n) for n in (1, 1, 2, 2, 3, 3, 4, 5, 6) for _ in range(8)]
    texts += [variant(rnd, t.split(), 1) for t in texts[40:]] + [" ".join(centre[:n]) for n in (5, 30, 45, 48, 50, 55)] + [t + " x y z" for t in texts[:5]] + ["q r s t u v"]
    sets = {near_copies.vertex_of(s): s for s in (near_copies.shingles(t.encode()) for t in [" ".join(centre), *texts])}
    hub, *others = sets
    rows = []
    for v in others:
        near, apart, size, diff, first = near_copies.difference(sets[v].tobytes(), sets[hub].tobytes())
        rows.append((v, hub, near, apart, size, diff, first.view(np.int64).tolist()))
    stars = spark.createDataFrame(rows, "u long, v long, near boolean, apart double, size long, diff long, tokens array<long>")
    found = {frozenset((r.u, r.v)) for r in near_copies._siblings(stars).collect()}
    close = {r[0] for r in rows if r[2]}
    similar = lambda a, b: len(np.intersect1d(sets[a], sets[b])) * 5 >= 4 * len(np.union1d(sets[a], sets[b]))
    assert close == {v for v in others if similar(v, hub)} and 5 < len(close) < len(others) - 5
    wanted = {frozenset((a, b)) for a in others for b in others if a != b and not {a, b} <= close and similar(a, b)}
    assert len(wanted) > 20 and wanted <= found and not any(p <= close for p in found)


def test_stage_drops_copies_that_simhash_passes(spark):
    from tests.llm.test_dedup import plain_fingerprint

    rnd = random.Random(7)
    texts = []
    for _ in range(20):
        words = [f"w{rnd.randrange(5000)}" for _ in range(120)]
        texts += [" ".join(words), variant(rnd, words, 2)]
    assert len(set(plain_components([plain_fingerprint(t) for t in texts]))) > 20 == len(plain_kept(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()} == plain_kept(texts)


def test_ids_that_are_null_or_repeated(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "x y z"), (3, "A b c"), (4, "p q r"), (4, "s t u")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in near_copies.keep_representatives(docs).collect() if r.doc_id is not None) == [(3, "A b c"), (4, "p q r"), (4, "s t u")]


def test_index_of_fingerprints(spark):
    """Keys are those of multi-index hashing: the set's SimHash fingerprint, found by whatever lies within three bits of it."""
    import numpy as np

    rnd = random.Random(5)
    for n in (1, 2, 40, 5000):
        hashes = np.array(sorted({rnd.getrandbits(64) for _ in range(n)}), np.uint64)
        fp = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes.tolist()) * 2 > n)
        assert set(near_copies.index_keys(hashes)) == keys_of(fp)
        for _ in range(50):
            other = fp
            for _ in range(rnd.randint(1, 3)):
                other ^= 1 << rnd.randrange(64)
            assert keys_of(fp) & keys_of(other)
    assert near_copies.index_keys(np.empty(0, np.uint64)) == []


def keys_of(fp):
    halves = [fp & 0xFFFFFFFF, fp >> 32]
    return {i << 32 | x | b for i, x in enumerate(halves) for b in [0, *(1 << k for k in range(32))] if not x & b}


def two_texts(seed):
    rnd = random.Random(seed)
    words = [f"w{rnd.randrange(5000)}" for _ in range(66)]
    return " ".join(words[:60]), " ".join(words[:54] + words[60:])


def test_near_copies_that_share_no_band(spark):
    """Two texts at similarity 50/62 that the index alone finds."""
    a, b = two_texts(206214)
    x, y = (near_copies.shingles(t.encode()) for t in (a, b))
    assert not set(near_copies.band_keys(x)) & set(near_copies.band_keys(y)) and plain_kept([a, b]) == {0}
    docs = spark.createDataFrame([(0, a), (1, b)], "doc_id long, text string")
    assert {r.doc_id for r in near_copies.keep_representatives(docs).collect()} == {0}


@pytest.mark.parametrize("crowd", [1, 1000])
def test_members_of_a_centre_far_from_most(spark, crowd):
    """No link is lost where the centre of many copies is not their original, and hardly a pair is compared in vain there."""
    import numpy as np

    from covergrid.llm.components import roots

    rnd = random.Random(13)
    original = [f"w{rnd.randrange(5000)}" for _ in range(150)]
    texts = [variant(rnd, original, n) for n in (1, 2, 3, 4, 5, 6, 8, 10) for _ in range(20)]
    texts += [variant(rnd, t.split(), 1) for t in texts[100:]]
    sets = {near_copies.vertex_of(s): s for s in (near_copies.shingles(t.encode()) for t in [variant(rnd, original, 3), *texts])}
    hub, *others = sets
    rows = []
    for v in others:
        near, apart, size, base, diff, tokens = near_copies.told_apart(sets[v].tobytes(), sets[hub].tobytes())
        rows.append((v, hub, near, apart, size, base, diff, tokens.view(np.int64).tolist()))
    turned, sure = near_copies._turned(spark.createDataFrame(rows, near_copies._STARS), crowd)
    found = {(r.u, r.v) for r in near_copies._siblings(near_copies._prefixes(turned), F.col("skip")).collect()}
    certain = {(r.u, r.v) for r in sure.collect()} | {(r[0], hub) for r in rows if r[2]}
    similar = lambda a, b: len(np.intersect1d(sets[a], sets[b])) * 5 >= 4 * len(np.union1d(sets[a], sets[b]))
    assert all(similar(*p) for p in certain)
    group = lambda pairs: [x.tolist() for x in roots(*(np.array(c, np.int64) for c in zip(*sorted(pairs), strict=True)))]
    wanted = {(a, b) for a in sets for b in sets if a < b and similar(a, b)}
    assert group(wanted) == group(certain | {p for p in found if similar(*p)})
    if crowd == 1:
        assert 0 < len(certain) and len(found) < 4 * len(others)
