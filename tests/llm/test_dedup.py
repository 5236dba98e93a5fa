"""Exact, near and substring dedup, and decontamination, against brute force on small tables with
nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from covergrid.llm import decontaminate, exact_dedup, simhash, substring_dedup
from covergrid.llm.components import components

SCHEMA = "doc_id long, text string, h string, fp long, count long"


def docs(spark, texts, extra=()):
    """(doc_id, text) rows with further columns whose names operators use inside."""
    rows = [(i, t, "x", 1, 2) for i, t in [*enumerate(texts), *extra]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 70))) for _ in range(40)]
    made = list(base)
    for t in base[:15]:
        w = t.split()
        w[rnd.randrange(len(w))] = "changed"
        made.append("  ".join(w))
    made += [base[3], base[3] + " ", base[3].replace(" ", "\n"), base[4] + " " + base[5], base[5] + " tail", None, "", " ", "\t\n", "one", "one two", "É " + base[0], "x " * 3000]
    return made


# ---- exact ----

def test_exact(spark, texts):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(norm):
        same = [j for j, u in enumerate(norm) if u == t]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (same[0], len(same), same[0] == i, hashlib.sha256(t.encode()).hexdigest())


def test_exact_with_colliding_hashes(spark, texts):
    """Bytes are compared: a hash that is the same for all texts merges nothing."""
    d = docs(spark, texts)
    want = sorted(map(tuple, exact_dedup.exact_groups(d).collect()))
    assert sorted(map(tuple, exact_dedup.exact_groups(d, lambda t: F.unhex(F.lit("00")) ).collect())) == want


def test_exact_repeats_nulls_and_empty(spark):
    d = docs(spark, ["a"], [(None, "a"), (0, "a"), (None, "b")])
    rows = exact_dedup.exact_groups(d).collect()
    assert sorted((r.doc_id is None, r.keep_id, r.kept) for r in rows if r.keep_id is not None) == [(False, 0, True), (False, 0, True), (True, 0, False)]
    assert [(r.doc_id, r.kept) for r in rows if r.keep_id is None] == [(None, True)]
    assert exact_dedup.exact_groups(d.limit(0)).count() == 0
    kept = exact_dedup.keep_first(d)
    assert kept.columns == d.columns and sorted((r.doc_id is None, r.text) for r in kept.collect()) == [(False, "a"), (True, "b")]


# ---- near ----

def plain_fingerprint(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))) if w]
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps, bits=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprints_in_blocks(texts, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    for t in texts:
        assert simhash.fingerprint(None if t is None else t.encode()) == plain_fingerprint(t)


def test_near_groups(spark, texts):
    fps = [plain_fingerprint(t) for t in texts]
    want = plain_components(fps)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_groups(docs(spark, texts)).collect()}
    assert got == {i: (fps[i], want[i]) for i in range(len(texts))}


@pytest.mark.parametrize("crowd", [1 << 30, 2])
def test_links_of_planted_fingerprints(spark, crowd):
    """Chains, clouds and lone points, by pairs and through midpoints."""
    rnd = random.Random(9)
    fps = {rnd.getrandbits(64) for _ in range(30)}
    for c in list(fps)[:6]:
        for _ in range(8):
            x = c
            for _ in range(rnd.randint(1, 4)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    vertices = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.u: r.root for r in components(simhash.links(vertices, crowd)).collect()}
    want = plain_components(fps)
    groups = lambda label: sorted(sorted(i for i in range(len(fps)) if label(i) == x) for x in {label(i) for i in range(len(fps))})
    assert groups(lambda i: roots.get(signed[i], signed[i])) == groups(lambda i: want[i])


def test_near_empty_and_repeats(spark):
    d = docs(spark, ["a b c d", "a b c d"], [(0, "a b c d"), (7, None), (None, "")])
    rows = {(r.doc_id, r.component_id) for r in simhash.near_groups(d).collect()}
    assert rows == {(0, 0), (1, 0), (7, 7), (None, 7)}
    assert simhash.near_groups(d.limit(0)).count() == 0
    kept = simhash.keep_representatives(d)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {0, 7}


# ---- substrings ----

def plain_cut(texts, ids):
    words = [(t or "").encode().split() for t in texts]
    first = {}
    for i, w in zip(ids, words, strict=True):
        for s in range(len(w) - 12):
            k = tuple(w[s : s + 13])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in zip(ids, words, strict=True):
        gone = {p for s in range(len(w) - 12) if first[tuple(w[s : s + 13])] < i for p in range(s, s + 13)}
        out.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


@pytest.mark.parametrize("at_once", [1 << 20, 40])
def test_substrings(spark, texts, at_once, monkeypatch):
    monkeypatch.setattr(substring_dedup, "AT_ONCE", at_once)
    rnd = random.Random(1)
    passage = [f"p{rnd.randrange(9)}" for _ in range(60)]
    made = list(texts)
    for _ in range(25):
        a, n = rnd.randrange(45), rnd.randrange(10, 40)
        made.append(" ".join([f"q{rnd.randrange(5)}" for _ in range(rnd.randrange(8))] + passage[a : a + n] + [f"q{rnd.randrange(5)}" for _ in range(rnd.randrange(8))]))
    made += [" ".join(passage * 3), "same " * 40, "same " * 30]
    order = list(range(len(made)))
    rnd.shuffle(order)
    rows = docs(spark, []).union(spark.createDataFrame([(i, made[i], "x", 1, 2) for i in order], SCHEMA)).repartition(5)
    got = sorted((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in substring_dedup.cut_repeats(rows).collect())
    assert got == plain_cut(made, range(len(made)))


def test_substrings_under_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(30))
    d = docs(spark, [long, "short"], [(0, long), (0, "x " + long), (5, "y " + long), (None, long)])
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_removed) for r in substring_dedup.cut_repeats(d).collect())
    assert got == [((False, 0), 0), ((False, 0), 0), ((False, 0), 0), ((False, 1), 0), ((False, 5), 30), ((True, 0), 30)]
    assert substring_dedup.cut_repeats(d.limit(0)).count() == 0
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in substring_dedup.cut_repeats(d.filter("doc_id is null or doc_id > 0 or text not like 'x%'")).collect()}
    assert spans[5] == [(1, 30)]


# ---- benchmark ----

def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(texts, items):
    wins = {}
    for i, t in items:
        w = plain_words(t)
        for s in range(max(1, len(w) - 9)):
            if w:
                wins.setdefault(tuple(w[s : s + 10]), set()).add("" if i is None else str(i))
    out = {}
    for d, t in enumerate(texts):
        w, hit, found = plain_words(t), set(), set()
        for win, ids in wins.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found |= ids
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("most", [1 << 25, 700])
def test_decontaminate(spark, texts, most, monkeypatch):
    monkeypatch.setattr(decontaminate.contamination, "__defaults__", (10, most))
    items = [(1, " ".join(texts[0].split()[:14])), (2, (texts[1] or "").upper()), (2, texts[2]), (10, "one"), (11, "ONE two!"), (12, None), (13, "..."), (None, texts[6]), (14, texts[1])]
    made = [*texts, texts[0] + " " + texts[0], "É one-two ONE", "é one"]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.report(docs(spark, made), benchmark).collect()}
    want = plain_hits(made, items)
    assert got == want
    kept = decontaminate.drop_contaminated(docs(spark, made), benchmark)
    assert {r.doc_id for r in kept.collect()} == {d for d, r in want.items() if not r[-1]} and kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")


def test_decontaminate_empty_tables(spark):
    d = docs(spark, ["one two", None], [(1, "x")])
    none = spark.createDataFrame([], "item_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.contaminated) for r in decontaminate.report(d, none).collect()) == [(0, 2, False), (1, 0, False), (1, 1, False)]
    assert decontaminate.report(d.limit(0), none).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (3, 2)]
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}


@pytest.mark.parametrize("at_once", [0, 1 << 20])
def test_components_in_rounds_and_in_one_task(spark, at_once):
    rnd = random.Random(4)
    edges = [(rnd.randrange(-300, 300), rnd.randrange(-300, 300)) for _ in range(250)] + [(1000 + i * 37 % 50, 1000 + (i + 1) * 37 % 50) for i in range(49)]
    names = sorted({x for e in edges for x in e})
    least = {x: x for x in names}
    for _ in names:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    d = spark.createDataFrame([*edges, edges[0]], "u long, v long")
    got = {r.u: r.root for r in components(d, at_once=at_once).collect()}
    assert got == {x: r for x, r in least.items() if x != r}
    assert components(d.limit(0), at_once=at_once).count() == 0


def test_simhash_never_broadcasts_its_probes(spark):
    """The driver would build them whole: 33 rows for each fingerprint's segment."""
    vertices = spark.range(50).select(F.xxhash64("id").alias("fp"))
    plan = simhash.links(vertices)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
