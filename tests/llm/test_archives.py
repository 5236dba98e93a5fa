"""License scans against a plain version, WARC round trips, and the pipeline's stages."""

import gzip
import hashlib
import io
import os
import random
import re

import pytest

from covergrid.llm import exact_dedup, license_scan, quality, registry, simhash, warc
from tests.llm.test_dedup import plain_words

import corpus_pipeline


# ---- licenses ----

def plain_base(text):
    w, places = plain_words(text), []
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        places += [(s, label) for s in range(len(w) - len(p) + 1) if w[s : s + len(p)] == p]
    return len(w), len(places), min((s for s, _ in places), default=None), max((s for s, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_license_scan(spark):
    mit = re.sub(r"[\[\]]", "", license_scan.NOTICES["mit"][1])
    texts = [
        None, "", "under the MIT License", "x under the mit license under the mit license. Apache License, Version 2.0", "CC BY-NC and cc by nc by nc", "under the mit\nlicense " * 500,
        mit, mit.replace("of charge, to", "of all cost to"), " ".join(mit.split()[:8]), "the mit license under", "Licensed under CC BY-NC 4.0.", "é under the mit license", "This work is licensed under the GNU General Public License, version 3.",
    ]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(2, texts[2], "x", 1), (3, "other", "x", 1), (None, "cc by nc", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, start int")
    got = license_scan.report(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None and not (r.doc_id == 3 and r.n_words == 1):
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(texts[r.doc_id]), r
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in got if r.doc_id != 3}
    assert by[6].labels == by[7].labels == "mit" and by[6].score == 1.0 > by[7].score and by[8].labels == "" and by[9].labels == ""
    assert by[12].labels == "gpl-3" and by[None].base_labels == "cc-by-nc"
    assert license_scan.report(docs.limit(0)).count() == 0


# The words of each notice as people write it, and the licences that it grants.
WRITTEN = [
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa"),
    ("This work is licensed under the GNU General Public License, version 2.", "gpl-2"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    ("This program is free software: you can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "agpl-3"),
    ("you can redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or any later version.", "lgpl"),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.", "gpl-2"),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "gpl-3"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "isc"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "epl-2"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("Licensed under CC BY-NC-SA 4.0.", "cc-by-nc,cc-by-nc-sa"),  # the contract's phrase is in it
    ("Licensed under CC BY 4.0.", "cc-by"),
    # Changed a little: still their own label alone. Keys changed: none.
    ("This work is now licensed under the GNU General Public License, version 3.", "gpl-3"),
    ("This work is licensed under some GNU General Public License, version 3.", "gpl-3"),
    ("This work is licensed under the GNU General Public License, version 4.", ""),
    ("This work is licensed under a Creative Commons Attribution-Whatever 4.0 International License.", ""),
    ("version 3 public license general gnu the under licensed is work this", ""),
    # Two notices, one text.
    ("Released under the MIT License. This work is licensed under the GNU General Public License, version 2.", "gpl-2,mit"),
]


def test_each_notice_has_its_own_label(spark):
    texts = ["Some words before. " + t + " And some after it." for t, _ in WRITTEN]
    texts.append("pad " * 30_000 + WRITTEN[0][0] + " pad" * 30_000 + " " + WRITTEN[4][0])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.report(docs).collect()}
    assert [got[i].labels for i in range(len(WRITTEN))] == [labels for _, labels in WRITTEN]
    assert got[len(WRITTEN)].labels == "cc-by,gpl-2"
    assert all((r.score > 0) == (r.labels != "") for r in got.values())


def test_every_template_tells_itself_from_the_others():
    for label, notices in license_scan.NOTICES.items():
        for notice in notices:
            w = plain_words(re.sub(r"[\[\]]", "", notice))
            found: dict = {}
            for i, _, _, other, _ in license_scan.templates():
                for t in range(len(other) - 2):
                    for p in range(len(w) - 2):
                        if w[p : p + 3] == other[t : t + 3]:
                            found.setdefault((i, p - t), []).append(t)
            spans = license_scan.notices([(i, d, ts) for (i, d), ts in found.items()])
            assert {x for x, base, _, _ in spans if not base} == {label}


def test_chain_is_the_longest():
    rnd = random.Random(11)
    for _ in range(200):
        matches = list({(rnd.randrange(7), rnd.randrange(9)) for _ in range(rnd.randrange(1, 9))})
        subsets = (sorted(m for i, m in enumerate(matches) if k >> i & 1) for k in range(1 << len(matches)))
        best = max(len(c) for c in subsets if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(c, c[1:])))
        got = license_scan.chain(matches)
        assert len(got) == best and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:]))


# ---- WARC ----

def test_ranges_own_each_record_once():
    rnd = random.Random(1)
    payloads = [bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 5, 300, 90_000]))) for _ in range(30)]
    payloads.append(gzip.compress(b"WARC/1.1\r\n\r\n") + b"\x1f\x8b\x08" * 50)  # magic inside a payload
    data = b"".join(warc.encode_record(i, "u", p, len(p), hashlib.sha1(p).hexdigest(), None) for i, p in enumerate(payloads))
    for size in (1000, 65_536, 99_991, len(data)):
        found = [r for at in range(0, len(data), size) for r in warc.read_range(io.BytesIO(data), at, min(at + size, len(data)))]
        assert [r.http()[1] for r in found] == payloads


def test_archives_are_plain_gzip_members():
    data = warc.encode_record(1, "http://x/ %\n", b"abc", 3, hashlib.sha1(b"abc").hexdigest(), None)
    text = gzip.decompress(data + data)
    assert text.count(b"WARC/1.1\r\nWARC-Type: response") == 2 and text.endswith(b"abc\r\n\r\n") and b"http://x/%20%25%0A\r\n" in text
    with pytest.raises(ValueError, match="cut short"):
        list(warc.read_range(io.BytesIO(data[:-9]), 0, len(data)))


@pytest.mark.parametrize("split", [200, 1 << 20])
def test_round_trip(spark, split):
    big, bigger = "é" * 500, "x" * 5000
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, big), (4, "u\r\nX: y", "small"), (5, "u", "small"), (6, "u", None), (7, "", ""), (8, "u", bigger), (9, "u%41", bigger[:-1]), (3, "again", big), (None, "n", big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, length string")
    got = warc.round_trip(pages.repartition(3), split).collect()
    assert len(got) == len(rows)
    want = []
    for i, u, h in rows:
        p = (h or "").encode()
        same = [j for j, _, x in rows if j is not None and (x or "").encode() == p]
        refers = max(same) if len(p) >= 1000 and i is not None and max(same) != i else None
        want.append((i, u, None if refers else p, len(p), hashlib.sha1(p).hexdigest(), "revisit" if refers else "response", refers))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.page_id, r.url, None if r.html is None else bytes(r.html), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert warc.round_trip(pages.limit(0)).count() == 0


def foreign(kind, headers, block):
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in headers.items())
    return b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\n" + lines + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    """Several records in a member, types without a payload, HTTP without a length, folded headers, base-32 digests."""
    import base64

    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody"
    sha = base64.b32encode(hashlib.sha1(b"body").digest()).decode()
    records = [
        foreign(b"warcinfo", {"WARC-Record-ID": "<urn:uuid:1>", "Content-Type": "application/warc-fields"}, b"software: x\r\n"),
        foreign(b"request", {"WARC-Target-URI": "http://a/", "Content-Type": "application/http; msgtype=request"}, b"GET / HTTP/1.1\r\n\r\n"),
        foreign(b"response", {"WARC-Target-URI": "http://a/\r\n b", "WARC-Payload-Digest": "sha1:" + sha, "Content-Type": "application/http; msgtype=response"}, http),
        foreign(b"response", {"Content-Type": "application/http", "WARC-Payload-Digest": "md5:xyz"}, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"),
        foreign(b"revisit", {"Content-Type": "application/http", "WARC-Payload-Digest": "sha1:" + sha, "WARC-Refers-To": "<urn:uuid:9>"}, b"HTTP/1.1 200 OK\r\n\r\n"),
        foreign(b"resource", {"WARC-Target-URI": "file:x", "Content-Type": "text/plain"}, b"plain"),
        foreign(b"metadata", {}, b""),
    ]
    data = gzip.compress(b"".join(records[:3])) + b"".join(map(gzip.compress, records[3:]))
    (tmp_path / "x.warc.gz").write_bytes(data)
    archives = spark.createDataFrame([(str(tmp_path / "x.warc.gz"), len(data))], "path string, size long")
    want = [
        ("metadata", None, None, None, None), ("request", "http://a/", None, None, None), ("resource", "file:x", b"plain", 5, hashlib.sha1(b"plain").hexdigest()),
        ("response", None, b"", 0, hashlib.sha1(b"").hexdigest()), ("response", "http://a/ b", b"body", 4, hashlib.sha1(b"body").hexdigest()),
        ("revisit", None, None, None, hashlib.sha1(b"body").hexdigest()), ("warcinfo", None, None, None, None),
    ]
    for split in (100, 1 << 20):
        rows = warc.read(spark, archives.withColumn("path", warc.F.concat(warc.F.lit("file://"), "path")), split).collect()
        got = sorted(((r.record_type, r.url, None if r.html is None else bytes(r.html), r.payload_bytes, r.payload_digest) for r in rows), key=lambda r: (r[0], r[1] or ""))
        assert got == want and not any(r.page_id or r.refers_to for r in rows)
    bad = gzip.compress(records[0] + b"junk")
    with pytest.raises(ValueError, match="no WARC header"):
        list(warc.read_range(io.BytesIO(bad), 0, len(bad)))


# ---- the pipeline ----

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_stages(spark):
    from tests.llm.test_dedup import plain_hits
    from tests.llm.test_near_copies import plain_kept
    from covergrid.llm.util import staged, table

    docs = table(spark, SF, "documents")
    scores = {r.doc_id: r.predicted for r in quality.report(docs, table(spark, SF, "labels")).collect()}
    steps = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = staged(stage(spark, docs, SF), name)
        assert docs.schema.names == before.schema.names
        steps[name] = ({r.doc_id: r.text for r in before.collect()}, {r.doc_id for r in docs.collect()})
    had, kept = steps["quality"]
    assert kept == {i for i in had if scores[i]}
    had, kept = steps["exact_dedup"]
    first = {}
    for i in sorted(had):
        first.setdefault(" ".join(had[i].replace("\t", " ").split(" ")) if "\n" not in had[i] else had[i], i)
    assert kept == {r.doc_id for r in exact_dedup.exact_groups(spark.createDataFrame(list(had.items()), "doc_id long, text string")).collect() if r.kept} and len(kept) <= len(set(first.values()))
    had, kept = steps["near_dedup"]
    ids = sorted(had)
    assert kept == {ids[i] for i in plain_kept([had[i] for i in ids])}  # similarity of five-word shingles 0.8 or more
    had, kept = steps["decontaminate"]
    ids = sorted(had)
    hits = plain_hits([had[i] for i in ids], [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()])
    assert kept == {i for k, i in enumerate(ids) if not hits[k][-1]}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == kept


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert simhash.MAX_BITS == 3


def test_stages_on_awkward_rows(spark):
    """Nulls, empty texts, repeated rows and an empty table go through every stage."""
    from covergrid.llm.util import staged

    long = " ".join(f"word{i}" for i in range(400))
    rows = [(None, None, None, None, None), (None, "", "en", "a", 0), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, long, "en", "b", 9), (2, long, "en", "b", 9), (3, long + " tail", "de", None, 9), (4, "a b c", None, None, 5)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (made, made.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = docs
            docs = staged(stage(spark, docs, SF), name)
            assert docs.schema.names == before.schema.names and docs.count() <= before.count()
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert sum(r.length for r in packed.collect()) >= docs.count()
