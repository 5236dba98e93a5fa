"""SimHash near-dedup by multi-index hashing.

1. A document's fingerprint: one bit for each of 64 positions, set where over half of its shingles'
   hashes have it set (Arrow batches, numpy; a text is taken in blocks of shingles, never whole).
2. Equal fingerprints become one vertex, named by its smallest doc_id (partial aggregation).
3. Index: a fingerprint has two segments of 32 bits. Fingerprints at 3 or fewer differing bits have a
   segment with at most one differing bit, so each segment is stored once and probed with itself and
   with the values one raised bit away (the pair's other member has that bit lowered).
4. Matches are verified over all 64 bits and linked; components by hooking to the smallest neighbour
   and shortcutting, in one task or in rounds written to the shared folder (see components).

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other;
a document of one or two words has one shingle, all its words; rows that repeat an id or a text
share a component; null ids come last and name a component only if it has no other id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covergrid.llm.components import components
from covergrid.llm.util import meet, staged

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
#: Shingles hashed at a time: bounds the memory that one long text takes.
BLOCK = 1 << 15


def fingerprint(text: bytes | None, width: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a UTF-8 text. bytes.lower and bytes.split know ASCII alone."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    total, ones = len(words) - width + 1, np.zeros(64, np.int64)
    for at in range(0, total, BLOCK):
        part = words[at : min(at + BLOCK, total) + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(_batches, f"doc_id {kind}, fp long")


#: More fingerprints than this under one segment value are linked through midpoints instead of in pairs.
CROWD = 1024
_BITS = [0] + [1 << i for i in range(32)]
#: Everything within two bits of zero, as signed longs.
_TWO = [0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i in range(64) for j in range(i)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _segments(vertices: DataFrame) -> DataFrame:
    """(fp, seg, val): both segments of every fingerprint."""
    parts = F.array(*(F.struct(F.lit(i).alias("seg"), F.shiftrightunsigned("fp", 32 * i).bitwiseAND(0xFFFFFFFF).alias("val")) for i in (0, 1)))
    return vertices.select("fp", F.inline(parts))


def _through_midpoints(members: DataFrame) -> DataFrame:
    """Links that connect whatever lies within MAX_BITS of each other among members, in proportion to
    their number: two such fingerprints have a midpoint within one bit of one of them and two of the
    other, and all that reach a midpoint link to the smallest one that is within one bit of it."""
    ball = F.array(*(F.lit(_signed(x)) for x in _TWO))
    reach = members.select("fp", F.explode(ball).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("mid"), (F.bit_count("x") <= 1).alias("near"))
    hubs = reach.filter("near").groupBy("mid").agg(F.min("fp").alias("hub"))
    return reach.join(hubs, "mid").filter("fp <> hub").select(F.col("fp").alias("u"), F.col("hub").alias("v"))


def links(vertices: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(u, v) pairs of different fingerprints at MAX_BITS bits or fewer; enough of them to connect all such."""
    stored = _segments(vertices)
    raised = F.array(*(F.lit(b).cast("long") for b in _BITS))
    probes = (
        stored.select(F.col("fp").alias("u"), "seg", "val", F.explode(raised).alias("bit"))
        .filter(F.col("val").bitwiseAND(F.col("bit")) == 0)
        .select("u", "seg", F.col("val").bitwiseOR(F.col("bit")).alias("val"), (F.col("bit") == 0).alias("same"))
    )
    crowded = stored.groupBy("seg", "val").count().filter(F.col("count") > crowd).select("seg", "val")
    through = None
    if not crowded.isEmpty():
        members = stored.join(crowded, ["seg", "val"], "left_semi").select("fp").union(probes.join(crowded, ["seg", "val"], "left_semi").select("u")).distinct()
        through = _through_midpoints(members)
        stored = stored.join(crowded, ["seg", "val"], "left_anti")
    apart = F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    found = (
        probes.hint("merge").join(stored.withColumnRenamed("fp", "v"), ["seg", "val"])  # estimates take probes, 33 rows from one, for small enough to broadcast
        .filter((~F.col("same") | (F.col("u") < F.col("v"))) & (F.col("u") != F.col("v")) & (apart <= MAX_BITS))
        .select("u", "v")
    )
    return found if through is None else found.union(through)


def near_groups(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, fp, component_id for every row of docs (doc_id, text)."""
    fps = staged(fingerprints(docs), "simhash")
    vertices = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "vertices")
    roots = components(links(vertices, crowd), "links").withColumnsRenamed({"u": "fp"})
    rooted = staged(vertices.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = meet(rooted, names, "root", rooted.count()).select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs that name their group, all columns kept; rows that repeat an id are one document."""
    kept = near_groups(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept_id")), "left_semi")
