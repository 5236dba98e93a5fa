"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round is two aggregations and two joins over the edges left; no vertex's neighbours are ever
gathered in one place: a vertex with very many of them costs partial aggregates, and its edges meet its
smallest neighbour by a broadcast of such vertices, of which there are few by their definition.
Each round's edges are written to the shared folder.

Every round plans queries, and what a query leaves on the driver outlives it. So edges up to AT_ONCE, which
one task holds in a few arrays, need no rounds: they are joined in that task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covergrid.llm.util import meet, staged


def _large_star(e: DataFrame, n: int) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return meet(both, least, "u", 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(e: DataFrame, n: int) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = meet(down, least, "u", 2 * n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


#: Most edges that one task joins.
AT_ONCE = 1 << 20


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of the edges, sorted, and the smallest vertex that each reaches."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = np.arange(len(names))
    a, b = ends[: len(u)], ends[len(u) :]
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # roots only ever fall, so no cycle arises
        while not np.array_equal(root, above := root[root]):
            root = above
    return names, names[root]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
    if parts:
        names, root = roots(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        below = names != root
        yield pa.RecordBatch.from_arrays([pa.array(names[below]), pa.array(root[below])], ["u", "root"])


def components(edges: DataFrame, label: str = "edges", at_once: int = AT_ONCE) -> DataFrame:
    """(u, v) pairs of longs in; (u, root) out for every vertex but the roots: root is the smallest
    vertex that u reaches. Loops and repeated edges are allowed."""
    e, seen = staged(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label), None
    n = e.count()
    if n <= at_once:
        return e.coalesce(1).mapInArrow(_joined, "u long, root long")
    while True:
        e = staged(_small_star(_large_star(e, n), n).distinct(), label)
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if (now.n, now.s) == seen:
            return e.select("u", F.col("v").alias("root"))
        seen, n = (now.n, now.s), now.n
