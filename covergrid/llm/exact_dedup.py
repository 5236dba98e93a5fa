"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes.

Grouping takes (hash, address, text): Spark's aggregation compares the text's bytes whenever hash
and address agree, so two texts that collide stay two groups. The partial aggregation collapses
copies inside each map task; a group with a third of all rows reaches the reducer as one row a task.
Groups of more than one row are written; a document finds its own by hash and address without moving its
text again, in a join whose large partitions Spark can split. A document that finds none is alone.

Defined results: a null text counts as empty; texts are compared after each run of ASCII white space
became one space; null ids come last, so a group keeps a null id only if it has no other; rows that
repeat an id within a group share that id's decision (``keep_first`` returns one of them, the smallest by
its other columns, maps and variants as JSON); an empty table gives an empty result; other columns are never
read by ``exact_groups``; texts are hashed and compared whole, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covergrid.llm.util import SPACE, staged


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space. Replacing single characters is much faster than the
    pattern, which only texts with runs then pass through."""
    plain = F.coalesce(text, F.lit(""))
    for c in "\t\n\v\f\r":
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    return F.when(F.contains(plain, F.lit("  ")), F.regexp_replace(plain, SPACE, " ")).otherwise(plain)


def content_hash(text: Column) -> Column:
    """128 bits, as 16 bytes."""
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, hash_of=content_hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text)."""
    text = docs.select("doc_id", normalised(F.col("text")).alias("t"))
    keyed = text.select("doc_id", hash_of(F.col("t")).alias("h"), F.unhex(F.sha2("t", 256)).alias("a"), "t")
    by_bytes = keyed.groupBy("h", "a", "t").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    groups = by_bytes.groupBy("h", "a").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("texts")).filter("group_size > 1")
    # Two texts under one hash and one address could not be told apart below: stop rather than merge them.
    groups = groups.select(
        F.col("h").alias("gh"), F.col("a").alias("ga"), "keep_id",
        F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("texts collide in hash and address")).cast("long")).alias("group_size"),
    )
    groups = staged(groups, "copies")
    own = F.col("group_size").isNull()
    keep = F.when(own, F.col("doc_id")).otherwise(F.col("keep_id"))
    return (
        keyed.select("doc_id", "h", "a").join(groups, (F.col("h") == F.col("gh")) & (F.col("a") == F.col("ga")), "left")
        .select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("a")).alias("text_sha256"))
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One whole row of docs for each distinct text: that with the smallest doc_id, all columns kept."""
    def sortable(f) -> Column:
        c = F.col(f"`{f.name}`")
        return F.to_json(F.struct(c.alias("v"))) if any(k in f.dataType.simpleString() for k in ("map<", "variant")) else c

    others = [sortable(f) for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    order = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("y"), *(c.alias(f"z{i}") for i, c in enumerate(others)), F.col("text").alias("w"))
    text = normalised(F.col("text"))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), order.alias("order"), content_hash(text).alias("h"), text.alias("t"))
    return keyed.groupBy("h", "t").agg(F.min_by("row", "order").alias("row")).select("row.*")
