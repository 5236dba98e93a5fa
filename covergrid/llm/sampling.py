"""Bounded samples of labelled rows, the same on every run: the rows whose id hashes lowest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lowest(rows: DataFrame, n: int, salt: str) -> DataFrame:
    """At most n rows of (doc_id, ...): those with the smallest salted hash of the id."""
    h = F.xxhash64(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return rows.orderBy(h, "doc_id").limit(n)


def labelled(labels: DataFrame, column: str, train: Column) -> DataFrame:
    """(doc_id, y): one row a document of the training folds that labels mark with 0 or 1; a document
    that is marked both ways counts as 1; null ids and null marks are left out."""
    rows = labels.select("doc_id", F.col(column).alias("y")).filter(train & F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"))


def with_text(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """The picked rows (a bounded number) with their documents' texts, as binary."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(picked), "doc_id")
