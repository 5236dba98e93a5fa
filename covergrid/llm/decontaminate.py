"""Benchmark decontamination: a prefix-filtered containment join, in DataFrame functions only.

An item is its windows: 10 consecutive words each, or the whole item where it has fewer. A window's
tokens are its two-word shingles, ordered by how rare they are in the whole corpus. Containment must
be complete, so the necessary prefix is one token: the rarest. Documents join those prefix tokens;
the token's offset inside the window and the window's length bound where the window can lie; the
words there are then compared one by one with the window's.

The prefix tokens are broadcast in blocks of at most BROADCAST_BYTES. The words of a document ride
along its exploded positions by reference, so nothing but verified occurrences is ever shuffled.

Defined results: null texts and null items have no words, no windows, no hits; a null item id counts
as the empty string; rows that repeat an item id add their windows to it; rows that repeat a doc_id
are told apart by their text; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covergrid.llm.util import BROADCAST_BYTES, alnum_words

WINDOW_WORDS = 10


def item_windows(items: DataFrame, width: int = WINDOW_WORDS) -> DataFrame:
    """window (its words), len and the sorted ids of the items that have it; one row a distinct window."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), alnum_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return (
        words.select("item", "w", F.explode(starts).alias("s"))
        .select("item", F.slice("w", F.col("s"), F.lit(width)).alias("window"))
        .groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))
        .withColumn("len", F.size("window"))
    )


def _tokens(docs: DataFrame, unit: int) -> DataFrame:
    """Every position of every document with the hash of the ``unit`` words that start there."""
    # The outer form, as for the inner one Spark would split each text twice: once to see whether it has words.
    at = docs.select("doc_id", "rk", "words", F.posexplode_outer("words").alias("pos", "word")).filter("word is not null")
    parts = [F.col("word")] + [F.get("words", F.col("pos") + i) for i in range(1, unit)]
    return at.select("doc_id", "rk", "words", "pos", F.xxhash64(*parts).alias("token"))


def _window_tokens(windows: DataFrame, unit: int) -> DataFrame:
    """Each window with each of its tokens and the token's offset."""
    at = windows.select("window", "items", "len", F.explode(F.sequence(F.lit(0), F.col("len") - unit)).alias("off"))
    return at.select("*", F.xxhash64(*(F.get("window", F.col("off") + i) for i in range(unit))).alias("token"))


def occurrences(docs: DataFrame, windows: DataFrame, unit: int) -> DataFrame:
    """Verified places (doc_id, rk, start, len, items) of windows that have ``unit`` words or more."""
    per_window = _window_tokens(windows, unit)
    vocabulary = per_window.select("token").distinct()
    frequency = _tokens(docs, unit).join(F.broadcast(vocabulary), "token").groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    rarity = F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "token", "off")
    prefix = (
        per_window.join(frequency, "token", "left")
        .groupBy("window", "items", "len").agg(F.min(rarity).alias("rarest"))
        .filter("rarest.freq > 0")  # a token that the corpus lacks: the window can't occur
        .select("window", "items", "len", "rarest.off", "rarest.token")
    )
    start = F.col("pos") - F.col("off")
    return (
        _tokens(docs, unit).join(F.broadcast(prefix), "token")
        .filter((start >= 0) & (start + F.col("len") <= F.size("words")))
        .filter(F.slice("words", start + 1, F.col("len")) == F.col("window"))
        .select("doc_id", "rk", start.alias("start"), "len", "items")
    )


def _blocks(windows: DataFrame, most: int) -> list[DataFrame]:
    """The windows in blocks whose prefix tables hold at most ``most`` bytes."""
    size = F.octet_length(F.concat_ws(" ", "window")) + F.octet_length(F.concat_ws(",", "items")) + 24 * F.col("len") + 96
    total = windows.agg(F.sum(size.cast("long")).alias("n")).first()["n"] or 0
    n = -(-total // most)
    if n <= 1:
        return [windows] * n
    return [windows.filter(F.pmod(F.xxhash64("window"), F.lit(n)) == i) for i in range(n)]


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW_WORDS, most: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, rk (a hash of the text), n_hit, n_items, items (sorted ids): documents with a hit only."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("rk"), alnum_words(F.col("text")).alias("words"))
    found = None
    for block in _blocks(item_windows(items, width), most):
        for unit, part in ((2, block.filter("len >= 2")), (1, block.filter("len = 1"))):
            if unit == 2 or not part.isEmpty():
                more = occurrences(keyed, part, unit)
                found = more if found is None else found.union(more)
    if found is None:
        found = keyed.select("doc_id", "rk", F.lit(0).alias("start"), F.lit(0).alias("len"), F.array(F.lit("")).alias("items")).limit(0)
    # Words covered: each place adds what lies beyond the places that start before it.
    before = Window.partitionBy("doc_id", "rk").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))))
    return (
        found.withColumn("fresh", fresh).groupBy("doc_id", "rk")
        .agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        .select("doc_id", "rk", F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items")
    )


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for every document, clean ones too."""
    hits = contamination(docs, items).withColumnsRenamed({"doc_id": "hit_id", "rk": "hit_rk"})
    every = docs.select("doc_id", F.xxhash64("text").alias("rk"), F.size(alnum_words(F.col("text"))).cast("long").alias("n_words"))
    joined = every.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("rk") == F.col("hit_rk")), "left")
    return joined.select(
        "doc_id", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that no window of the benchmark hits, all columns kept."""
    hits = contamination(docs, items).select(F.col("doc_id").alias("__hit_id"), F.col("rk").alias("__hit_rk"))
    match = F.col("doc_id").eqNullSafe(F.col("__hit_id")) & (F.xxhash64("text") == F.col("__hit_rk"))
    return docs.join(hits, match, "left_anti")
