"""Operator 1: benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

An item's windows are its runs of `window` words (all its words, if fewer). A window is the set of
its shingles; to be contained, all of them must occur, so one is enough to find it: its rarest in
the documents, the one-token prefix. Documents' shingles are counted first, only those that items
have; then each position of a document looks up the prefixes (broadcast in blocks of checked
size), positional and length bounds drop windows that would begin before the text or end after
it, and the words of the window are compared in full.

Null text has no words; an item without words has no window; a null item_id is written as the empty
string; repeated items count once; repeated documents are answered row by row; extra columns
are ignored; without items nothing is hit; without documents the result is empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, fewer, scratch, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3
BLOCK_BYTES = 16 << 20
WINDOWS = 1 << 15  # to a task


def words_of(text: Column) -> Column:
    """The words of a text; A-Z lower-cased, other letters as they are."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)  # lower() is then the same, and much faster
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """item_id and each of its windows, an array of words."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_of(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1))), lambda i: F.slice("w", i, window))
    return w.select("item_id", F.explode(runs).alias("window")).distinct()


def _key(hashes: Column, at: Column, k: int) -> Column:
    """The code of the k words from position `at` on (from 0); null past the end."""
    parts = [F.get(hashes, at + i) for i in range(k)]
    return F.when(parts[-1].isNotNull(), F.xxhash64(*parts))


def _positions(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """A row for each word of each document, and one past its end, with the codes of the shingles there."""
    w = docs.select("doc_id", F.xxhash64("text").alias("text_code"), words_of(F.col("text")).alias("w"))
    h = w.select("*", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    rows = h.select("doc_id", "text_code", "w", "h", F.posexplode(F.array_append("h", F.lit(None).cast("long"))).alias("pos", "own"))
    keys = [_key(F.col("h"), F.col("pos"), k) for k in sizes]
    if len(keys) == 1:
        return rows.withColumn("key", keys[0])
    past = F.col("own").isNull()  # the row past the end stays one row
    return rows.withColumn("key", F.explode(F.when(past, F.array(F.lit(None).cast("long"))).otherwise(F.filter(F.array(*keys), lambda x: x.isNotNull()))))


def find_windows(spark: SparkSession, docs: DataFrame, windows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text) against windows (wid, window): doc_id, text_code, n_words, and for each hit
    start, n, wid; besides the hits one row for each document, with null in these."""
    n = F.size("window")
    shingled = windows.select("wid", "window", F.transform("window", lambda x: F.xxhash64(x)).alias("h"), F.least(F.lit(SHINGLE), n).alias("k"))
    places = shingled.select("wid", "window", "h", "k", F.explode(F.sequence(F.lit(0), n - F.col("k"))).alias("off"))
    by_size = reduce(lambda c, k: F.when(F.col("k") == k, _key(F.col("h"), F.col("off"), k)).otherwise(c), range(1, SHINGLE + 1), F.lit(None).cast("long"))
    n_windows = windows.count()
    places = written(spark, fewer(spark, places.select("wid", "k", "off", by_size.alias("key")), n_windows, WINDOWS), "window-shingles")
    sizes = sorted(r["k"] for r in places.select("k").distinct().collect()) or [SHINGLE]  # three values at most
    wanted = written(spark, fewer(spark, places.select("key").distinct(), places.count()), "shingles")
    n_wanted = wanted.count()
    blocks = -(-8 * n_wanted // block_bytes) or 1
    part = lambda df, i: df.where(F.pmod(F.xxhash64("key", F.lit("block")), F.lit(blocks)) == i) if blocks > 1 else df
    found = [_positions(docs, sizes).select("key").join(F.broadcast(part(wanted, i)), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n")) for i in range(blocks)]
    counts = written(spark, fewer(spark, reduce(DataFrame.unionAll, found), n_wanted), "shingle-counts")
    # a window of which a shingle occurs nowhere can't occur; of the others the rarest shingle is the prefix
    rarest = places.join(counts, "key", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "off")).alias("p")).where("p.n > 0")
    prefix = written(spark, fewer(spark, rarest.join(windows, "wid").select("p.key", "p.off", "wid", "window"), n_windows, WINDOWS), "prefixes")
    total = prefix.agg(F.sum(F.octet_length(F.array_join("window", " ")) + 16 * F.size("window") + 64)).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    hits = []
    for i in range(blocks):
        rows = _positions(docs, sizes).join(F.broadcast(part(prefix, i)), "key", "left")
        start, size = F.col("pos") - F.col("off"), F.size("window")
        fits = (start >= 0) & (start + size <= F.size("w"))
        hit = fits & (F.slice("w", F.greatest(start, F.lit(0)) + 1, size) == F.col("window"))
        rows = rows.where(hit | (F.col("own").isNull() if i == 0 else F.lit(False)))
        hits.append(rows.select("doc_id", "text_code", F.size("w").alias("n_words"), start.alias("start"), size.alias("n"), "wid"))
    return reduce(DataFrame.unionAll, hits)


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Per document: doc_id, text_code, n_words, n_hit, n_items, items_sha256, contaminated, items (sorted ids)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_words = items.agg(F.sum(F.size(words_of(F.col("text").cast("string"))).cast("long"))).first()[0] or 0  # and no more windows
    of_items = written(spark, fewer(spark, item_windows(items, window), n_words, WINDOWS), "item-windows")
    windows = fewer(spark, of_items.select("window").distinct(), of_items.count(), WINDOWS)
    windows = written(spark, windows.select(F.monotonically_increasing_id().alias("wid"), "window"), "windows")
    with scratch(spark, "hits"):
        hits = written(spark, find_windows(spark, docs, windows), "hits")
    spans = F.array_sort(F.collect_set(F.when(F.col("wid").isNotNull(), F.struct("start", "n"))))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit"))

    def add(a, s):
        end = F.greatest(a["end"], s["start"] + s["n"])
        return F.struct(end.alias("end"), (a["hit"] + end - F.greatest(a["end"], F.least(s["start"], end))).alias("hit"))

    per = hits.groupBy("doc_id", "text_code").agg(F.count_if(F.col("wid").isNull()).alias("rows"), F.first("n_words").alias("n_words"), spans.alias("spans"))
    per = per.select("doc_id", "text_code", "rows", "n_words", F.aggregate("spans", zero, add)["hit"].alias("n_hit"))
    members = of_items.join(windows, "window").select("wid", "item_id")
    seen = hits.where("wid is not null").select("doc_id", "text_code", "wid").distinct().join(members, "wid").groupBy("doc_id", "text_code").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    a, b = per.alias("a"), seen.alias("b")
    out = a.join(b, F.expr("a.doc_id <=> b.doc_id and a.text_code = b.text_code"), "left")
    out = out.select("a.*", F.coalesce("b.items", F.array().cast("array<string>")).alias("items")).withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return out.select("doc_id", "text_code", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items")
