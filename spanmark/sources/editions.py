"""Readers of editions and annotation sets, and their JSON sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PASSAGE = ("edition_id", "ref", "surah", "ayah", "text")


def _parts(ref: F.Column) -> list:
    return [F.split_part(ref, F.lit(":"), F.lit(k)).cast("int").alias(n) for k, n in ((1, "surah"), (2, "ayah"))]


def read_edition(spark: SparkSession, path: str) -> DataFrame:
    """{id, riwayah, script, ayahs: {"s:a": text}} as passages."""
    doc = spark.read.schema("id string, riwayah string, script string, ayahs map<string,string>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = doc.select(F.col("id").alias("edition_id"), F.explode("ayahs").alias("ref", "text"))
    return rows.select("edition_id", "ref", *_parts(F.col("ref")), "text")


def import_passages(spark: SparkSession, path: str, edition_id: str) -> DataFrame:
    """Any of four layouts: a flat map, a list of records (with aliases of the fields), or a map of maps. A map of which
    every value is a map is the last, else it is flat. The last of equal references wins; numbers are written anew ("01" is 1). A text that
    is no string, a reference that is no two numbers, another layout and an import without passages are errors."""
    doc = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    kind = lambda c: F.schema_of_variant(c)
    top = kind(F.col("v"))
    if not doc.where(~(top.startswith("OBJECT") | top.startswith("ARRAY"))).isEmpty():
        raise ValueError("neither a map of passages nor a list of records")
    items = doc.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("pos", "key", "value").where("pos is not null")
    flat = not items.where(F.col("key").isNotNull() & ~F.coalesce(kind(F.col("value")).startswith("OBJECT"), F.lit(False))).isEmpty()

    def field(*names: str):
        return F.coalesce(*(F.try_variant_get("value", f"$.{n}", "variant") for n in names))

    def string(c):
        return F.when(kind(c) == "STRING", F.try_variant_get(c, "$", "string"))

    number = lambda c: F.try_variant_get(c, "$", "string")
    record = items.where("key is null").select("pos", number(field("surah", "chapter", "sura", "surah_number")).alias("s"), number(field("ayah", "verse", "aya", "ayah_number")).alias("a"), string(field("text", "arabic", "ayah_text")).alias("text"))
    named = items.where("key is not null")
    if flat:
        rows = named.select("pos", F.split_part("key", F.lit(":"), F.lit(1)).alias("s"), F.split_part("key", F.lit(":"), F.lit(2)).alias("a"), string(F.col("value")).alias("text"))
    else:
        rows = named.select("pos", F.col("key").alias("s"), F.explode(F.try_variant_get("value", "$", "map<string,variant>")).alias("a", "of")).select("pos", "s", "a", string(F.col("of")).alias("text"))
    rows = record.unionByName(rows)
    of = lambda c: F.trim(c).try_cast("int")
    lost = F.raise_error(F.concat(F.lit("could not read a record at "), F.coalesce("s", F.lit("?")), F.lit(":"), F.coalesce("a", F.lit("?")))).cast("boolean")
    rows = rows.where(F.when(of(F.col("s")).isNotNull() & of(F.col("a")).isNotNull() & F.col("text").isNotNull(), F.lit(True)).otherwise(lost))
    rows = rows.select("pos", F.concat_ws(":", of(F.col("s")), of(F.col("a"))).alias("ref"), "text")
    if rows.isEmpty():
        raise ValueError("no passages in the import")
    last = rows.groupBy("ref").agg(F.max_by("text", "pos").alias("text"))
    return last.select(F.lit(edition_id).alias("edition_id"), "ref", *_parts(F.col("ref")), "text")


POSITIONS, FAN = 16, 12  # bits of a position within its block; of a block within the one above


def _carried(ends: DataFrame, bits: int) -> DataFrame:
    """Of blocks (block, latest; null: none begins there) what the last one before them with any has: block, carried.

    A prefix scan over a tree: 2**FAN neighbouring blocks look at each other through a window, the rest comes from their parents, of
    which there are fewer, and so on. No window holds more than 2**FAN rows, however many blocks there are and wherever they lie."""
    rows = ends.withColumn("parent", F.shiftright("block", FAN) if bits > FAN else F.lit(0).cast("long"))
    beside = F.last("latest", True).over(Window.partitionBy("parent").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.select("block", "parent", beside.alias("beside"))
    if bits <= FAN:
        return rows.select("block", F.col("beside").alias("carried"))
    above = ends.groupBy(F.shiftright("block", FAN).alias("block")).agg(F.max_by("latest", F.when(F.col("latest").isNotNull(), F.col("block"))).alias("latest"))
    from_above = _carried(above, bits - FAN).select(F.col("block").alias("parent"), F.col("carried").alias("above"))
    return rows.join(from_above, "parent").select("block", F.coalesce("beside", "above").alias("carried"))


def as_of(points: DataFrame, starts: DataFrame, value: str) -> DataFrame:
    """points (pos, ...) with the `value` of the last of starts (pos, value) at or before each; null before all starts. Positions are
    whole numbers of 64 bits; of starts at one place the greatest value counts. Blocks of 2**POSITIONS places are joined locally,
    what a block begins with is carried into it."""
    at = F.shiftright("pos", POSITIONS).alias("block")
    begun = starts.groupBy("pos").agg(F.max(value).alias(value)).select("pos", at, value)
    ends = begun.groupBy("block").agg(F.max_by(value, "pos").alias("latest"))
    blocks = points.select(at).distinct().join(ends, "block", "full")
    carried = _carried(blocks, 64 - POSITIONS)
    point = F.struct(*points.columns)
    rows = begun.select("pos", "block", F.lit(0).alias("kind"), value).withColumn("point", F.lit(None).cast(points.select(point.alias("p")).schema["p"].dataType))
    rows = rows.unionByName(points.select("pos", at, F.lit(1).alias("kind"), F.lit(None).cast(starts.schema[value].dataType).alias(value), point.alias("point")))
    inside = F.last(value, True).over(Window.partitionBy("block").orderBy("pos", "kind"))
    both = rows.withColumn("own", inside).where("kind = 1").join(carried, "block")
    return both.select("point.*", F.coalesce("own", "carried").alias(value))


def from_positions(words: DataFrame, starts: DataFrame, marks: DataFrame | None = None, references: int | None = None) -> DataFrame:
    """words (pos, word), starts (start, ref), marks (pos, k, side, sign): each word goes to the last start at or before
    it; words before all starts are left out. Marks are put to their word in the order of k: one with side "after" follows it, one with
    "before" precedes it, parted by a space. A mark without a sign is an error, and so is another number of starts than of `references`."""
    if references is not None and (n := starts.count()) != references:
        raise ValueError(f"{n} starts, but {references} references")
    if marks is not None:
        marks = marks.withColumn("sign", F.coalesce("sign", F.raise_error(F.lit("a mark has no sign"))))
        sign = F.when(F.col("side") == "after", F.struct("k", "sign"))
        lead = F.when(F.col("side") == "before", F.struct((-F.col("k")).alias("k"), "sign"))  # the last one put stands first
        told = marks.groupBy("pos").agg(*(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["sign"]), j).alias(n) for c, n, j in ((sign, "tail", ""), (lead, "head", " "))))
        words = words.join(told, "pos", "left").select("pos", F.concat(F.when(F.col("head") != "", F.concat("head", F.lit(" "))).otherwise(""), "word", F.coalesce("tail", F.lit(""))).alias("word"))
    both = as_of(words, starts.select(F.col("start").alias("pos"), "ref"), "ref").where("ref is not null")
    return both.groupBy("ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("text"))


def write_json_spans(spans: DataFrame, passages: DataFrame, path: str, key: str = "doc_id") -> None:
    """A line of JSON per passage with its spans in order; passages without any keep an empty list."""
    per = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start_at", "end_at", "rule_id"))).alias("spans"))
    passages.select(key).join(per, key, "left").select(key, F.coalesce("spans", F.array().cast("array<struct<start_at:bigint,end_at:bigint,rule_id:string>>")).alias("spans")).write.json(path)


def write_tsv(sliced: DataFrame, path: str, key: str = "doc_id") -> None:
    """key, start, end, rule and slice, parted by tabs."""
    sliced.select(F.concat_ws("\t", F.col(key).cast("string"), F.col("start_at").cast("string"), F.col("end_at").cast("string"), "rule_id", "slice").alias("value")).write.text(path)
