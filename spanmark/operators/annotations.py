"""Annotation sets: the spans of an edition with the rules they index and the digest of the text they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmark.operators import corpus as co
from spanmark.operators import editions, spans


def refuse_other(corpus: dict[str, DataFrame], riwayah: str | None) -> None:
    """An edition of another riwayah than the corpus's is an error."""
    own = corpus["meta"].first()["riwayah"]
    if own != riwayah:
        raise ValueError(f"the corpus is {own}, the edition {riwayah}")


def write(spark: SparkSession, path: str, passages: DataFrame, found: DataFrame, rule_ids: list[str], corpus: dict[str, DataFrame], edition: str, riwayah: str, ref: str = "ref", text: str = "text") -> None:
    """Two tables below path: spans (ref, spans as [start, end, index], passages without any left out) and meta, one
    row with the corpus's version, the edition's digest and count of passages, and the ids that spans index."""
    refuse_other(corpus, riwayah)
    spans.packed(found, rule_ids, [ref]).write.parquet(f"{path}/spans")
    told = editions.digest(passages.withColumn("edition_id", F.lit(edition)), "edition_id", ref, text)
    meta = told.crossJoin(F.broadcast(corpus["meta"].select(F.col("version").alias("corpus_version"), "riwayah")))  # one row each
    meta.withColumn("rule_ids", F.array(*map(F.lit, rule_ids))).write.parquet(f"{path}/meta")


def read(spark: SparkSession, path: str, corpus: dict[str, DataFrame], ref: str = "ref") -> DataFrame:
    """The spans of a written set with their lineage. A set of another riwayah, an index outside its rules and a rule
    that the corpus hasn't are errors that name both versions."""
    meta = spark.read.parquet(f"{path}/meta").first()
    refuse_other(corpus, meta["riwayah"])
    rows = spans.unpacked(spark.read.parquet(f"{path}/spans"), list(meta["rule_ids"]), [ref])
    lines = F.broadcast(co.lineage(corpus, "inner").select("rule_id", "ruling_id", "category_id", "topic_id", F.lit(True).alias("known")))
    version = corpus["meta"].first()["version"]
    lost = F.concat(F.lit("no rule "), F.col("rule_id"), F.lit(f" in corpus {version}; the set was made with {meta['corpus_version']}"))
    both = rows.join(lines, "rule_id", "left")
    return both.select(ref, F.when(F.col("known"), F.col("rule_id")).otherwise(F.raise_error(lost)).alias("rule_id"), "ruling_id", "category_id", "topic_id", "start_at", "end_at")


def verify(spark: SparkSession, path: str, passages: DataFrame, ref: str = "ref", text: str = "text") -> None:
    """A text whose digest isn't the set's is an error that carries both."""
    meta = spark.read.parquet(f"{path}/meta").first()
    now = editions.digest(passages.withColumn("edition_id", F.lit(meta["edition_id"])), "edition_id", ref, text).first()
    if now is None or now["digest"] != meta["digest"]:
        raise ValueError(f"the text's digest is {now and now['digest']}, the set's {meta['digest']}")


def references(found: DataFrame, passages: DataFrame, ref: str = "ref") -> DataFrame:
    """ref, annotated: which passages have spans; a ref of surah:ayah is ordered by its numbers."""
    have = found.select(ref).distinct().withColumn("annotated", F.lit(True))
    told = passages.select(ref).join(have, ref, "left").select(ref, F.coalesce("annotated", F.lit(False)).alias("annotated"))
    return told.orderBy(F.transform(F.split(F.col(ref).cast("string"), ":"), lambda x: x.try_cast("bigint")), ref)


def totals(found: DataFrame, passages: DataFrame, ref: str = "ref") -> DataFrame:
    """One row: passages, those with spans, and spans."""
    per = found.groupBy(ref).agg(F.count(F.lit(1)).alias("spans"))
    rows = passages.select(ref).join(per, ref, "left")
    return rows.agg(F.count(F.lit(1)).alias("passages"), F.count("spans").alias("annotated"), F.coalesce(F.sum("spans"), F.lit(0)).cast("long").alias("spans"))


def summary(found: DataFrame, lines: DataFrame, key: str = "doc_id", name: str = "ruling_id") -> DataFrame:
    """Per passage with spans: how many, of how many rulings, and the names of the rulings whose spans show, in the order in which they are
    first seen. found: spans with `kept`, as from spans.analyzed. A passage's rulings are combined before the shuffle, so its spans aren't moved."""
    of = found.join(lines.select("rule_id", "ruling_id", F.col(name).alias("name of it")), "rule_id")
    seen = F.min(F.when(F.col("kept"), F.struct("start_at", (-F.col("end_at")).alias("back"), "rule_id")))
    per = of.groupBy(key, "ruling_id").agg(F.count(F.lit(1)).alias("n"), seen.alias("first"), F.first("name of it").alias("name of it"))
    shown = F.array_sort(F.collect_list(F.when(F.col("first").isNotNull(), F.struct("first", "name of it"))))
    return per.groupBy(key).agg(F.sum("n").alias("spans"), F.count(F.lit(1)).alias("rulings"), F.transform(shown, lambda x: x["name of it"]).alias("seen"))


def asked(passages: DataFrame, refs: list[str], ref: str = "ref") -> DataFrame:
    """The passages of refs, in the order given; one that isn't there is an error."""
    wanted = passages.sparkSession.createDataFrame(list(enumerate(refs)), f"nth long, {ref} string")
    rows = wanted.join(passages.withColumn("there", F.lit(True)), ref, "left")
    known = F.when(F.col("there"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no passage "), F.col(ref))).cast("boolean"))
    return rows.where(known).select("nth", ref, *(c for c in passages.columns if c != ref)).orderBy("nth")


def inline(spark: SparkSession, text: str) -> DataFrame:
    """One passage that has no edition: ref "-"."""
    return spark.createDataFrame([("-", text.strip())], "ref string, text string")


def ayahs(passages: DataFrame) -> DataFrame:
    """Per surah its ayah numbers in order."""
    return passages.groupBy("surah").agg(F.array_sort(F.collect_set("ayah")).alias("ayahs"))
