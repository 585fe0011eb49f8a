"""A rule corpus as DataFrames: topics, categories, rulings and rules, their lineage and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmark.functions import codepoints as cp
from spanmark.functions.notation import LATIN, Profile, compile_rule

RULE = "id string, ruling string, pattern_case string, scope string, subject string, status string, gap string, reason string, needs_review boolean, label map<string,string>, disputed struct<finding:string,raised_by:string,occurrences:array<string>,resolved_by:string>, corrections array<struct<field:string,was:string,reason:string>>"
# A demonstration corpus of Latin letters, so that every table can be annotated. (id, ruling, case, scope, status, gap)
DEMO_RULES = [
    ("th.1", "th", "[t d] + [h]", "within-word", "stable", None), ("th.2", "th", "[th dh]", "within-word", "disputed", None),
    ("nasal.1", "nasal", "[n m] + [b p]", "either", "stable", None), ("nasal.2", "nasal", "[n] + [b m]", "across-words", "stable", None),
    ("pair.1", "pair", "[s] + [t st]", "across-words", "stable", None), ("pair.2", "pair", "[ll rr tt]", "within-word", "stable", None),
    ("vowel.1", "vowel", "[ea ou]", "within-word", "stable", None), ("vowel.2", "vowel", "[a e] + [i]", "either", "disputed", None),
    ("wild.1", "wild", "[q_e]", "within-word", "stable", None), ("pause.1", "pause", "[ng nd]", "within-word", "stable", None),
    ("rare.1", "rare", "[zzz]", "within-word", "stable", None), ("off.1", "off", "prose that is no pattern", "within-word", "disabled", "not-a-pattern"),
    ("off.2", "off", "[x] + [y]", "either", "disabled", "lookahead"),
]
DEMO_RULINGS = [("th", "joined", None), ("nasal", "joined", "north"), ("pair", "doubled", None), ("vowel", "open", "south"), ("wild", "open", None), ("pause", "joined", None), ("rare", "doubled", None), ("off", "doubled", None)]
DEMO_CATEGORIES = [("joined", "letters"), ("doubled", "letters"), ("open", "sounds")]


def demo(spark: SparkSession) -> dict[str, DataFrame]:
    """The demonstration corpus: rules, rulings, categories."""
    rules = [(i, r, c, s, "normalized", st, g, g and f"because of {g}", st == "disputed", {"en": i}, ("made for the demonstration", "nobody", ["1"], None) if st == "disputed" else None, None) for i, r, c, s, st, g in DEMO_RULES]
    return {
        "rules": spark.createDataFrame(rules, RULE),
        "rulings": spark.createDataFrame(DEMO_RULINGS, "id string, category string, school string"),
        "categories": spark.createDataFrame(DEMO_CATEGORIES, "id string, topic string"),
    }


# A demonstration corpus of marked text, for what normalisation is there for; shadda and fatha stand in this order in a text as it is only.
MARKED_RULES = [
    ("sakin.1", "sakin", f"[{cp.NOON}{cp.SUKOON}] + [{cp.BEH} {cp.MEEM}]", "either", "normalized"), ("sakin.2", "sakin", f"[{cp.LAM}{cp.SUKOON} {cp.REH}{cp.SUKOON}]", "within-word", "normalized"),
    ("twofold.1", "twofold", f"{cp.BEH}{cp.SHADDA}", "within-word", "normalized"), ("twofold.2", "twofold", f"[{cp.SHADDA}{cp.FATHA}]", "within-word", "original"),
    ("drawn.1", "drawn", f"[{cp.DAMMA}{cp.WAW} {cp.KASRA}{cp.YEH}]", "within-word", "normalized"), ("drawn.2", "drawn", f"[{cp.WAW} {cp.WAW}{cp.SUKOON}]", "within-word", "normalized"),
]
MARKED_RULINGS = [("sakin", "marks", None), ("twofold", "marks", None), ("drawn", "length", None)]
MARKED_CATEGORIES = [("marks", "letters"), ("length", "sounds")]


def marked(spark: SparkSession) -> dict[str, DataFrame]:
    """The same for marked text, in the profile UTHMANI."""
    rules = [(i, r, c, s, on, "stable", None, None, False, {"en": i}, None, None) for i, r, c, s, on in MARKED_RULES]
    return {
        "rules": spark.createDataFrame(rules, RULE),
        "rulings": spark.createDataFrame(MARKED_RULINGS, "id string, category string, school string"),
        "categories": spark.createDataFrame(MARKED_CATEGORIES, "id string, topic string"),
    }


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A corpus document of JSON (version, topics, categories, hukums, rules) as the same tables."""
    label = "map<string,string>"
    schema = f"version string, riwayah string, topics array<struct<id string,label {label}>>, categories array<struct<id string,topic string,label {label},empty boolean>>, hukums array<struct<id string,category string,label {label},school struct<id string,scholar string>>>, rules array<struct<id string,hukum string,`case` string,scope string,matchAgainst string,status string,gap string,statusReason string,needsReview boolean,corrections array<struct<field string,was string,reason string>>,label {label},notes {label},startFrom string,disputed struct<finding string,raised_by string,occurrences array<string>,resolved_by string>>>"
    doc = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    r = doc.select(F.explode("rules").alias("r")).select("r.*")
    return {
        "meta": doc.select("version", "riwayah"),
        "topics": doc.select(F.inline("topics")),
        "categories": doc.select(F.inline("categories")),
        "rulings": doc.select(F.explode("hukums").alias("h")).select("h.id", "h.category", "h.label", F.col("h.school.id").alias("school")),
        "rules": r.select("id", F.col("hukum").alias("ruling"), F.col("case").alias("pattern_case"), "scope", F.coalesce("matchAgainst", F.lit("normalized")).alias("subject"), "status", "gap", F.col("statusReason").alias("reason"), F.coalesce("needsReview", F.lit(False)).alias("needs_review"), "label", "corrections", "disputed"),
    }


def lineage(corpus: dict[str, DataFrame], how: str = "strict") -> DataFrame:
    """rule_id, ruling_id, category_id, topic_id, school, status. Dimensions are small and left to the planner.
    A rule whose ruling, or whose ruling's category, is missing is an error ("strict"), is left out ("inner") or has
    nulls ("left")."""
    rules = corpus["rules"].select(F.col("id").alias("rule_id"), F.col("ruling").alias("ruling_id"), "status")
    rulings = corpus["rulings"].select(F.col("id").alias("ruling_id"), F.col("category").alias("category_id"), "school", F.lit(True).alias("has ruling"))
    categories = corpus["categories"].select(F.col("id").alias("category_id"), F.col("topic").alias("topic_id"), F.lit(True).alias("has category"))
    kind = "inner" if how == "inner" else "left"
    joined = rules.join(rulings, "ruling_id", kind).join(categories, "category_id", kind)
    out = joined.select("rule_id", "ruling_id", "category_id", "topic_id", "school", "status")
    if how != "strict":
        return out
    lost = F.concat(F.lit("rule "), F.col("rule_id"), F.lit(": no ruling "), F.col("ruling_id"), F.lit(" or no category of it"))
    known = F.when(F.col("has ruling").isNotNull() & F.col("has category").isNotNull(), F.lit(True)).otherwise(F.raise_error(lost).cast("boolean"))
    return joined.where(known).select(*out.columns)  # a filter, which no later choice of columns prunes


def stable(lines: DataFrame) -> DataFrame:
    """Only settled rules: neither disputed nor disabled ones."""
    return lines.where("status = 'stable'")


def chosen_topics(lines: DataFrame, topics: list[str]) -> DataFrame:
    """Rules of the topics that are switched on; with none on there is no rule (in `selected`, an empty list is no filter)."""
    return lines.where(F.col("topic_id").isin(topics)) if topics else lines.where(F.lit(False))


def review_mark(rules: DataFrame) -> DataFrame:
    """id and mark: x for a disabled rule, ! for a disputed one, ? for one that awaits review, else blank."""
    mark = F.when(F.col("status") == "disabled", "x").when(F.col("status") == "disputed", "!").when(F.col("needs_review"), "?").otherwise(" ")
    return rules.select("id", mark.alias("mark"))


def standing(rules: DataFrame) -> DataFrame:
    """One row: all rules, disabled, disputed and those that await review; the last overlap with the others."""
    return rules.agg(F.count(F.lit(1)).alias("rules"), F.count_if(F.col("status") == "disabled").alias("disabled"), F.count_if(F.col("status") == "disputed").alias("disputed"), F.count_if(F.col("needs_review")).alias("in_review"))


def found_or_fail(rows: DataFrame, message: str) -> DataFrame:
    """rows, or a LookupError at once where there is none; for tables as small as a corpus."""
    if rows.isEmpty():
        raise LookupError(message)
    return rows


def labels_of(corpus: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """ids (id) with their label: that of a rule, else of a ruling, a category, a topic. An unknown id has none."""
    kinds = ["rules", "rulings", "categories", "topics"]
    told = [corpus[k].select("id", "label", F.lit(n).alias("rank")) for n, k in enumerate(kinds) if k in corpus and "label" in corpus[k].columns]
    first = reduce(DataFrame.union, told).groupBy("id").agg(F.min_by("label", "rank").alias("label"))
    return ids.join(first, "id", "left")


def explained(corpus: dict[str, DataFrame], rule_id: str) -> DataFrame:
    """Everything known of one rule as one row; an unknown rule is an error."""
    one = corpus["rules"].where(F.col("id") == rule_id)
    lines = lineage(corpus, "left").where(F.col("rule_id") == rule_id).select(F.col("rule_id").alias("id"), "category_id", "topic_id", "school")
    told = one.join(lines, "id").select("id", "topic_id", "category_id", F.col("ruling").alias("ruling_id"), "school", "pattern_case", "scope", "subject", "status", "gap", "reason", "needs_review")
    return found_or_fail(told, f"no rule {rule_id}")


def matches(passages: DataFrame, rules: list[tuple[str, str]], rule_ids: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and, for each of rule_ids, whether the rule (in the Java dialect) matches anywhere; an unknown rule never does."""
    known = dict(rules)
    return passages.select(key, *((F.coalesce(F.col(text).rlike(known[r]), F.lit(False)) if r in known else F.lit(False)).alias(r.replace(".", "_")) for r in rule_ids))


def selected(lines: DataFrame, only: list[str] | None = None, school: str | None = None, include_disabled: bool = False) -> DataFrame:
    """Rules to run: no disabled ones unless asked for, those under any id of `only`, those of a school or of none."""
    if not include_disabled:
        lines = lines.where("status <> 'disabled'")
    if only:
        lines = lines.where(F.arrays_overlap(F.array("rule_id", "ruling_id", "category_id", "topic_id"), F.array(*map(F.lit, only))))
    if school is not None:
        lines = lines.where(F.col("school").isNull() | (F.col("school") == school))
    return lines


def patterns(corpus: dict[str, DataFrame], lines: DataFrame, profile: Profile = LATIN, dialect: str = "python") -> list[tuple[str, str]]:
    """(rule_id, pattern), compiled on the driver: rules are a few hundred."""
    rows = corpus["rules"].join(lines.select(F.col("rule_id").alias("id")), "id").select("id", "pattern_case", "scope").collect()
    return sorted((r["id"], compile_rule(r["pattern_case"], r["scope"], profile, dialect)) for r in rows)


def originals(corpus: dict[str, DataFrame]) -> frozenset[str]:
    """Ids of the rules that are written against the text as it is."""
    return frozenset(r["id"] for r in corpus["rules"].where("subject = 'original'").select("id").collect())


def search(rules: DataFrame, query: str) -> DataFrame:
    """Rules whose id or ruling contains the query in any case, or whose label has it as it is; none is an error."""
    q = query.lower()
    in_label = F.exists(F.map_values("label"), lambda v: v.contains(query))
    return found_or_fail(rules.where(F.lower("id").contains(q) | F.lower("ruling").contains(q) | F.coalesce(in_label, F.lit(False))), f"no rule has {query}")


def gaps(rules: DataFrame) -> DataFrame:
    """Disabled rules by gap, large groups first: how many, the first one's reason, their ids."""
    told = rules.where("status = 'disabled'").groupBy("gap").agg(F.count(F.lit(1)).alias("n"), F.min_by("reason", "id").alias("reason"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    return told.orderBy(F.desc("n"), "gap")
