"""Spans: every rule over every passage, as half-open code-point ranges, and what is made of them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmark.functions.normalize import in_parts, is_touched, normalized_batch
from spanmark.operators import digests


SPANS_AT_ONCE = 100_000


class Gate:
    """Which rules can match a text at all, from what they require of it: single characters by the text's set of them, longer strings by one run
    of an Aho-Corasick automaton over those of all rules. For many rules on short passages, most of which hold few of them."""

    def __init__(self, needs: dict[str, list[frozenset[str]]]) -> None:
        self.needs = needs
        longer = {s for sets in needs.values() for of in sets for s in of if len(s) > 1}
        self.automaton = ahocorasick.Automaton()
        for s in longer:
            self.automaton.add_word(s, s)
        if longer:
            self.automaton.make_automaton()

    def open(self, text: str) -> set[str]:
        there = set(text)
        if len(self.automaton):
            there.update(s for _, s in self.automaton.iter(text))
        return {rule for rule, sets in self.needs.items() if not any(there.isdisjoint(of) for of in sets)}


def _found(texts: list[str | None], compiled: list[tuple[str, re.Pattern, bool]]) -> tuple[list[int], list[str], list[int], list[int]]:
    """Index of the text, rule, start and end of all spans, in order; compiled: rule, pattern, whether for the text as it is."""
    touched = [k for k, t in enumerate(texts) if t and is_touched(t)] if not all(as_is for *_, as_is in compiled) else []
    changed = dict(zip(touched, normalized_batch([texts[k] for k in touched]))) if touched else {}
    row, rule, start, end = [], [], [], []
    for k, raw in enumerate(texts):
        raw = raw or ""
        norm, source = changed.get(k, (raw, None))
        places = None if source is None else np.append(source, len(raw)).tolist()
        found = []
        for rule_id, pattern, as_is in compiled:
            if as_is or places is None:
                found += [(m.start(), -m.end(), rule_id) for m in pattern.finditer(raw)]
            else:
                for m in pattern.finditer(norm):
                    a = places[m.start()]
                    found.append((a, -max(a, places[m.end()]), rule_id))
        found.sort()
        row += [k] * len(found)
        for a, z, i in found:
            rule.append(i), start.append(a), end.append(-z)
    return row, rule, start, end


def analyzed(passages: DataFrame, rules: list[tuple[str, str]], keys: list[str], text: str = "text", original: frozenset[str] = frozenset(), slices: bool = False, layer: bool = False, kept: bool = False) -> DataFrame:
    """keys, rule_id, start_at, end_at of all leftmost, non-overlapping matches in the normalised text, as ranges of
    the text itself; rules in `original` are matched on the text as it is. A passage's spans stand by start, longer
    first, then rule. slices: with the text that each covers; layer: only those that begin at or after the end of the
    last one kept; kept: all, and whether they would be. One Arrow pass, no shuffle; a passage is read and normalised once for all rules."""
    compiled = [(i, re.compile(p), i in original) for i, p in rules]
    names = [*keys, "rule_id", "start_at", "end_at", *["slice"] * slices, *["kept"] * kept]

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["subject of rules"].to_pylist()
            for begin, stop in in_parts(texts):
                row, rule, start, end = _found(texts[begin:stop], compiled)
                stay = first_come(start, end, row) if layer or kept else []
                if kept:
                    stays = np.zeros(len(row), bool)
                    stays[stay] = True
                if layer:
                    row, rule, start, end = ([x[k] for k in stay] for x in (row, rule, start, end))
                for k in range(0, len(row), SPANS_AT_ONCE):
                    part = slice(k, k + SPANS_AT_ONCE)
                    of = [b[c].take(pa.array([begin + r for r in row[part]], pa.int64())) for c in keys]
                    more = [pa.array(stays[part])] if kept else []
                    cut = [pa.array([texts[begin + r][a:z] for r, a, z in zip(row[part], start[part], end[part])], pa.string())] if slices else []
                    yield pa.RecordBatch.from_arrays([*of, pa.array(rule[part], pa.string()), pa.array(start[part], pa.int64()), pa.array(end[part], pa.int64()), *cut, *more], names=names)

    rows = passages.select(*keys, F.col(text).alias("subject of rules"))
    schema = passages.select(*keys).schema.add("rule_id", "string").add("start_at", "long").add("end_at", "long")
    schema = schema.add("slice", "string") if slices else schema
    return rows.mapInArrow(spans, schema.add("kept", "boolean") if kept else schema)


def _numbers(texts: list[str | None], compiled: list[tuple[str, re.Pattern, bool]], gate: Gate | None = None) -> np.ndarray:
    """How many matches each rule has in each text: a row a text. Equal texts are matched once, rules that a gate rules out not at all."""
    place: dict[str, int] = {}
    which = [place.setdefault(t or "", len(place)) for t in texts]
    once = list(place)
    touched = [k for k, t in enumerate(once) if is_touched(t)] if not all(as_is for *_, as_is in compiled) else []
    subjects = list(once)
    for k, (norm, _) in zip(touched, normalized_batch([once[k] for k in touched]) if touched else [], strict=True):
        subjects[k] = norm
    n = np.zeros((len(once), len(compiled)), np.int64)
    for k, (raw, norm) in enumerate(zip(once, subjects, strict=True)):
        ours, theirs = (gate.open(norm), gate.open(raw) if raw is not norm else None) if gate else (None, None)
        for j, (i, p, as_is) in enumerate(compiled):
            if gate is None or i in (theirs if as_is and theirs is not None else ours):
                n[k, j] = sum(1 for _ in p.finditer(raw if as_is else norm))
    return n.reshape(len(once), len(compiled))[which]


def counted(passages: DataFrame, rules: list[tuple[str, str]], keys: list[str], text: str = "text", original: frozenset[str] = frozenset(), other: str | None = None, needs: dict[str, list[frozenset[str]]] | None = None) -> DataFrame:
    """keys, rule_id, n: how many spans `analyzed` would give for each passage and rule, where there are any. other: a second text of the
    passage; then n and n_other, and a row where either is over 0. Only counts leave the Arrow pass, and texts that are equal within a
    batch (both texts of an unchanged passage among them) are normalised and matched once. needs: what rules require of a text, as from
    notation.required; a rule without an entry there is then left out."""
    compiled = [(i, re.compile(p), i in original) for i, p in rules]
    ids, columns = np.array([i for i, _ in rules], object), [c for c in (text, other) if c]
    counts = ["n", "n_other"][: len(columns)]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate = Gate(needs) if needs is not None else None
        for b in batches:
            sides = [b[f"subject {k}"].to_pylist() for k in range(len(columns))]
            for begin, stop in in_parts(sides[0]):
                n = _numbers([t for side in sides for t in side[begin:stop]], compiled, gate).reshape(len(sides), stop - begin, len(ids))
                row, rule = np.nonzero(n.any(axis=0))
                kept = [b[c].take(pa.array(begin + row)) for c in keys]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(ids[rule], pa.string()), *(pa.array(side[row, rule]) for side in n)], names=[*keys, "rule_id", *counts])

    schema = passages.select(*keys).schema.add("rule_id", "string")
    for c in counts:
        schema = schema.add(c, "long")
    return passages.select(*keys, *(F.col(c).alias(f"subject {k}") for k, c in enumerate(columns))).mapInArrow(told, schema)


def analyzed_once(passages: DataFrame, rules: list[tuple[str, str]], keys: list[str], text: str = "text", original: frozenset[str] = frozenset()) -> DataFrame:
    """As analyzed, for tables with many copies: each distinct text is normalised and matched once, its spans are joined back to all passages
    that have it by the text's digest. Costs a shuffle of the distinct texts; a text's copies can be a large part of the rows, since the
    join only multiplies what the result holds anyway."""
    coded = passages.where(F.col(text).isNotNull()).select(*keys, F.sha2(F.col(text).cast("binary"), 256).alias("digest of the text"), F.col(text).alias("the text"))
    once = coded.groupBy("digest of the text").agg(F.first("the text").alias("the text"))
    found = analyzed(once, rules, ["digest of the text"], "the text", original)
    return coded.drop("the text").join(found, "digest of the text").select(*keys, "rule_id", "start_at", "end_at")


def find_spans(passages: DataFrame, rules: list[tuple[str, str]], keys: list[str], subject: str = "text") -> DataFrame:
    """keys, rule_id, start_at, end_at of all leftmost, non-overlapping matches in a column as it is."""
    return analyzed(passages, rules, keys, subject, frozenset(i for i, _ in rules))


def byte_offsets(text: str) -> np.ndarray:
    """Where each code point begins in UTF-8, and the size of all."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.r_[0, np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))]


def codepoint_offsets(text: str, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code-point offset of each byte offset, and whether it has none, being off a character's boundary."""
    begins = np.r_[(np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80, True]
    near = np.clip(offsets, 0, len(begins) - 1)
    return (np.cumsum(begins) - 1)[near], (near != offsets) | ~begins[near]


def byte_ends(passages: DataFrame, rules: list[tuple[str, str]], keys: list[str], text: str = "text", original: frozenset[str] = frozenset()) -> DataFrame:
    """keys, byte, at for each place where a span of `analyzed` begins or ends: its byte offset in UTF-8, each once in
    a passage and in order, and the code-point offset that this byte offset is converted to. One Arrow pass; a passage
    is read once for all of its offsets."""
    compiled = [(i, re.compile(p), i in original) for i, p in rules]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["subject of rules"].to_pylist()
            for begin, stop in in_parts(texts):
                row, _, start, end = _found(texts[begin:stop], compiled)
                first = np.searchsorted(row, np.arange(stop - begin + 1))
                count, byte, at, off = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, bool)]
                for k, (x, z) in enumerate(zip(first[:-1], first[1:])):
                    places = np.union1d(start[x:z], end[x:z]).astype(np.int64)
                    count.append(len(places))
                    if len(places):
                        byte.append(byte_offsets(texts[begin + k])[places])
                        for out, found in zip((at, off), codepoint_offsets(texts[begin + k], byte[-1])):
                            out.append(found)
                rows = pa.array(np.repeat(np.arange(begin, stop), count), pa.int64())
                yield pa.RecordBatch.from_arrays([*(b[c].take(rows) for c in keys), pa.array(np.concatenate(byte), pa.int64()), pa.array(np.concatenate(at), pa.int64(), mask=np.concatenate(off))], names=[*keys, "byte", "at"])

    schema = passages.select(*keys).schema.add("byte", "long").add("at", "long")
    return passages.select(*keys, F.col(text).alias("subject of rules")).mapInArrow(told, schema)


def find_spans_native(passages: DataFrame, rules: list[tuple[str, str]], keys: list[str], subject: str = "text") -> DataFrame:
    """The same in Spark's own functions, for a few literal patterns of the Java dialect: matches are fenced with
    control characters (a text that holds one is an error), and places are running sums of the pieces between."""
    clear = F.when(F.col(subject).rlike("[\x01\x02]"), F.raise_error(F.lit("a text holds the control characters that fence matches"))).otherwise(F.col(subject))
    marked = F.array(*(F.struct(F.lit(i).alias("rule_id"), F.regexp_replace(clear, p, "\x01$0\x02").alias("m")) for i, p in rules))
    rows = passages.select(*keys, F.explode(marked).alias("r")).select(*keys, "r.rule_id", F.split("r.m", "\x01").alias("pieces"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,z:int>>").alias("spans"))

    def add(acc: Column, piece: Column) -> Column:
        size = F.instr(piece, "\x02") - 1
        one = F.array(F.struct(acc["at"].alias("a"), (acc["at"] + size).alias("z")))
        return F.struct((acc["at"] + F.length(piece) - F.when(size >= 0, 1).otherwise(0)).alias("at"), F.when(size >= 0, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    return rows.select(*keys, "rule_id", F.explode(F.aggregate("pieces", zero, add)["spans"]).alias("s")).select(*keys, "rule_id", F.col("s.a").cast("long").alias("start_at"), F.col("s.z").cast("long").alias("end_at"))


def sliced(spans: DataFrame, passages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Spans with the text they cover."""
    return spans.join(passages.select(*keys, text), keys).withColumn("slice", F.expr(f"substring({text}, cast(start_at + 1 as int), cast(end_at - start_at as int))")).drop(text)


LAYER = "spans of the passage"


def layered(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Per passage its spans by start, longer first, then rule, as one array (back: the end, negated)."""
    return spans.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start_at", (-F.col("end_at")).alias("back"), "rule_id"))).alias(LAYER))


def first_come(start: list[int], end: list[int], passage: list[int] | None = None) -> list[int]:
    """Which of the spans, in order, begin at or after the end of the last one of their passage that stayed."""
    kept, free, last = [], -1, None
    for k, a in enumerate(start):
        if passage is not None and passage[k] != last:
            free, last = -1, passage[k]
        if a >= free:
            kept.append(k)
            free = end[k]
    return kept


def resolve(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The greedy layer: by start, longer first, then rule; a span stays if it begins at or after the last kept end.
    A passage's spans are one group; what is kept depends on what was kept, so no window function can say it. One
    shuffle, then one walk over each passage's sorted spans."""

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            layer = b[LAYER]
            flat, size = layer.flatten(), layer.value_lengths().fill_null(0).to_pylist()
            start = flat.field("start_at").to_pylist()
            end = [-z for z in flat.field("back").to_pylist()]
            row, kept, at = [], [], 0
            for k, n in enumerate(size):
                stay = first_come(start[at : at + n], end[at : at + n])
                row += [k] * len(stay)
                kept += [at + i for i in stay]
                at += n
            columns = [b[c].take(pa.array(row, pa.int64())) for c in keys]
            yield pa.RecordBatch.from_arrays([*columns, flat.field("rule_id").take(pa.array(kept, pa.int64())), pa.array([start[k] for k in kept], pa.int64()), pa.array([end[k] for k in kept], pa.int64())], names=[*keys, "rule_id", "start_at", "end_at"])

    schema = spans.select(*keys).schema.add("rule_id", "string").add("start_at", "long").add("end_at", "long")
    return layered(spans, keys).mapInArrow(walked, schema)


def incidence(spans: DataFrame, lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per rule of lines, the ones without a span included: passages and occurrences."""
    return incidence_of(spans.groupBy("rule_id", key).agg(F.count(F.lit(1)).alias("n")), lines, key)


def incidence_of(counts: DataFrame, lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same from the counts of `counted`."""
    told = counts.groupBy("rule_id", key).agg(F.sum("n").alias("n")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("passages"), F.sum("n").alias("occurrences"))
    return lines.join(told, "rule_id", "left").select("rule_id", "topic_id", F.coalesce("passages", F.lit(0)).alias("passages"), F.coalesce("occurrences", F.lit(0)).alias("occurrences"))


def _short(found: DataFrame, lines: DataFrame | None) -> DataFrame:
    """Rules of `lines` without spans have the digest of the empty list."""
    short = F.substring("digest", 1, 16).alias("digest")
    if lines is None:
        return found.select("rule_id", short)
    none = F.sha2(F.lit(""), 256)
    return lines.select("rule_id").join(found, "rule_id", "left").withColumn("digest", F.coalesce("digest", none)).select("rule_id", short)


def ordered_digest(spans: DataFrame, key: str = "doc_id", lines: DataFrame | None = None) -> DataFrame:
    """Per rule, 16 hex digits of the SHA-256 of its passages' keys in numeric order, joined by commas."""
    found = digests.flat(spans.select("rule_id", key).distinct(), ["rule_id"], [key], F.col(key), ",")
    return _short(found, lines)


def block_digest(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same over the digests of blocks of keys; another value."""
    found = digests.by_block(spans.select("rule_id", key).distinct(), "rule_id", key, [key], F.col(key), ",")
    return found.select("rule_id", F.substring("digest", 1, 16).alias("digest"))


def packed(spans: DataFrame, rule_ids: list[str], keys: list[str]) -> DataFrame:
    """Per passage its spans as [start, end, index in rule_ids], in order; passages without spans are absent. A rule outside rule_ids is an error."""
    at = F.array_position(F.array(*map(F.lit, rule_ids)), F.col("rule_id"))
    index = F.when(at > 0, at - 1).otherwise(F.raise_error(F.concat(F.lit("the dictionary has no rule "), F.coalesce("rule_id", F.lit("null")))))
    return spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.array(F.col("start_at"), F.col("end_at"), index))).alias("spans"))


def unpacked(packs: DataFrame, rule_ids: list[str], keys: list[str]) -> DataFrame:
    """The inverse of packed; an index outside rule_ids is an error."""
    rows = packs.select(*keys, F.explode("spans").alias("s"))
    rule = F.get(F.array(*map(F.lit, rule_ids)), F.col("s")[2].cast("int"))
    return rows.select(*keys, F.coalesce(rule, F.raise_error(F.lit("a span's rule index is not in the dictionary"))).alias("rule_id"), F.col("s")[0].alias("start_at"), F.col("s")[1].alias("end_at"))
