"""Passages with their spans marked, as HTML or for a terminal: in the pass that finds the spans (`annotated`), or from a table of spans by one
grouping and one join (`to_html`, `to_ansi`). Each passage is written from left to right, in time linear in its length and its number of spans.

A null text gives a null rendering; a passage without spans is its text. Spans outside the text cover what there is of them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from html import escape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmark.functions import codepoints as cp
from spanmark.functions.normalize import parts_of
from spanmark.operators.spans import LAYER, _found, first_come, layered

# fixed: colours of topics, in HTML and as the terminal's 256
COLOURS = {"tafkheem-tarqeeq": "#c2410c", "letter-relations": "#7e22ce", "noon-tanween": "#0369a1", "meem-sakinah": "#0f766e", "mushaddadatan": "#a16207", "madd": "#be123c", "qalqalah": "#15803d"}
TERMINAL = {"tafkheem-tarqeeq": 166, "letter-relations": 98, "noon-tanween": 32, "meem-sakinah": 30, "mushaddadatan": 136, "madd": 161, "qalqalah": 28}
RESET = "\x1b[0m"
DRAWN = 1 << 17  # code points that are drawn together; with an element for each span a rendering is some twenty times as long as its text
FIRST_JOINING = "\u0600"  # no letter before it is of the script that joins


def cluster_end(text: str, at: int) -> int:
    """The first offset from `at` on that doesn't part a letter from the marks stacked on it."""
    while at < len(text) and text[at] in cp.STACKED:
        at += 1
    return at


@cache
def _letter(ch: str) -> bool:
    return unicodedata.category(ch)[0] == "L" and unicodedata.name(ch, "").startswith("ARABIC ")


@cache
def _transparent(ch: str) -> bool:
    return ch == cp.ZWJ or unicodedata.category(ch) in ("Mn", "Me")


def joined(text: str, at: int) -> bool:
    """Whether the letters on both sides of an offset are written joined."""
    before, after = at - 1, at
    while before >= 0 and _transparent(text[before]):
        before -= 1
    while after < len(text) and _transparent(text[after]):
        after += 1
    if before < 0 or after == len(text):
        return False
    return _letter(text[before]) and text[before] not in cp.NOT_JOINING_ON and _letter(text[after]) and text[after] != cp.HAMZA


def cuts(text: str, layer: list[tuple[int, int, str]], pauses: str = cp.PAUSE_MARKS) -> list[tuple[int, int, str | None]]:
    """The pieces of a text, (start, end, rule or None): ends lie behind stacked marks, pause marks stand alone."""
    out, at = [], 0
    if not text or max(text) < FIRST_JOINING:  # no stacked marks and no pauses
        for start, end, rule in layer:
            end = min(len(text), end)
            if start >= at:
                out += [(at, start, None)] if start > at else []
                out += [(start, end, rule)] if start < end else []
                at = max(start, end)
        return out + ([(at, len(text), None)] if at < len(text) else [])
    for start, end, rule in layer:
        start, end = cluster_end(text, start), min(len(text), cluster_end(text, end))
        if start < at:
            continue
        if start > at:
            out.append((at, start, None))
        at = start
        for k in range(start, end):
            if text[k] >= FIRST_JOINING and text[k] in pauses:
                out += [(at, k, rule)] if at < k else []
                out.append((k, k + 1, None))
                at = k + 1
        out += [(at, end, rule)] if at < end else []
        at = max(at, end)
    return out + ([(at, len(text), None)] if at < len(text) else [])


def tag(rule: str, rules: dict[str, tuple[str, str]], colours: dict[str, str]) -> str:
    """What opens the element of a rule's spans."""
    topic, told = rules.get(rule, ("", rule))
    told = _escaped(told)
    return f'<span class="rule" data-rule="{_escaped(rule)}" data-topic="{_escaped(topic)}" style="color:{colours.get(topic, "currentColor")}" title="{told}" aria-label="{told}">'


def html(text: str, layer: list[tuple], opens: Callable) -> str:
    """One passage; opens is asked about the third of a layer's items, the rule or whatever stands for the span; joiners keep letters in one shape where a boundary falls between them."""
    parts = cuts(text, layer)
    joins = bool(text) and max(text) >= FIRST_JOINING
    out, bridge = [], ""
    for a, z, rule in parts:
        after = cp.ZWJ if joins and z < len(text) and joined(text, z) else ""
        piece = _escaped(bridge + text[a:z] + after)
        out.append(piece if rule is None else f"{opens(rule)}{piece}</span>")
        bridge = after
    return "".join(out)


def _escaped(text: str) -> str:
    return escape(text, quote=False).replace('"', "&quot;")


def ansi(text: str, layer: list[tuple[int, int, str]], rules: dict[str, tuple[str, str]], colours: dict[str, int]) -> str:
    """One passage for a terminal: no boundary is moved, no joiner added."""
    out, at = [], 0
    for start, end, rule in layer:
        if start < at:
            continue
        code = colours.get(rules.get(rule, ("", ""))[0])
        out += [text[at:start], "" if code is None else f"\x1b[38;5;{code}m", text[start:end], RESET]
        at = end
    return "".join([*out, text[at:]])


def _written(passages: DataFrame, spans: DataFrame, key: str, text: str, flatten: bool, name: str, draw: Callable) -> DataFrame:
    rows = passages.select(key, F.col(text).cast("string").alias("text of the passage")).join(layered(spans, [key]), key, "left")

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, size = b[LAYER].flatten(), b[LAYER].value_lengths().fill_null(0).to_pylist()
            start, back, rule = (flat.field(c).to_pylist() for c in ("start_at", "back", "rule_id"))
            out, at = [], 0
            for t, n in zip(b["text of the passage"].to_pylist(), size):
                layer = [(start[k], -back[k], rule[k]) for k in range(at, at + n)]
                at += n
                if flatten:
                    layer = [layer[k] for k in first_come([s[0] for s in layer], [s[1] for s in layer])]
                out.append(None if t is None else draw(t, layer))
            yield pa.RecordBatch.from_arrays([b[key], pa.array(out, pa.string())], names=[key, name])

    return rows.mapInArrow(drawn, passages.select(key).schema.add(name, "string"))


def annotated(passages: DataFrame, rules: list[tuple[str, str]], key: str = "doc_id", text: str = "text", original: frozenset[str] = frozenset(), told: dict[str, tuple[str, str]] | None = None, colours: dict[str, str] | None = None, describe: Callable[[pa.RecordBatch], pa.Array] | None = None, terminal: bool = False) -> DataFrame:
    """key, html (terminal: ansi) of passages annotated with rules: spans are found, resolved and drawn in one Arrow pass, and none leaves
    it. told: a rule's topic and description. describe: called in the workers with spans (rule_id, start_at, end_at, slice), many at once; it
    returns the text of each, a null leaves the rule's own."""
    told, name = told or {}, "ansi" if terminal else "html"
    colours = (TERMINAL if terminal else COLOURS) if colours is None else colours
    compiled = [(i, re.compile(p), i in original) for i, p in rules]
    opening = {i: tag(i, told, colours) for i, _ in rules}

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of_passage = b["text of the passage"]
            for begin, stop in parts_of(pc.fill_null(pc.utf8_length(of_passage), 0).to_pylist(), DRAWN):
                texts = of_passage.slice(begin, stop - begin).to_pylist()
                row, rule, start, end = _found(texts, compiled)
                layers: list[list[tuple]] = [[] for _ in texts]
                stay = first_come(start, end, row)
                opens = [opening[rule[k]] for k in stay]
                if describe and stay:
                    of = [pa.array([rule[k] for k in stay]), pa.array([start[k] for k in stay], pa.int64()), pa.array([end[k] for k in stay], pa.int64()), pa.array([texts[row[k]][start[k] : end[k]] for k in stay])]
                    said = describe(pa.RecordBatch.from_arrays(of, names=["rule_id", "start_at", "end_at", "slice"])).to_pylist()
                    opens = [o if t is None else tag(rule[k], {rule[k]: (told.get(rule[k], ("",))[0], t)}, colours) for k, o, t in zip(stay, opens, said, strict=True)]
                for n, k in enumerate(stay):
                    layers[row[k]].append((start[k], end[k], rule[k] if terminal else n))
                draw = (lambda t, layer: ansi(t, layer, told, colours)) if terminal else (lambda t, layer, opens=opens: html(t, layer, opens.__getitem__))
                out = [None if t is None else draw(t, layer) for t, layer in zip(texts, layers, strict=True)]
                yield pa.RecordBatch.from_arrays([b[key].slice(begin, stop - begin), pa.array(out, pa.string())], names=[key, name])

    rows = passages.select(key, F.col(text).cast("string").alias("text of the passage"))
    return rows.mapInArrow(drawn, passages.select(key).schema.add(name, "string"))


def to_html(passages: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text", rules: dict[str, tuple[str, str]] | None = None, colours: dict[str, str] | None = None, flatten: bool = True) -> DataFrame:
    """key, html. rules: a rule's topic and description. Overlapping spans are resolved first (flatten) or the first come stays."""
    rules, colours = rules or {}, COLOURS if colours is None else colours
    opens = {r: tag(r, rules, colours) for r in rules}
    return _written(passages, spans, key, text, flatten, "html", lambda t, layer: html(t, layer, lambda r: opens.get(r) or tag(r, rules, colours)))


def to_ansi(passages: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text", rules: dict[str, tuple[str, str]] | None = None, colours: dict[str, int] | None = None) -> DataFrame:
    """key, ansi: resolved spans in the terminal's colours."""
    rules, colours = rules or {}, TERMINAL if colours is None else colours
    return _written(passages, spans, key, text, True, "ansi", lambda t, layer: ansi(t, layer, rules, colours))
