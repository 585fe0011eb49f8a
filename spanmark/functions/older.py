"""The older dialect of the notation, and patterns that find a fragment of normalised text again in the text as it was.

The older dialect leaves alternatives as they are written, so one may be no pattern at all; each rule has its own pattern for white
space; of a single group only the last alternative takes pauses along; a group that is written like the last one is followed by no gap.
Its spans don't come from an offset map: what a rule matches in the normalised text is looked for again in the text itself, with
every character in all its spellings and skipped marks in between.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from . import codepoints as cp
from .notation import char_class


@dataclass(frozen=True)
class Older:
    """A script: what groups may hold, and how its normalised characters are spelt in texts."""

    name: str
    pauses: str
    between: str
    skipped: str
    trailing: str
    decoration: str = ""
    letters: str = ""
    vowels: str = ""
    doubling: str = ""
    long_letters: tuple[tuple[str, str], ...] = ()
    as_is: str = ""
    named: dict = field(default_factory=dict, hash=False)
    spelt: dict = field(default_factory=dict, hash=False)  # "": absent, where no vowel or doubling follows


# fixed: the marks that the older normalisation strips
_SKIPPED = "".join(map(chr, (0x6E5, 0x6E6, 0x6E2, 0x6ED, 0x6E4, 0x6E7, 0x6E8, 0x6E0, 0x6EA, 0x6EC, 0x654, 0x655, 0x640, 0x6DB, 0x6DC, 0x653)))
_TRAILING = cp.DIACRITICS + cp.SUPERSCRIPT_ALEF + cp.QURANIC_SUKOON
# fixed: the spellings of normalised characters; the first is tried first
_SPELT = {
    cp.HAMZA: (cp.HAMZA, cp.TATWEEL + cp.HAMZA_ABOVE),
    cp.ALEF: (cp.ALEF, cp.ALEF_MADDA, cp.SUPERSCRIPT_ALEF, cp.ALEF + cp.MADDAH),
    cp.SUKOON: (cp.SUKOON, cp.QURANIC_SUKOON, ""),
    cp.FATHATAN: (cp.FATHATAN, chr(0x657), cp.FATHA + cp.SMALL_MEEM),
    cp.DAMMATAN: (cp.DAMMATAN, chr(0x65E), cp.DAMMA + cp.SMALL_MEEM),
    cp.KASRATAN: (cp.KASRATAN, chr(0x656), cp.KASRA + cp.SMALL_MEEM, cp.KASRA + cp.SMALL_LOW_MEEM),
}
OLDER_UTHMANI = Older(
    "uthmani", cp.PAUSE_MARKS, _TRAILING + _SKIPPED, _SKIPPED + cp.SHADDA, _TRAILING, cp.TATWEEL,
    "".join(map(chr, [*range(0x621, 0x63B), *range(0x641, 0x64B)])), cp.VOWELS, cp.SHADDA, ((cp.WAW, cp.WAW + cp.SUKOON), (cp.YEH, cp.YEH + cp.SUKOON)),
    cp.SMALL_WAW + cp.SMALL_YEH + chr(0x6E0), {k: v for k, v in cp.NAMED_MARKS.items() if v != cp.MADDAH}, _SPELT,
)
#: Letters of the demonstration texts by what accents fold them to.
ACCENTS = {"a": "aáàâä", "e": "eéèê", "i": "iíîï", "o": "oóôö", "u": "uúùûü", "n": "nñ", "c": "cç"}
OLDER_LATIN = Older("latin", ",;", "'-", "*%", ".,", "_", spelt={k: tuple(v) for k, v in ACCENTS.items()})


def _alternatives(text: str, script: Older) -> str:
    for name, mark in script.named.items():
        text = text.replace(name, mark)
    if script.decoration:
        text = re.sub(f"{re.escape(script.decoration)}+", ".", text).replace(".]", "]")
    parts = " ".join(text.split()).translate({ord(b): None for b in "[]"}).strip().split(" ")
    if script.doubling:
        parts = [re.sub(f"([{script.letters}]){script.doubling}", rf"\1[{script.vowels}]?{script.doubling}", p) for p in parts]
    guarded = {bare for bare, sakin in script.long_letters if bare in parts and sakin in parts}
    return "|".join(f"{p}(?![{script.vowels}])" if p in guarded else p for p in parts)


def older_pattern(case: str, white: str, script: Older) -> str:
    """The regular expression of a rule in the older dialect; it may not compile."""
    groups = case.split("+")
    pauses = "|".join(map(re.escape, script.pauses))
    if len(groups) == 1:
        return f"{_alternatives(case, script)}(?:{pauses})*"
    gap = f"(?:{white}|{pauses}|{char_class(script.between)})+"
    return "".join(f"(?:{_alternatives(g, script)})" + ("" if g == groups[-1] else gap) for g in groups)


def for_text_as_it_is(case: str, script: Older) -> bool:
    """Whether a rule's groups ask for marks that normalised text doesn't have; those that may stand between groups don't count."""
    return any(c in _alternatives(group, script) for group in case.split("+") for c in script.as_is)


def _spellings(fragment: str, script: Older) -> list[list[tuple[str, str]]]:
    """A fragment piece by piece: of each piece its alternatives, as their first character ("": none) and a pattern of what follows it."""
    skip, absent = f"{char_class(script.skipped)}*", f"(?!{char_class(script.vowels + script.doubling)})" if script.vowels else ""
    pieces, at = [], 0
    while at < len(fragment):
        c = fragment[at]
        spelt = script.spelt.get(c, (c,))
        either = [(s[:1], re.escape(s[1:]) if s else absent) for s in spelt]
        if script.doubling and c in script.vowels and fragment[at + 1 : at + 2] == script.doubling:
            twice, whole = re.escape(script.doubling), "|".join(map(re.escape, spelt))
            pieces.append([(first, f"{rest}{skip}{twice}") for first, rest in either] + [(script.doubling, f"{skip}(?:{whole})")])
            at += 2
        else:
            pieces.append(either)
            at += 1
    return pieces


def _ending(fragment: str, script: Older) -> str:
    return f"(?!{char_class(script.vowels)})" if fragment[-1:] in {bare for bare, _ in script.long_letters} else ""


def _continued(pieces: list[list[tuple[str, str]]], fragment: str, script: Older) -> str:
    """The pattern of all pieces but the first's, with what may be skipped before, between and after them."""
    skip = f"{char_class(script.skipped)}*"
    return skip + "".join("(?:" + "|".join(re.escape(a) + b for a, b in p) + ")" + skip for p in pieces[1:]) + _ending(fragment, script)


def flexible(fragment: str, script: Older) -> str:
    """A pattern for a normalised fragment in the text as it was."""
    pieces = _spellings(fragment, script)
    return "(?:" + "|".join(re.escape(a) + b for a, b in pieces[0]) + ")" + _continued(pieces, fragment, script)


TOGETHER = 32  # fragments of one pattern
CROWD = 4  # fragments with one first character from which a shared pattern takes less time than theirs


class Finder:
    """Places of many fragments in texts: as re.finditer of flexible(f) for each f. Fragments that can begin with the same character share a
    pattern that consumes it, looks ahead for any of them and then for each, so a text is gone through once for all of them and stops only where
    one is found; a fragment that shares its first characters with few others has its own pattern."""

    def __init__(self, fragments: Iterable[str], script: Older) -> None:
        self.alone: dict[str, re.Pattern] = {}
        first: dict[str, dict[str, str]] = {}
        for f in sorted(set(fragments)):
            pieces = _spellings(f, script)
            if any(not a for a, _ in pieces[0]):
                self.alone[f] = re.compile(flexible(f, script))
                continue
            rest = _continued(pieces, f, script)
            for of in {a for a, _ in pieces[0]}:
                first.setdefault(of, {})[f] = "(?:" + "|".join(b for a, b in pieces[0] if a == of) + ")" + rest
        lonely = {f for of in first.values() for f in of} - {f for of in first.values() if len(of) >= CROWD for f in of}
        self.alone |= {f: re.compile(flexible(f, script)) for f in lonely}
        self.shared: list[tuple[list[str], re.Pattern]] = []
        for c, of in first.items():
            names = [f for f in of if f not in lonely]
            for k in range(0, len(names), TOGETHER):
                part = names[k : k + TOGETHER]
                any_of, each = "|".join(of[f] for f in part), "".join(f"(?=({of[f]})|)" for f in part)
                self.shared.append((part, re.compile(f"{re.escape(c)}(?={any_of}){each}")))

    def found(self, text: str, wanted: set[str]) -> dict[str, list[tuple[int, int]]]:
        """Start and end of all leftmost, non-overlapping matches of each wanted fragment, in order."""
        out: dict[str, list[tuple[int, int]]] = {f: [] for f in wanted}
        candidates: dict[str, list[tuple[int, int]]] = {}
        for names, pattern in self.shared:
            if not wanted.isdisjoint(names):
                for m in pattern.finditer(text):
                    for f, (a, z) in zip(names, m.regs[1:], strict=True):
                        if a >= 0 and f in out:
                            candidates.setdefault(f, []).append((m.start(), z))
        for f, places in candidates.items():
            free = 0
            for a, z in sorted(places):
                if a >= free:
                    out[f].append((a, z))
                    free = z
        for f, pattern in self.alone.items():
            if f in out:
                out[f] = [m.span() for m in pattern.finditer(text)]
        return out


def compiled(rules: Iterable[tuple[str, str, str]], script: Older) -> tuple[list[tuple[str, re.Pattern, bool]], list[tuple[str, str]]]:
    """Of (rule_id, case, white space): id, pattern and whether for the text as it is; and the ids whose pattern is none, with the reason."""
    good, bad = [], []
    for rule_id, case, white in rules:
        pattern = older_pattern(case, white, script)
        try:
            good.append((rule_id, re.compile(pattern), for_text_as_it_is(case, script)))
        except re.error as e:
            bad.append((rule_id, str(e)))
    return good, bad


def fragments_of(text: str, subject: str, rules: list[tuple[str, re.Pattern, bool]]) -> Iterator[tuple[str, list[str], bool]]:
    """Per rule that matches: its id, the distinct texts that it matches in the order in which they come, and whether in the text as it is."""
    for rule_id, pattern, as_is in rules:
        hits = list(dict.fromkeys(m.group() for m in pattern.finditer(text if as_is else subject)))
        if hits:
            yield rule_id, [h for h in hits if h], as_is
