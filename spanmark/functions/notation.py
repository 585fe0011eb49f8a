"""The pattern notation: groups joined by "+", alternatives in a group parted by space, brackets as decoration.

A script profile says what letters, marks and pauses are; patterns come out in the dialect of Java
(Spark's own functions), Python (Arrow functions) or RE2 (SQL twins), which differ on white space,
look-behind and escapes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from . import codepoints as cp


@dataclass(frozen=True)
class Profile:
    name: str
    vowels: str = ""
    doubling: str = ""
    between: str = ""
    pauses: str = ""
    decoration: str = ""
    long_letters: tuple[tuple[str, str], ...] = ()
    named: dict = field(default_factory=dict, hash=False)
    anchors: dict = field(default_factory=dict, hash=False)


def char_class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "\\]^-[" else c for c in chars) + "]"


_WS = f"[{cp.WS}]"
_LETTER = "[ء-غف-ي]"
# fixed: the four anchors by their names in the notation
UTHMANI = Profile(
    "uthmani", cp.VOWELS, cp.SHADDA, cp.DIACRITICS + cp.SUPERSCRIPT_ALEF + cp.QURANIC_SUKOON + cp.OPTIONAL_MARKS, cp.PAUSE_MARKS, cp.TATWEEL,
    ((cp.WAW, cp.WAW + cp.SUKOON), (cp.YEH, cp.YEH + cp.SUKOON)), cp.NAMED_MARKS,
    {
        "نهاية الكلمة": f"(?={_WS}|END)",
        "بداية الكلمة": f"(?<![^{cp.WS}])",
        "نهاية الآية": f"(?=[{cp.WS}{cp.PAUSE_MARKS}]*END)",
        "غير مدغم": f"(?!{_WS}?{_LETTER}{char_class(cp.VOWELS)}?{cp.SHADDA})(?!(?<={cp.TAH}{cp.SUKOON}){cp.TEH})",
    },
)
LATIN = Profile("latin", between="'-", pauses=",;", decoration="_", anchors={"word-end": f"(?={_WS}|END)", "word-start": f"(?<![^{cp.WS}])", "passage-end": f"(?=[{cp.WS},;]*END)"})
_END = {"java": r"\z", "python": r"\Z", "re2": r"\z"}


def parse(case: str, profile: Profile) -> list[list[str]]:
    """Groups of alternatives; an anchor stands alone in its group."""
    groups = []
    for raw in case.split("+"):
        text = raw
        if (name := _bare(text)) in profile.anchors:
            groups.append([name])
            continue
        for name, mark in profile.named.items():
            text = text.replace(name, mark)
        if profile.decoration:
            text = re.sub(f"{re.escape(profile.decoration)}+", ".", text).replace(".]", "]")
        groups.append(_bare(text).split(" "))
    return groups


def _bare(text: str) -> str:
    """Without brackets, wherever they stand, and with single spaces between alternatives."""
    return " ".join(text.split()).translate({ord("["): None, ord("]"): None}).strip()


def _alternative(text: str, siblings: list[str], profile: Profile) -> str:
    wild = "[^" + cp.LINE_ENDS + "]"
    out, vowel = [], char_class(profile.vowels) if profile.vowels else ""
    for i, c in enumerate(text):
        if c == profile.doubling and i and vowel:
            out.append(vowel + "?")  # a vowel may stand before the doubling mark
        out.append(wild if c == "." else re.escape(c) if c.isascii() else c)
    guard = any(text == bare and sakin in siblings for bare, sakin in profile.long_letters)
    return "".join(out) + (f"(?!{vowel})" if guard and vowel else "")


def _separator(scope: str, profile: Profile) -> str:
    marks = char_class(profile.pauses + profile.between)
    return {"within-word": f"{marks}*", "either": f"(?:{_WS}|{marks})*", "across-words": f"(?:{_WS}+|{marks})+"}[scope]


def compile_rule(case: str, scope: str, profile: Profile = LATIN, dialect: str = "java") -> str:
    """The regular expression of a rule. A single group takes the pauses after it along."""
    groups = []
    for alternatives in parse(case, profile):
        if len(alternatives) == 1 and alternatives[0] in profile.anchors:
            groups.append(profile.anchors[alternatives[0]].replace("END", _END[dialect]))
        else:
            groups.append("(?:" + "|".join(_alternative(a, alternatives, profile) for a in alternatives) + ")")
    if len(groups) == 1:
        return groups[0] + (f"{char_class(profile.pauses)}*" if profile.pauses else "")
    return _separator(scope, profile).join(groups)


def required(case: str, profile: Profile = LATIN) -> list[frozenset[str]]:
    """What a text must hold for a rule to match: of each set one string at least. A set has, for each alternative of a group, the longest
    part of it that stands in any match as it is; a group with an alternative that has no such part asks for nothing."""
    cut = "." + profile.doubling
    out = []
    for alternatives in parse(case, profile):
        if len(alternatives) == 1 and alternatives[0] in profile.anchors:
            continue
        parts = [max(a.translate({ord(c): "\0" for c in cut}).split("\0"), key=len) for a in alternatives]
        if all(parts):
            out.append(frozenset(parts))
    return out


def bracket_fault(case: str) -> str | None:
    """"nested", "stray" or "unclosed", or None."""
    open_ = False
    for c in case:
        if c == "[":
            if open_:
                return "nested"
            open_ = True
        elif c == "]":
            if not open_:
                return "stray"
            open_ = False
    return "unclosed" if open_ else None
