"""The older dialect, re-finding against a plain loop over fragments, and the differential."""

import random
import re

import pytest

from spanmark.functions import codepoints as cp
from spanmark.functions import older as fo
from spanmark.functions.notation import UTHMANI, compile_rule
from spanmark.operators import older
from spanmark.plans import catalogue

N, B, S, W, Y = cp.NOON, cp.BEH, cp.SUKOON, cp.WAW, cp.YEH


def plain(text, fragments, script):
    return {f: [m.span() for m in re.finditer(fo.flexible(f, script), text)] for f in fragments}


def test_finder_equals_a_plain_loop_over_documents(spark):
    """1,000 documents, the fragments of all rules."""
    docs = catalogue._docs(spark, "/root/testdata/sf0.01").collect()
    assert len(docs) == 1000
    rules, _ = fo.compiled(catalogue.OLDER_RULES, fo.OLDER_LATIN)
    fold = str.maketrans({x: k for k, v in fo.ACCENTS.items() for x in v})
    wanted = [{f for _, hits, _ in fo.fragments_of(r["text"], r["text"].translate(fold), rules) for f in hits} for r in docs]
    finder = fo.Finder(set().union(*wanted), fo.OLDER_LATIN)
    for r, of in zip(docs, wanted, strict=True):
        assert finder.found(r["text"], of) == plain(r["text"], of, fo.OLDER_LATIN)


def test_finder_equals_a_plain_loop_over_marked_texts():
    """Random marked texts and fragments of them, with pairs in both orders, absent marks, alternatives of two characters."""
    rng = random.Random(3)
    chars = [N, B, S, W, Y, cp.ALEF, cp.ALEF_MADDA, cp.SUPERSCRIPT_ALEF, cp.SHADDA, cp.FATHA, cp.KASRA, cp.DAMMATAN, cp.SMALL_MEEM, cp.SMALL_LOW_MEEM, cp.MADDAH, cp.HAMZA, cp.TATWEEL, cp.HAMZA_ABOVE, cp.QURANIC_SUKOON, " ", chr(0x65E)]
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    fragments = {"".join(rng.choice(chars) for _ in range(rng.randint(1, 4))) for _ in range(150)} | {cp.FATHA + cp.SHADDA + N, cp.DAMMATAN + cp.SHADDA, S, S + N, N + W}
    finder = fo.Finder(fragments, fo.OLDER_UTHMANI)
    assert finder.shared and finder.alone
    for t in texts:
        assert finder.found(t, fragments) == plain(t, fragments, fo.OLDER_UTHMANI)


def test_dialects_differ_as_documented():
    """A pause after the first alternative, a repeated last group, a wildcard, a guard on bare long letters, a vowel before the doubling mark."""
    script = fo.OLDER_LATIN
    assert fo.older_pattern("[th dh]", " ", script) == "th|dh(?:,|;)*"
    text = "th, dh,"
    new = [m.span() for m in re.finditer(compile_rule("[th dh]", "within-word", dialect="python"), text)]
    assert new == [(0, 3), (4, 7)] and [m.span() for m in re.finditer(fo.older_pattern("[th dh]", " ", script), text)] == [(0, 2), (4, 7)]
    assert fo.older_pattern("[a]+[a]", " ", script) == "(?:a)(?:a)" and fo.older_pattern("[a]+[b]", " ", script) == "(?:a)(?: |,|;|['\\-])+(?:b)"
    assert fo.older_pattern("[q__e]", " ", script) == "q.e(?:,|;)*"
    marked = fo.OLDER_UTHMANI
    assert f"{W}(?![" in fo.older_pattern(f"[{W} {W}{S}]", " ", marked) and "(?!" not in fo.older_pattern(f"[{W}]", " ", marked)
    assert re.search(fo.older_pattern(f"[{N}{cp.SHADDA}]", " ", marked), N + cp.FATHA + cp.SHADDA)


def test_subject_choice():
    small = cp.SMALL_WAW
    assert fo.for_text_as_it_is(f"[{N}{small}]", fo.OLDER_UTHMANI) and fo.for_text_as_it_is("[واو صغيرة]", fo.OLDER_UTHMANI)
    assert not fo.for_text_as_it_is(f"[{N}]", fo.OLDER_UTHMANI) and not fo.for_text_as_it_is(f"[{N}]+[{B}]", fo.OLDER_UTHMANI)
    assert small in fo.older_pattern(f"[{N}]+[{B}]", " ", fo.OLDER_UTHMANI)


def test_a_match_that_ends_with_a_bare_long_letter_is_not_found_again(spark):
    """The older engine reports the rule and highlights nothing, as the long letter has a vowel in the text; with another end it does."""
    text = f"م{cp.KASRA}{N}{S} {Y}{cp.FATHA}"
    df = spark.createDataFrame([(1, text), (2, f"{N}{S} م{cp.FATHA}"), (3, None)], "doc_id long, text string")
    rules = [("noon.1", f"[{N}{S}]+[{Y} م]", " ")]
    got = sorted(map(tuple, older.collected(df, rules, ["doc_id"], fo.OLDER_UTHMANI).drop("fault").collect()))
    assert got == [(1, "noon.1", 0, None, None), (2, "noon.1", 1, 0, 5)]
    short = older.collected(df, rules, ["doc_id"], fo.OLDER_UTHMANI, trailing=False).where("doc_id = 2").first()
    assert (short["start_at"], short["end_at"]) == (0, 4)


def test_marks_and_spellings_are_found_again(spark):
    """Quranic sukoon, shadda before its vowel, a small high meem for tanween, a rule on the text as it is, one that is no pattern."""
    text = f"{N}{cp.QURANIC_SUKOON} {B}{cp.SHADDA}{cp.FATHA} {B}{cp.DAMMA}{cp.SMALL_MEEM} {B}{cp.SMALL_WAW}"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rules = [("a.1", f"[{N}{S}]+[{B}]", r"\s"), ("b.1", f"[{cp.DAMMATAN}]", " "), ("c.1", f"[{B}{cp.SMALL_WAW}]", " "), ("d.1", "[(]", " "), ("e.1", f"[{B}{cp.FATHA}{cp.SHADDA}]", " ")]
    got = older.collected(df, rules, ["doc_id"], fo.OLDER_UTHMANI).collect()
    assert [r["rule_id"] for r in got if r["fault"]] == ["d.1"] and all(r["doc_id"] is None for r in got if r["fault"])
    of = {r["rule_id"]: text[r["start_at"] : r["end_at"]] for r in got if not r["fault"]}
    assert of == {"a.1": text[0:6], "b.1": text[8:10], "c.1": text[11:13], "e.1": text[3:6]}


def test_order_and_repeats(spark):
    """Fragments come in the order of their first match, each once; two fragments can find the same place."""
    df = spark.createDataFrame([(1, "é e éb")], "doc_id long, text string").selectExpr("doc_id", "text", "translate(text, 'é', 'e') folded")
    rows = older.collected(df, [("a.1", "[eb e]", " ")], ["doc_id"], fo.OLDER_LATIN, subject="folded").collect()
    assert [(r["nth"], r["start_at"], r["end_at"]) for r in rows] == [(1, 0, 1), (2, 2, 3), (3, 4, 5), (4, 4, 6)]


def test_bytes_become_code_points_or_fail(spark):
    docs = spark.createDataFrame([(1, "aéb")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, "r", 1, 3), (1, "r", 3, 4)], "doc_id long, rule_id string, start_at long, end_at long")
    assert sorted((r["start_at"], r["end_at"]) for r in older.from_bytes(spans, docs, ["doc_id"]).collect()) == [(1, 2), (2, 3)]
    off = spark.createDataFrame([(1, "r", 1, 2)], spans.schema)
    with pytest.raises(Exception, match="character's boundary"):
        older.from_bytes(off, docs, ["doc_id"]).collect()
    with pytest.raises(Exception, match="character's boundary"):
        older.from_bytes(spark.createDataFrame([(1, "r", 1, 9)], spans.schema), docs, ["doc_id"]).collect()


def test_their_side_drives(spark):
    schema = "doc_id long, rule_id string, start_at long, end_at long"
    ours = spark.createDataFrame([(1, "a", 0, 1), (1, "a", 2, 3), (2, "a", 0, 1), (2, "a", 0, 1), (3, "b", 0, 1)], schema)
    theirs = spark.createDataFrame([(1, "a", 0, 1), (1, "a", 5, 6), (1, "a", 5, 6)], schema)
    assert [tuple(r) for r in older.driven(ours, theirs).collect()] == [("a", 1, 1, 1)]


def test_comparable_has_three_filters(spark):
    ids = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "rule_id string, their_id long")
    one = lambda n: spark.createDataFrame([(n,)], "their_id long")
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "rule_id string")
    assert [tuple(r) for r in older.comparable(ids, one(2), one(3), known).collect()] == [("a", 1)]
