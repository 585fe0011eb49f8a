"""URL filters: parsing, rules and templates."""

import math
import random

from spanmark.llm.urls import build_tree, judge

URLS = [
    (1, "https://A.Example.com/en/1?x#y", "a.example.com", "/en/1", "example.com/en/", "block"),
    (2, "http://www.example.com/en/2", "www.example.com", "/en/2", "www.example.com/en/", "allow"),
    (3, "http://x.www.example.com/en/2#", "x.www.example.com", "/en/2", "www.example.com/en/", "allow"),
    (4, "http://notexample.com/en/2", "notexample.com", "/en/2", "com/", "allow"),
    (5, "http://x.net/es/", "x.net", "/es/", "net/es/", "block"),
    (6, "http://com", "com", "", None, "allow"),
    (7, "no scheme", "", "", None, "allow"),
    (8, None, "", "", None, "allow"),
    (9, "a://b.com/c://d.net/fr/", "b.com", "/c://d.net/fr/", "com/", "allow"),
    (10, "http://x.org?q=/en/", "x.org", "", None, "allow"),
    (11, "http://x.org/" + "s/" * 3000, "x.org", "/" + "s/" * 3000, None, "allow"),
    (12, "", "", "", None, "allow"),
    (12, "http://net/fr/é\n", "net", "/fr/é\n", "net/fr/", "block"),
]


def test_rules_and_parts(spark):
    df = spark.createDataFrame([(i, u, "h", "seg") for i, u, *_ in URLS], "page_id long, url string, host string, segment string")
    got = sorted((tuple(r)[:5] for r in judge(spark, df).collect()), key=str)
    assert got == sorted(((i, h, p, r, v) for i, _, h, p, r, v in URLS), key=str)
    assert judge(spark, df.limit(0)).collect() == []


def test_templates_are_learnt_per_host(spark):
    rules = (("h.org", "/bad/1", "block"), ("h.org", "/good/1", "allow"))
    urls = [f"http://h.org/{a}/{k}" for a in ("bad", "good") for k in range(100, 140)] + [f"http://h.org/{a}/{k}" for a in ("bad", "good", "new") for k in range(20, 30)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in judge(spark, df, rules).collect():
        assert r["verdict"] == ("block" if r["path"].startswith("/bad") else "allow"), r


def plain_tree(paths, many, support, z):
    """paths: {segments: (n, labelled, blocked)}. The template of each, node by node."""
    out = {}

    def part(rows, level, template):
        out.update((r, template) for r in rows if len(r) == level)
        rows = [r for r in rows if len(r) > level]
        n, labelled, blocked = (sum(paths[r][k] for r in rows) for k in range(3))
        if len(rows) == 1:
            out[rows[0]] = template + "/" + "/".join(rows[0][level:])
        elif n < support and (labelled == 0 or labelled == n and blocked in (0, n)):
            out.update((r, template + "/**") for r in rows)
        else:
            names = sorted({r[level] for r in rows})
            sums = {c: [sum(paths[r][k] for r in rows if r[level] == c) for k in range(3)] for c in names}
            thin = {c for c in names if len(names) > many and sums[c][0] < support}
            share = {c: round(math.asin(math.sqrt((sums[c][2] + 0.5) / (sums[c][1] + 1))) * 2 / math.pi * 64) if sums[c][1] else -1 for c in names}
            group, k, lab, blo = {}, 0, 0, 0
            for s in sorted({share[c] for c in names if c not in thin}):
                a, b = (sum(sums[c][j] for c in names if c not in thin and share[c] == s) for j in (1, 2))
                if s >= 0:
                    p = (blo + b) / (lab + a)
                    if lab == 0 or abs(blo / lab - b / a) > z * math.sqrt(p * (1 - p) * (1 / lab + 1 / a)):
                        k, lab, blo = k + 1, 0, 0
                    lab, blo = lab + a, blo + b
                group[s] = k
            tokens = {}
            for c in names:
                alike = [d for d in names if d not in thin and group[share[d]] == group.get(share[c])]
                tokens[c] = "*" if c in thin or 1 < len(alike) == len(names) else c if len(alike) == 1 else f"*{group[share[c]]}"
            for token in set(tokens.values()):
                part([r for r in rows if tokens[r[level]] == token], level + 1, template + "/" + token)

    part(list(paths), 0, "")
    return out


def test_tree_equals_a_plain_one(spark):
    rng, rows, want = random.Random(3), [], {}
    for h in ("a", "b", "c", ""):
        paths = {}
        for _ in range(160):
            top = rng.choice("pqrstu") if h != "b" else f"w{rng.randrange(14)}"
            segments = (top, *(rng.choice(["x", "y", "{n}"]) for _ in range(rng.randrange(0, 6))))[: rng.randrange(0, 7)]
            labelled = rng.randrange(0, 12) if top not in "su" else 0
            paths[segments] = (labelled + rng.randrange(top != "p", 4) + (not labelled), labelled, sum(rng.random() < {"p": 0.1, "q": 0.12, "r": 0.9}.get(top, 0.5) for _ in range(labelled)))
        rows += [(h, "/".join(k), list(k), *v) for k, v in paths.items()]
        want.update({(h, "/".join(k)): t for k, t in plain_tree(paths, 8, 20, 1.96).items()})
    df = spark.createDataFrame(rows, "host string, path string, segments array<string>, n long, labelled long, blocked long")
    got = {(r["host"], r["path"]): r["template"] for r in build_tree(spark, df).collect()}
    assert got == want
    tokens = {t for path in got.values() for t in path.split("/")}  # of every kind
    assert {"*", "**", "*0", "*1", "*2", "x", "{n}"} <= tokens


def test_similar_branches_merge_and_judge_unlabelled_pages(spark):
    sections = {f"bad{c}": "block" for c in "abc"} | {f"good{c}": "allow" for c in "abc"}
    rules = tuple(("h.org", f"/{s}/1", v) for s, v in sections.items())
    urls = [f"http://h.org/{s}/{k}" for s in sections for k in [*range(100, 130), *range(20, 30)]] + ["http://h.org/new/20"] * 3
    df = spark.createDataFrame([(None if k % 7 == 0 else k, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = judge(spark, df, rules).collect()
    assert len(got) == len(urls)
    assert {(r["path"][:4], r["template"].split("/")[1]) for r in got} == {("/bad", "*2"), ("/goo", "*1"), ("/new", "new")}
    assert all(r["verdict"] == ("block" if r["path"].startswith("/bad") else "allow") for r in got)
    assert sum(r["rule"] is None and r["verdict"] == "block" for r in got) == 30
