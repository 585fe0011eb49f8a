"""Decontamination against brute force; the two classifiers on odd inputs."""

import hashlib
import re
import zlib

import numpy as np

from spanmark.llm.decontaminate import decontaminate
from spanmark.llm.language import predict_languages
from spanmark.llm.quality import boost, classify

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if c < "\x80" else c for c in t or ""))


def test_decontamination_equals_brute_force(spark):
    items = [(1, " ".join(f"w{k}" for k in range(14))), (2, "Short, item"), (3, "one"), (4, None), (5, "..."), (6, " ".join(f"W{k}" for k in range(4, 20))), (2, "Short, item"), (7, "É a b c d e f g h i j")]
    texts = [None, "", "!!", "one", "w1 w2 " + items[0][1] + " end", "a short ITEM here", " ".join(f"w{k}" for k in range(3, 12)), " ".join(f"w{k}" for k in range(3, 13)) + ".", "é a b c d e f g h i", "É a b c d e f g h i", "one " * 5000, items[0][1]]
    rows = list(enumerate(texts)) + [(4, texts[4]), (None, texts[5]), (11, texts[11])]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, window string, wid int")
    bench = spark.createDataFrame(items, "item_id int, text string")
    want = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for i, x in items:
            x = words(x)
            for win in {tuple(x[k : k + 10]) for k in range(max(1, len(x) - 9))} - {()}:
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k : k + len(win)]) == win:
                        hit.update(range(k, k + len(win)))
                        found.add(str(i))
        want.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = [tuple(r) for r in decontaminate(spark, docs, bench).select(*names).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[5] for r in want) >= 8
    assert not any(r["contaminated"] for r in decontaminate(spark, docs, bench.limit(0)).collect())
    assert decontaminate(spark, docs.limit(0), bench).collect() == []


def test_decontamination_writes_few_files(spark, monkeypatch):
    """With 211 shuffle partitions that nothing merges, tables of a few windows are a file each."""
    from spanmark.llm import common, decontaminate as d

    files, own = {}, common.written
    monkeypatch.setattr(d, "written", lambda s, df, name, *a: files.setdefault(name, own(s, df, name, *a)))
    settings = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        items = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(40)], "item_id int, text string")
        docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(5, 25))) for i in range(40)], "doc_id long, text string")
        got = decontaminate(spark, docs, items)
        assert {tuple(r) for r in got.select("n_words", "n_hit", "n_items").collect()} == {(20, 20, 1)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    written = {name: len(files[name].inputFiles()) for name in ("item-windows", "windows", "window-shingles", "shingles", "shingle-counts", "prefixes")}
    assert set(written.values()) == {1}, written


def test_language_on_odd_rows(spark):
    rows = [(i, f"the house and {i} of the river walks" if i % 2 else f"la maison et {i} de la rivière où", "en" if i % 2 else "fr") for i in range(200)]
    rows += [(300, None, "en"), (301, "", None), (302, "123 !!", "en"), (304, "\u00bd \u00b2 \u2460", "en"), (5, "the house and 5 of the river walks", "en"), (None, "the river and the house", "fr"), (303, "the house " * 200_000, None)]
    df = spark.createDataFrame([(d, t, lang, "s") for d, t, lang in rows], "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in predict_languages(spark, df).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "fr") for i in range(200))
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (300, 301, 302, 304)] == [("und", 0.0)] * 4
    assert got[None]["lang_pred"] == got[303]["lang_pred"] == "en" and not got[None]["held_out"]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(200))
    assert predict_languages(spark, df.limit(0)).collect() == []


def test_quality_on_odd_rows(spark):
    rows = [(i, f"Plain words number {i} stand here. And more of them." if i % 2 else f"BUY### NOW$$$ {i}%%% ***") for i in range(400)] + [(500, None), (501, ""), (None, "Plain words."), (3, "x" * 300_000)]
    df = spark.createDataFrame([(d, t, 5.0) for d, t in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)] + [(None, 1, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    got = classify(spark, df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] != 3)
    assert {r["score"] for r in classify(spark, df, labels.limit(0)).collect()} == {0.5}
    assert classify(spark, df.limit(0), labels).collect() == []


def test_boosting_learns_an_interaction():
    x = np.random.default_rng(0).random((3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    assert ((boost(x, y).score(x) > 0.5) == y).mean() > 0.97
