"""Base figures against plain regular expressions; the classifier on held-out labels."""

import random
import re

from barline.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = {}
    for k in range(len(w) - 2):
        count[tuple(w[k : k + 3])] = count.get(tuple(w[k : k + 3]), 0) + 1
    hit = {k + j for k in range(len(w) - 2) if count[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_base_figures():
    r = random.Random(4)
    cases = [None, "", " \n\x0b", "a b c a b c", "é ü é ü", "x\n\nx\n x\nx \n", "a " * 1000, "***|<a>\x1f b\x1c"]
    cases += ["".join(r.choice(["ab ", "c\n", "é ", "$ ", " ", "d e f "]) for _ in range(r.randint(1, 200))) for _ in range(60)]
    for text in cases:
        assert q.base_stats((text or "").encode()) == plain(text), repr(text)[:80]


def test_cut():
    assert q.cut([(1, 0, 5), (2, 0, 1), (10, 4, 0)], 1.0, 10) == 6.5
    assert q.cut([(1, 3, 0)], 1.0, 10) is None
    assert q.cut([(1, 0, 50), (2, 1, 0), (3, 0, 50), (9, 9, 0)], 1.0, 10) == 6.5


def test_verdicts_on_held_out(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    known = labels.where("doc_id % 2 = 0")
    got = q.score(docs, known).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed").select("quality", "kept").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert sum(good) >= 0.98 * len(good)
    assert sum(bad) <= 0.2 * len(bad)


def test_edges(spark):
    long = "word " * 30000
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (2, "", 0), (None, "a b", 0), (3, long, 1)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (3, 0), (3, 1)], "doc_id long, quality int")
    rows = q.score(df, labels).collect()
    assert sorted((str(r.doc_id), r.n_words, r.kept) for r in rows) == [("1", 0, False), ("2", 0, False), ("2", 0, False), ("3", 30000, False), ("None", 2, False)]
    assert q.score(df.limit(0), labels).count() == 0
    fine = " ".join(f"w{k}" for k in range(60))
    assert [r.kept for r in q.score(spark.createDataFrame([(1, fine)], "doc_id long, text string"), labels.limit(0)).collect()] == [True]


def test_copies_and_ties(spark, monkeypatch):
    r = random.Random(8)
    text = lambda: " ".join(f"{r.choice('abcdef')}{r.randint(0, 400)}" for _ in range(80))
    good, bad, other = text(), text(), text()
    rows = [(1, good), (2, good), (None, good), (3, good), (4, bad), (5, other), (6, other), (1, other), (7, "ab"), (8, "ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 0), (7, 1)], "doc_id long, quality int")
    got = q.score(docs, labels).join(docs.distinct(), "doc_id", "left").collect()
    assert len(q.score(docs, labels).collect()) == len(rows)
    scores = {(r.doc_id, round(r.score, 12), r.kept) for r in got if r.doc_id in (2, 3)} | {(0, round(r.score, 12), r.kept) for r in got if r.doc_id is None}
    assert len({s[1:] for s in scores}) == 1
    assert len({round(r.score, 12) for r in got if r.doc_id in (5, 6)}) == 1
    at = next(r.score for r in got if r.doc_id == 2)
    monkeypatch.setattr(q, "cut", lambda *a: at)
    assert all(r.kept == (r.score >= at) for r in q.score(docs, labels).where("NOT base_failed").collect())
    assert next(r.kept for r in q.score(docs, labels).where("doc_id = 2").collect())
