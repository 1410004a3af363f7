"""Brute force over a small fixture: every window against every document."""

import hashlib
import random
import re

from barline.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        windows.setdefault(item, set()).update(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1)) if w)
    out = []
    for doc, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for item, ws in windows.items():
            for x in ws:
                for k in range(len(w) - len(x) + 1):
                    if tuple(w[k : k + len(x)]) == x:
                        hit |= set(range(k, k + len(x)))
                        found.add(str(item))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def fixture():
    r = random.Random(3)
    word = lambda: r.choice(["the", "of", "An", "été", "x1", "über", "big", "cat", "it's", "z"])
    text = lambda n: " ".join(word() + r.choice(["", "", ",", ".\n", " "]) for _ in range(n))
    items = [(k, text(r.choice([3, 9, 10, 14, 25]))) for k in range(12)] + [(100, ""), (101, None), (102, "the of"), (11, "repeat " * 30)]
    docs = []
    for k in range(60):
        t = text(r.randint(0, 80))
        if k % 3 == 0:
            t += " " + (r.choice(items)[1] or "").upper() + " " + text(5)
        docs.append((k, t))
    docs += [(60, None), (61, ""), (62, "repeat " * 50), (5, docs[5][1]), (63, "the OF. " * 4000), (None, "the of")]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = fixture()
    df = spark.createDataFrame([(a, b, "q", 1) for a, b in docs], "doc_id long, text string, item_id string, term int").repartition(3)
    tests = spark.createDataFrame([(a, b, 5) for a, b in items], "item_id long, text string, doc_id int")
    want = brute(docs, items)
    assert sum(x[5] for x in want) > 15
    index = d.build_index(df)
    for block_words in (500_000, 40):  # 40: several blocks, merged
        got = d.report(d.matches(df, tests, block_words=block_words)).drop("n_near_items").collect()
        assert sorted(map(tuple, got), key=str) == want
        got = d.matches(df, tests, block_words=block_words, reported=True, index=index).drop("n_near_items").collect()
        assert sorted(map(tuple, got), key=str) == want


def test_proximity_and_empty(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "gamma x x beta x alpha"), (2, "alpha " + "x " * 40 + "beta gamma"), (3, "alpha beta gamma")], "doc_id long, text string")
    got = {r.doc_id: (r.items, r.near_items) for r in d.matches(docs, items).collect()}
    assert got == {1: ([], ["1"]), 2: ([], []), 3: (["1"], ["1"])}
    assert d.matches(docs.limit(0), items).count() == 0
    assert [r.n_hit for r in d.report(d.matches(docs, items.limit(0))).collect()] == [0, 0, 0]
    assert [r.doc_id for r in d.decontaminate(docs, items).orderBy("doc_id").collect()] == [1, 2]


def test_items_without_id(spark):
    """A passage of an item with a null id is found; it has no id to be listed."""
    passage = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"a {passage} b"), (2, "a b"), (3, "x y z")], "doc_id long, text string")
    items = spark.createDataFrame([(None, passage), (None, "x y z"), (5, "x y z"), (None, None)], "item_id long, text string")
    for block_words in (500_000, 1):
        rows = d.matches(docs, items, reported=True, block_words=block_words).orderBy("doc_id").collect()
        assert [(r.n_hit, r.contaminated, r.n_items, r.n_near_items) for r in rows] == [(12, True, 0, 0), (0, False, 0, 0), (3, True, 1, 1)]
    assert [r.doc_id for r in d.decontaminate(docs, items).collect()] == [2]


def test_repeated_rows_and_long_items_in_blocks(spark):
    """Copies keep their own matches, and an item longer than a block loses no window."""
    passage = " ".join(f"w{k}" for k in range(200))
    docs = spark.createDataFrame([(1, passage), (1, passage), (2, " ".join(f"w{k}" for k in range(31, 60)))], "doc_id long, text string")
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    index = d.build_index(docs)
    want = sorted((r.doc_id, r.starts, r.lengths) for r in d.matches(docs, items, index=index).collect())
    assert [len(s) for _, s, _ in want] == [191, 191, 20]
    got = d.matches(docs, items, index=index, block_words=45).collect()
    assert sorted((r.doc_id, sorted(set(r.starts)), r.lengths) for r in got) == want
    other = spark.createDataFrame([(8, "w5 w6 w7")], "item_id long, text string")
    assert sorted((r.doc_id, r.items) for r in d.matches(docs, other, index=index).collect()) == [(1, ["8"]), (1, ["8"]), (2, [])]


def test_batches_are_bounded_by_bytes(spark):
    """Long texts don't add up in a batch."""
    import pyarrow as pa

    from barline.llm import common

    common.bounded_batches(spark)
    df = spark.range(0, 60, numPartitions=1).selectExpr("id", "repeat('abcdefgh', 131072) AS text")

    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    assert max(r.n for r in df.mapInArrow(size, "n long").collect()) < 2 * common.BATCH_BYTES
