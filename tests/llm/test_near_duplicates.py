"""All pairs of a small fixture, compared by brute force."""

import random
import re

from barline.llm import near_duplicates as n

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text, width):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def brute(docs, width):
    sets = [plain_set(t, width) for _, t in docs]
    parent = list(range(len(docs)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(a)] = root(b)
    low = {}
    for k, (doc, _) in enumerate(docs):
        low[root(k)] = min(low.get(root(k), doc), doc)
    return sorted((doc, len(sets[k]), low[root(k)] if sets[k] else doc, doc == (low[root(k)] if sets[k] else doc)) for k, (doc, _) in enumerate(docs))


def fixture(size=60, copies=240, seed=5):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    docs, at = [], 1000
    base = [r.choice(words) for _ in range(size)]
    for k in range(copies):  # one large group of near copies, edited from light to heavy
        t = list(base)
        for _ in range(r.randint(0, 5)):
            t[r.randrange(len(t))] = r.choice(words)
        docs.append((at := at - 1, " ".join(t)))
    for k in range(40):
        t = [r.choice(words) for _ in range(r.randint(1, 30))]
        docs += [(at := at - 1, " ".join(t)), (at := at - 1, "  ".join(t).upper()), (at := at - 1, " ".join([*t, "tail"]))]
    docs += [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "one two  three"), (8, "w1 " * 5000), (9, "w1 " * 5001)]
    return docs


def test_matches_brute_force(spark):
    docs = fixture()
    df = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, node string").repartition(5)
    want = brute(docs, 4)
    assert sorted(map(tuple, n.near_duplicates(df, width=4).collect())) == want
    # Tiny blocks: the hub, the open classes and the block pairs.
    assert sorted(map(tuple, n.near_duplicates(df, width=4, slot_hashes=700, block_hashes=900).collect())) == want


def test_nulls_repeats_empty(spark):
    t = " ".join(f"a{k}" for k in range(30))
    df = spark.createDataFrame([(3, t), (3, t), (None, t), (2, t), (3, "other text")], "doc_id long, text string")
    got = sorted(map(tuple, n.near_duplicates(df).collect()), key=str)
    assert got == sorted([(3, 26, 2, False), (3, 26, 2, False), (None, 26, 2, False), (2, 26, 2, True), (3, 1, 3, True)], key=str)
    assert n.near_duplicates(df.limit(0)).count() == 0
    chain = spark.createDataFrame([(k, k + 1) for k in range(1, 40)], "u long, v long")
    assert {r.component for r in n.components(chain).collect()} == {1}
    star = spark.createDataFrame([(0, k) for k in range(1, 3000)] + [(-1, 2999), (5000, 5001)], "u long, v long")
    got = {r.node: r.component for r in n.components(star).collect()}
    assert len(got) == 3003 and {v for k, v in got.items() if k < 5000} == {-1} and got[5001] == 5000


def test_many_null_ids_take_linear_time(spark):
    """Null ids name no row: classes and texts are joined by row numbers."""
    import time

    r = random.Random(3)
    text = lambda: " ".join(f"w{r.randrange(500)}" for _ in range(12))
    docs = [(None, text()) for _ in range(5000)]
    docs += [(None, t + " tail") for _, t in docs[:5000]]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    began = time.time()
    rows = n.near_duplicates(df, width=4).collect()
    assert len(rows) == 10_000 and all(x.component_id is None and x.kept for x in rows)
    assert time.time() - began < 120
