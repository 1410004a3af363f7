"""Chunks by a plain rolling hash; the whole query by brute force; planted passages."""

import random

import numpy as np

from barline.llm import substrings as s


def plain_boundaries(text, average, smallest, largest):
    hashes, h, bits = [], 0, average.bit_length() - 1
    for b in text:
        h = ((h << 1) + int(s._GEAR[b])) & 0xFFFFFFFF
        hashes.append(h)
    out, last = [], 0
    while last < len(text):
        within = range(last + smallest, min(last + largest, len(text)) + 1)
        end = next((k for k in within if hashes[k - 1] >> (32 - bits) == 0), None)
        if end is None and len(text) - last > largest:
            end = min(within, key=lambda k: (hashes[k - 1], k))
        last = end or len(text)
        out.append(last)
    return out


def test_boundaries():
    r = random.Random(3)
    for n in (0, 1, 15, 16, 17, 300, 5000):
        text = bytes(r.randrange(32, 90) for _ in range(n))
        for largest in (40, 256):
            got = s.boundaries(text, 32, 16, largest).tolist()
            want = plain_boundaries(text, 32, 16, largest)
            assert got == want, (n, largest)
    text = bytes(r.randrange(256) for _ in range(4000))
    moved = b"inserted" + text
    period = b"Onwhou " * 200  # two phases of a periodic text share their chunks
    cut = lambda t: {t[x:y] for x, y in zip([0, *s.boundaries(t, 32, 16, 256)], s.boundaries(t, 32, 16, 256))}
    assert cut(b"Xy. " + period) & cut(b"Some other start. " + period)
    a, b = set(s.boundaries(text, 32, 16, 256).tolist()), {x - 8 for x in s.boundaries(moved, 32, 16, 256).tolist()}
    assert len(a & b) > 0.9 * len(a)


def brute(docs, passage=96):
    rows = []
    for k, (doc, text) in enumerate(docs):
        t = (text or "").encode()
        e = s.boundaries(t, 32, 16, 256).tolist()
        rows.append((doc, t, [t[a:b] for a, b in zip([0, *e[:-1]], e)], e))
    places = {}
    for k, (doc, _, chunks, _) in enumerate(rows):
        for j, c in enumerate(chunks):
            places.setdefault(c, []).append((doc is not None, doc, k, j))
    out = []
    for k, (doc, t, chunks, e) in enumerate(rows):
        twice = np.array([len(places[c]) > 1 for c in chunks], dtype=bool)
        later = np.array([min(places[c])[2:] != (k, j) and len(places[c]) > 1 for j, c in enumerate(chunks)], dtype=bool)
        ends = np.array(e, dtype=np.int64)
        spans = s.passages(ends, twice, passage) if len(e) else []
        inside = np.array([any(a <= x - len(c) and x <= b for a, b in spans) for x, c in zip(e, chunks)], dtype=bool)
        drop = inside & later
        out.append((doc, len(t), len(e), int(twice.sum()), int(drop.sum()), sum(b - a for a, b in spans), bool(spans), ",".join(f"{a}:{b}" for a, b in spans), sum(len(c) for c, d in zip(chunks, drop) if not d)))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    r = random.Random(4)
    words = [f"w{k}é" if k % 9 == 0 else f"word{k}" for k in range(3000)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = [text(60) for _ in range(3)]
    docs = [(k, text(r.randint(0, 150)) + (" " + r.choice(shared) + " " + text(30) if k % 2 else "")) for k in range(40)]
    docs += [(50, None), (51, ""), (52, "ab " * 20000), (53, docs[1][1])]
    df = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, row string").coalesce(1)
    got = s.repeated_substrings(df).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs)
    caught = {r.doc_id for r in got if r.has_repeat}
    assert {k for k in range(40) if k % 2} <= caught
    assert not {k for k in range(0, 40, 2)} & caught


def test_edges(spark):
    text = " ".join(f"a{k}" for k in range(100))
    df = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    rows = s.repeated_substrings(df).collect()
    assert sorted(r.n_dropped_chunks == r.n_chunks for r in rows) == [False, True, True]
    assert all(r.has_repeat and r.repeated_bytes == len(text) for r in rows)
    assert s.repeated_substrings(df.limit(0)).count() == 0


def test_a_chunk_of_half_of_all(spark):
    """A hot digest: it is broadcast, and the rows are the same."""
    docs = [(k, "same " * 60 + (f"tail {k} " * 20 if k % 3 else "")) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert sorted(map(tuple, s.repeated_substrings(df).collect()), key=str) == brute(docs)


def test_joined_evenly(spark):
    from pyspark.sql import functions as F

    from barline.llm.common import joined_evenly

    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    of = spark.createDataFrame([(7, 1000, None), (8, 1, "b"), (9, 1, "c"), (-5, 1, "d")], "k long, n long, v string")
    got = {r.x: (r.k, r.n, r.v) for r in joined_evenly(rows, ["k"], of, "n", 3000).collect()}
    assert len(got) == 3000 and got[0] == got[2997] == (7, 1000, None) and got[8] == (8, 1, "b") and got[10] == (10, None, None) and got[9] == (7, 1000, None)
