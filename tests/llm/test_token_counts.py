"""Offsets by decoding token by token; attribution by a loop over tokens and characters."""

import random

import numpy as np

from barline.llm import token_counts as tc

TEXTS = ["", "one line", "two\nlines", "\n\n\nx", "ends\n", "é🙂\n日本語 ﬁ\n\n\n  indented\r\n\ttab", "a" * 3000 + "\n" + "b c " * 500, "<|endoftext|>\nit's"]


def encoder():
    return tc.ByteEncoder(tc.vocabulary_file(), tc.split_pattern())


def plain(text, rule):
    e = encoder()
    data = text.encode()
    sizes = [len(e.encoding.decode_single_token_bytes(t)) for t in e.encoding.encode_ordinary(text)]
    lines, owner = text.split("\n"), []
    for k, line in enumerate(lines):
        owner += [k] * (len(line) + (k < len(lines) - 1))
    n = len(lines) - (lines[-1] == "")
    counts, crossing, at = np.zeros(n), 0, 0
    first = [k for k, ch in enumerate(text) for _ in ch.encode()]
    lead = [j == 0 for ch in text for j, _ in enumerate(ch.encode())]
    for size in sizes:
        chars = [first[k] for k in range(at, at + size) if lead[k]] or [first[at]]
        at += size
        own = [owner[c] for c in chars]
        crossing += own[0] != own[-1]
        if rule == "first":
            counts[own[0]] += 1
        elif rule == "split":
            for o in own:
                counts[o] += 1 / len(own)
        else:
            counts[max(sorted(set(own)), key=own.count)] += 1
    assert at == len(data)
    return len(sizes), n, crossing, [round(x, 9) for x in counts]


def test_against_loop(spark):
    r = random.Random(5)
    cases = TEXTS + ["".join(r.choice(["a", " b", "\n", "\n\n", " ", "é", "🙂", "the", "\n  "]) for _ in range(r.randint(1, 60))) for _ in range(60)]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(cases)], "doc_id long, text string, n_tokens int").repartition(3)
    for rule in tc.RULES:
        got = {x.doc_id: (x.n_tokens, x.n_sections, x.n_crossing, [round(v, 9) for v in x.section_tokens]) for x in tc.document_counts(df, crossing=rule).collect()}
        for k, t in enumerate(cases):
            assert got[k] == plain(t, rule), (rule, t)
            assert abs(sum(got[k][3]) - got[k][0]) < 1e-6
    rows = tc.section_counts(df).where("doc_id = 2").orderBy("section").collect()
    assert [(x.section, x.start, x.end) for x in rows] == [(0, 0, 4), (1, 4, 9)]


def test_long_text_in_parts():
    e = encoder()
    text = ("some words, and it's more\n  of them 12 " * 400).encode()
    whole = e.ends(text)
    assert (e.ends(text, step=500) == whole).all() and whole[-1] == len(text)


def test_other_patterns(spark):
    words = r"\S+ \S+|\S+|\s"  # joins two words over a blank
    text = ("ab cd " * 300).encode()
    e = tc.ByteEncoder(tc.vocabulary_file(), words)
    assert (e.ends(text, step=100) == e.ends(text)).all()
    docs = spark.createDataFrame([(1, "it's 12345 ab")], "doc_id long, text string")
    given = len(tc.ByteEncoder(tc.vocabulary_file(), r"(?s).").ends(b"it's 12345 ab"))
    assert [r.n_tokens for r in tc.document_counts(docs, pattern=r"(?s).").collect()] == [given] == [13]
    assert tc.document_counts(docs).collect()[0].n_tokens < 13


def test_fields_and_edges(spark):
    df = spark.createDataFrame([(1, "a title", None, "body\ntext"), (2, None, None, None), (None, "x", "y", "")], "doc_id long, title string, lang string, text string")
    rows = tc.field_counts(df, ["title", "lang", "text"]).collect()
    assert all(abs(sum(r[2:]) - r.n_tokens) < 1e-9 for r in rows)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x y"), (3, "x y")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_tokens, r.n_sections) for r in tc.document_counts(docs).collect()) == [(1, 0, 0), (2, 0, 0), (3, 2, 1), (3, 2, 1)]
    assert tc.document_counts(docs.limit(0)).count() == 0 and tc.section_counts(docs).count() == 2
