"""Alignment against exhaustive search, and scanning against alignment at every place."""

import itertools
import random

from barline.llm import licenses as li


def test_longest_increasing():
    r = random.Random(1)
    for _ in range(300):
        v = r.sample(range(50), r.randint(0, 9))
        best = max((n for n in range(len(v) + 1) for s in itertools.combinations(v, n) if list(s) == sorted(s)), default=0)
        got = [v[k] for k in li.longest_increasing(v)]
        assert got == sorted(got) and len(got) == best


def test_patience():
    assert li.patience("a b c d".split(), "a b c d".split()) == [(k, k) for k in range(4)]
    assert li.patience("x a b y c".split(), "a b z c".split()) == [(1, 0), (2, 1), (4, 3)]
    r = random.Random(2)
    for _ in range(300):
        a, b = [r.choice("abcdefg") for _ in range(r.randint(0, 12))], [r.choice("abcdefg") for _ in range(r.randint(0, 12))]
        pairs = li.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    for text, _ in li.TEMPLATES.values():  # a few lost words cost a few words of coverage
        t = li.words(text)
        a = t[: len(t) // 2] + ["qqq"] + t[len(t) // 2 + 1 :]
        assert len(li.patience(["x", *a, "y"], t)) >= 0.75 * len(t)


def test_scan():
    s = li.Scanner(li.TEMPLATES, 0.8)
    filler = "Lorem the of and work is under dolor sit amet software"
    mit, gpl = li.TEMPLATES["MIT-line"][0], li.TEMPLATES["GPL-3.0-line"][0]
    n, found = s.scan(f"{filler} {mit} {mit} {filler}. {gpl}")
    assert [(x[2], x[3]) for x in found] == [("MIT-line", 1.0), ("MIT-line", 1.0), ("GPL-3.0-line", 1.0)]
    k = len(li.words(filler))
    assert [(x[0], x[1]) for x in found[:2]] == [(k, k + 5), (k + 5, k + 10)]
    for name, (text, _) in li.TEMPLATES.items():
        assert name in {x[2] for x in s.scan(f"{filler}\n{text}\n{filler}")[1]}
    changed = li.TEMPLATES["MIT"][0].replace("free of charge", "gratis").replace("THE SOFTWARE IS", "This is")
    assert [x[2] for x in s.scan(changed.upper())[1]] == ["MIT"]
    assert s.scan(filler * 50)[1] == [] and s.scan("")[1] == []


def brute(template, ws):
    """Every stretch of every length, aligned, by the definition."""
    out, k = [], 0
    whole = []
    for k in range(len(ws)):
        for size in template.sizes if ws[k] in template.words else ():
            pairs = li.patience(ws[k : k + size], template.words)
            if len(pairs) >= template.least_pairs and template.marks <= {template.words[j] for _, j in pairs}:
                whole.append((k, len(pairs), k + pairs[0][0], k + pairs[-1][0] + 1))
    begin = 0
    while (rest := [x for x in whole if x[0] >= begin]):
        first = rest[0][0]
        top = max((x for x in rest if x[0] == first), key=lambda x: x[1])
        for x in rest:
            if x[0] < top[3] and x[1] > top[1]:
                top = x
        out.append(top[1:])
        begin = top[3]
    return out


def test_scan_misses_nothing():
    """Copies of each template with words replaced, lost and put in, back to back and in filler, against all
    stretches of all places."""
    r = random.Random(7)
    found = 0
    for name, given in li.TEMPLATES.items():
        t = li.Template(name, *given, 0.8)
        long = len(t.words) > 60
        for _ in range(3 if long else 40):
            ws = []
            for _ in range(r.randint(1, 3 if not long else 1)):
                copy = list(t.words)
                for _ in range(r.randint(0, len(copy) // 4)):
                    at = r.randrange(len(copy))
                    copy[at : at + 1] = r.choice([["q"], [], [copy[at], "q"], [r.choice(t.words)]])
                    copy = copy or ["q"]
                ws += [r.choice(["x", *t.words]) for _ in range(r.randint(0, 6))] + copy
            at = [(k, w) for k, w in enumerate(ws) if w in t.signals]
            got, want = list(t.occurrences(ws, at)), brute(t, ws)
            assert got == want, (name, ws)
            found += len(want)
    assert found > 500


def test_lost_signal_words():
    """The first signal word of each template replaced, and the wrong family is never named."""
    s = li.Scanner(li.TEMPLATES)
    for name, (text, marks) in li.TEMPLATES.items():
        t = li.words(text)
        k = next(k for k, w in enumerate(t) if w in s.templates[list(li.TEMPLATES).index(name)].signals and w not in li.words(marks))
        (_, _, got, c), = s.scan(" ".join([*t[:k], "qqq", *t[k + 1 :]]))[1]
        assert got == name and c == (len(t) - 1) / len(t), (name, got, c)
    assert [x[2] for x in s.scan("This work is released under the GNU General Public License, version 3.")[1]] == ["GPL-3.0-line"]
    assert [x[2] for x in s.scan("This work is licensed under the GNU General Public License, version 2.")[1]] == ["GPL-2.0-line"]
    assert s.scan("Released under the FOO License.")[1] == []


def test_ties_and_overlaps():
    s = li.Scanner({"b": "one two three four five", "a": "one two three four five", "c": "four five six seven eight nine"})
    assert s.scan("one two three four five")[1] == [(0, 5, "a", 1.0)]
    assert s.scan("one two three four five six seven eight nine")[1] == [(3, 9, "c", 1.0)]  # the most words


def test_query_edges(spark):
    t = li.TEMPLATES["MIT-line"][0]
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, t, 1), (3, t, 1), (None, "word " * 100_000 + t, 1)], "doc_id long, text string, coverage int")
    got = sorted(map(tuple, li.scan_licenses(df).collect()), key=str)
    assert got == sorted([(1, 0, 0, None, 0.0, ""), (2, 0, 0, None, 0.0, ""), (3, 5, 1, "MIT-line", 1.0, "MIT-line:0:5:100"), (3, 5, 1, "MIT-line", 1.0, "MIT-line:0:5:100"), (None, 100_005, 1, "MIT-line", 1.0, "MIT-line:100000:100005:100")], key=str)
    assert li.scan_licenses(df.limit(0)).count() == 0
