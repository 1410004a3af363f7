"""The base figures by brute force, a slope check, a proper distribution, and held-out gain."""

import math
import random
import re
import zlib

import numpy as np

from barline.llm import language_model as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs):
    tokens = [[*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None] for _, t in docs]
    out = [zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1 for d, _ in docs]
    count = {}
    for held, ts in zip(out, tokens):
        for t in ts if not held else ():
            count[t] = count.get(t, 0) + 1
    n, v = sum(count.values()), len(count)
    rows = []
    for (d, _), held, ts in zip(docs, out, tokens):
        base = sum(math.log10((count.get(t, 0) + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        rows.append((str(d), held, len(ts), sum(t in count for t in ts), n, round(base, 6)))
    return sorted(rows)


def corpus():
    r = random.Random(6)
    en, fr = [f"the{k}" for k in range(60)], [f"lé{k}." for k in range(60)]
    docs = []
    for k in range(400):
        words = r.choice([en, fr])
        docs.append((k, " ".join(r.choice(words) if r.random() < 0.95 else f"Rare{r.randint(0, 5000)}***" for _ in range(r.randint(0, 120)))))
    return [*docs, (400, None), (401, ""), (None, "the1 the2"), (3, docs[3][1]), (402, "the1 " * 30000)]


def test_base_and_gain(spark):
    docs = corpus()
    df = spark.createDataFrame([(a, b, 1, 2.0) for a, b in docs], "doc_id long, text string, n int, word double").repartition(3)
    for head in (200_000, 40):
        rows = lm.score(df, short=32, classes=4, head=head).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == plain(docs)
        held = [r for r in rows if r.held_out and r.doc_id != 402]
        assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)
    assert lm.score(df.limit(0), short=32, classes=4).count() == 0
    # Untrained it is the base score, whatever words are known: what is gained is the network's.
    rows = lm.score(df, short=32, classes=4, head=40, trained=False).where("doc_id <> 402").collect()
    assert all(abs(r.score - r.base_score) < 0.06 * r.n_tokens for r in rows)


def test_every_token_once(monkeypatch):
    """Streams share a task's tokens out without repeating or losing one."""
    model = small_model()[0]
    seen = []
    monkeypatch.setattr(model, "window", lambda x, y, keep, h: (seen.extend(zip(x.ravel().tolist(), y.ravel().tolist())), (np.zeros_like(model.flat), h, 0.0))[1])
    trainer = lm.Trainer(model)
    y = np.arange(40_007)
    trainer.add(y, -1)
    trainer.run(-1)
    assert sorted(seen) == [(k - 1, k) for k in range(40_007)]


def test_hot_long_word(spark):
    """A word of over 64 bytes in every document isn't in the head; the join broadcasts its digest."""
    url = "https://example.com/" + "x" * 80
    docs = [(k, f"{url} w{k % 7} {url}") for k in range(300)]
    rows = lm.score(spark.createDataFrame(docs, "doc_id long, text string"), short=32, classes=4).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == plain(docs)


def small_model():
    words = [(f"w{k}".encode(), 50 - k) for k in range(20)] + [(lm.END, 5), (b"x.", 2), ("é".encode(), 2), ("à".encode(), 1)]
    words.sort(key=lambda x: (-x[1], x[0]))
    tokens, types = np.zeros(lm.TAILS), np.zeros(lm.TAILS)
    for w, c in words[8:]:
        tokens[lm.shape(w) if w != lm.END else 0] += c
        types[lm.shape(w) if w != lm.END else 0] += 1
    v = lm.Vocabulary(words, sum(c for _, c in words), len(words), tokens, types, 8, 2)
    return lm.GRU(v, 5), words


def test_slope():
    model, _ = small_model()
    r = np.random.default_rng(0)
    model.flat += r.normal(0, 0.3, len(model.flat)).astype(np.float32)
    model.flat = model.flat.astype(np.float64)
    model.views = model.split(model.flat)
    x, y = r.integers(0, 8 + lm.TAILS, (6, 3)), r.integers(0, 8 + lm.TAILS, (6, 3))
    keep = (r.random((6, 3)) > 0.3).astype(np.float64)
    h = r.normal(0, 1, (3, 5))
    g, _, _ = model.window(x, y, keep, h)
    for k in r.integers(0, len(model.flat), 150):
        old = model.flat[k]
        model.flat[k] = old + 1e-4
        up = model.window(x, y, keep, h)[2]
        model.flat[k] = old - 1e-4
        down = model.window(x, y, keep, h)[2]
        model.flat[k] = old
        assert abs((up - down) / 2e-4 / x.size - g[k]) < 2e-4


def test_sums_to_one_and_carries_state():
    model, words = small_model()
    model.flat += np.random.default_rng(1).normal(0, 0.3, len(model.flat)).astype(np.float32)
    v = model.v
    outcomes = np.arange(8 + lm.TAILS)
    state = np.random.default_rng(2).normal(0, 1, (1, 5)).astype(np.float32)
    logp, _ = model.output(np.repeat(state, len(outcomes), 0), outcomes)
    assert abs(np.exp(logp).sum() - 1) < 1e-5
    inside = 0.5 / 10.0**v.log_tail  # inside each tail class: an unknown word and the known ones
    for w, c in words[8:]:
        k = lm.shape(w) if w != lm.END else 0
        inside[k] += (c + 0.5) / 10.0 ** v.log_tail[k]
    assert np.allclose(inside, 1)
    docs = [np.random.default_rng(k).integers(0, 8 + lm.TAILS, n) for k, n in enumerate([1, 7, 300, 2, 50])]
    got = lm.score_documents(model, docs, 3, slots=2, flush=4)
    for d, total in zip(docs, got):
        h, want, before = np.zeros((1, 5), dtype=np.float32), 0.0, 3
        for t in d:
            h = model.step(np.array([before]), h)[0]
            want += float(model.output(h, np.array([t]))[0][0])
            before = t
        assert abs(total - want) < 1e-2


def test_common_words_have_their_own_output(spark, monkeypatch):
    """The 1,024 most frequent words have ids of their own, as every argument is by default."""
    made, init = [], lm.Vocabulary.__init__
    monkeypatch.setattr(lm.Vocabulary, "__init__", lambda self, *a: (init(self, *a), made.append(self))[0])
    words = [f"w{k}" for k in range(1100)]
    df = spark.createDataFrame([(k, " ".join(words[: 1100 - 3 * k])) for k in range(40)], "doc_id long, text string")
    assert lm.score(df).count() == 40
    ids, _, _ = made[0].encode([w.encode() for w in words[:900]])
    assert len(set(ids[:-1].tolist())) == 900 and ids.max() < made[0].short


def test_updates_per_token():
    """A window of training is at most 256 streams wide: no fewer updates than that for the tokens of a task."""
    trainer = lm.Trainer(small_model()[0])
    trainer.add(np.random.default_rng(3).integers(0, 8 + lm.TAILS, 600_000), 3)
    trainer.run(3)
    assert trainer.tokens == 600_000 and trainer.updates >= 600_000 // (256 * 16)
