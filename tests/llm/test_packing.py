"""Packing: whole-text encoding as the oracle, exact tiling, fill."""

import functools
import math
import random
import zlib

import numpy as np

from barline.llm import packing as p


def corpus():
    r = random.Random(2)
    words = ["The", "naïve", "it's", "<|endoftext|>", "ÉCOLE", "école", "Σας", "　wide", "x" * 70, "don't", "12,345", " nbsp", "tab\tcr\r", "ﬁ", "日本語テキスト", "🙂👍🏽"]
    docs = [(k, " ".join(r.choice(words) + r.choice(["", "\n", "  ", "."]) for _ in range(r.randint(0, 400)))) for k in range(120)]
    return [*docs, (200, None), (201, ""), (202, "long text " * 9000), (7, docs[7][1])]


def test_ids_and_tiling(spark):
    from tokenizers import Tokenizer

    docs = corpus()
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, shard int").repartition(4)
    whole = Tokenizer.from_file(p.tokenizer_file())
    want = []
    for doc, text in docs:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], dtype="<u4").tobytes()
            want.append((doc, k, at, len(part) // 4, zlib.crc32(part)))
    for options in ({}, {"shard_pieces": 10, "fan_in": 3}):
        rows = p.pack_documents(df, **options).collect()
        assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
        at = {}
        for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == at.get(r.sequence_id, 0)
            at[r.sequence_id] = r.offset + r.length
        assert max(at.values()) <= 4096
        least = math.ceil(sum(at.values()) / 4096)
        assert len(at) <= (least + 1 if not options else 1.1 * least + 1)  # shards of ten pieces fill less well
    assert p.pack_documents(df.limit(0)).count() == 0


def test_best_fit_is_best_fit():
    r = random.Random(1)
    lengths = sorted((r.randint(1, 100) for _ in range(300)), reverse=True)
    bins, offsets, used = p.best_fit(lengths, 100)
    room = []
    for n, k, at in zip(lengths, bins, offsets):
        fitting = [x for x in room if x >= n]
        if k == len(room):
            assert not fitting
            room.append(100)
        else:
            assert room[k] == min(fitting)
        assert at == 100 - room[k]
        room[k] -= n
    assert used == [100 - x for x in room]


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(p.tokenizer_file())


def whole_ids(text):
    return np.array(tokenizer().encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_ids_of_every_letter_and_mark():
    """Each letter, digit and mark of Unicode before signs, and A-Z with each mark, against whole texts."""
    import unicodedata

    encoder = p.WordEncoder(p.tokenizer_file())
    chars = [chr(c) for c in range(0x30, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] in "LNM"]
    marks = [c for c in chars if unicodedata.category(c)[0] == "M"]
    r = random.Random(6)
    runs = [f"{c}." for c in chars if ord(c) < 0x3000 or ord(c) % 16 == 0] + [f"A{c}b!? {c}x" for c in marks] + [f"{a}{m}" for a in "ADHJTWY" for m in marks] + ["DEĞERLENDİRMESİ. son", "İ, x", "Aİ. b"]
    r.shuffle(runs)
    texts = [" ".join(runs[k : k + 300]) for k in range(0, len(runs), 300)]
    for text, got in zip(texts, encoder.ids([t.encode() for t in texts])):
        assert got == whole_ids(text)


def test_random_texts_encode_alike():
    r = random.Random(9)
    encoder = p.WordEncoder(p.tokenizer_file(), most=50)
    alphabet = list("aAbZ'sSdtT19.,!|<>  \n\t") + ["\u0130", "\u0131", "\u0308", "\u0301", "\u0331", "\u030c", "\u0338", "ß", "É", "é", "ĳ", "ǅ", "Σ", "ς", "\u00a0", "\u2019", "ẞ", "日", "🙂", "\u200d"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    for text, got in zip(texts, encoder.ids([t.encode() for t in texts])):
        assert got == whole_ids(text), text


def test_tree_is_bounded_where_nothing_fits(spark):
    """Pieces over half the capacity: no two share a bin, and few bins travel."""
    lengths = [2050 + k * 37 % 2021 for k in range(4000)]
    rows = [(k, 0, 0, n, k) for k, n in enumerate(lengths)]
    cut = p.spool(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    out = p.pack(cut, shard_pieces=100, fan_in=2).collect()
    assert len(out) == len({r.sequence_id for r in out}) == 4000 and all(r.offset == 0 for r in out)
    same = [3000] * 500 + [1000]
    up = p.moving(p.best_fit(same, 4096)[2], 4075, 3)
    assert up.sum() == 4  # three of the equal bins and the filled one
    small = [(k, 0, 0, n, k) for k, n in enumerate([3000, 1090] * 300)]
    out = p.pack(p.spool(spark.createDataFrame(small, "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces"), shard_pieces=50, fan_in=2).collect()
    assert len({r.sequence_id for r in out}) <= 310
