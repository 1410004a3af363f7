"""Round trips, layouts, the loss mask, and digests by plain Python."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from barline.llm import chat

PARTS = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE=x] ", " [/ROLE]", "\\", "<", "[", " ", "\n", "é🙂", "ok", "<\\s>", "[\\\\/INST]", "$1"]


def rows():
    r = random.Random(9)
    text = lambda: "".join(r.choice(PARTS) for _ in range(r.randint(0, 12)))
    out = [(k, t, r.choice(["user", "assistant", "system", "tool ] x\n", ""]), text()) for k in range(60) for t in range(r.randint(1, 6))]
    return [*out, (900, 0, "user", None), (900, 1, None, "x"), (900, None, "assistant", ""), (901, 0, "user", "y" * 300_000), (902, 1, "assistant", "same"), (902, 1, "assistant", "same"), (None, 0, "assistant", "z")]


def test_round_trip_and_loss(spark):
    data = rows()
    df = spark.createDataFrame([(a, b, c, d, "extra") for a, b, c, d in data], "conv_id long, turn long, role string, text string, messages string").repartition(3)
    want = {}
    for a, b, c, d in sorted(data, key=lambda x: (x[1] is not None, x[1], x[2] or "", x[3] or "")):
        want.setdefault(a, []).append((c or "", d or ""))
    out = chat.format_conversations(df).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_runs")))
    got = out.collect()
    assert {r.conv_id: [tuple(t) for t in r.back] for r in got} == want
    for r in got:
        assert r.loss == "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert sum(x.before + x.loss + x.after for x in r.loss_runs) == len(r.formatted)
        assert r.layout == "messages"
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_layouts(spark):
    records = [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b", "extra": 1}], "x": {"y": 2}}, "messages", [("user", "a"), ("assistant", "b")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "system": "s"}, "dialogue", [("system", "s"), ("user", "a"), ("assistant", "b")]),
        ({"instruction": "a", "input": "i", "output": "b"}, "instruction", [("user", "a\n\ni"), ("assistant", "b")]),
        ({"instruction": "a", "input": None, "output": "b"}, "instruction", [("user", "a"), ("assistant", "b")]),
        ({"prompt": "a", "completion": "b"}, "completion", [("user", "a"), ("assistant", "b")]),
        ({"prompt": "a", "response": ""}, "response", [("user", "a"), ("assistant", "")]),
        ({"question": "a", "answer": "b"}, "question", [("user", "a"), ("assistant", "b")]),
        ({"other": "a"}, None, []),
        ({"messages": []}, None, []),
        ({"messages": [{"role": "user", "content": None}, {"role": "assistant", "content": None}]}, "messages", [("user", ""), ("assistant", "")]),
        ({"messages": [{"role": None, "content": "a"}], "system": "s"}, "messages", [("system", "s"), ("", "a")]),
        ({"conversations": [{"from": "human"}, {"from": "gpt"}]}, "dialogue", [("user", ""), ("assistant", "")]),
        ({"messages": [{"speaker": "user", "words": "a"}]}, None, []),
    ]
    lines = [(k, json.dumps(r)) for k, (r, _, _) in enumerate(records)] + [(98, "{broken"), (99, None)]
    df = chat.canonical(chat.from_json(spark.createDataFrame(lines, "id long, js string"), "js"))
    got = {r.id: (r.layout, [tuple(t) for t in r.turns]) for r in df.select("id", "layout", "turns").collect()}
    for k, (_, layout, turns) in enumerate(records):
        assert got[k] == (layout, turns)
    assert got[98] == got[99] == (None, [])
    assert set(chat.fingerprints().values()) == set(chat.LAYOUTS)


def test_query_digests(spark):
    got = {r.conv_id: r for r in chat.query(spark, "/root/testdata/sf0.001").collect()}
    r, text = got[-7], "</s>[INST] ok [/INST]"
    assert r.n_turns == 2 and r.loss_chars == len(text)
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
