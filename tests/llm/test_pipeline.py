"""The five stages on a small corpus with planted cases, each stage against brute force on its own input."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barline.llm import pii, quality
from tests.llm.test_decontamination import plain_words
from tests.llm.test_near_duplicates import brute as near_brute
from tests.llm.test_quality import plain as plain_figures

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(12)
    path = tmp_path_factory.mktemp("sf")
    words = [f"{a}{b}" for a in ("ran", "tel", "mos", "ike", "dor", "una") for b in ("ta", "li", "en", "or", "as", "ui", "")]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    item = text(25)
    docs = [text(r.randint(60, 160)) for _ in range(50)]
    docs += [docs[0], docs[1].upper(), docs[2] + " tail", " ".join(f"{w}***" for w in docs[3].split())]
    docs += [text(40) + " " + item.title() + " " + text(40), text(80) + " mail a.b@c.de or 1.2.3.4 now", "too short", "", None, text(9000)]
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(docs)]
    junk = [(1000 + k, " ".join(f"{r.choice(words)}$$$" for _ in range(80)), "en", "j", 0) for k in range(8)]
    spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(k, 1, 0) for k in range(4, 40)] + [(1000 + k, 0, 0) for k in range(6)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(7, item), (8, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, folder)
        if name != "best_fit_packing":
            assert docs.columns == COLUMNS
            docs.write.parquet(f"{folder}/{name}.parquet")
            docs = spark.read.parquet(f"{folder}/{name}.parquet")
        seen[name] = (before, docs.collect())

    before, rows = seen["quality_rules"]
    left = {r.doc_id for r in rows}
    assert {k for k, r in before.items() if plain_figures(r.text)[-1]} & left == set()
    assert not left & {1000 + k for k in range(8)} and 53 not in left and set(range(50)) - left == set()
    scored = {r.doc_id for r in quality.score(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).where("kept").collect()}
    assert left == scored

    before, rows = seen["near_duplicates"]
    assert sorted(r.doc_id for r in rows) == [d for d, _, _, kept in near_brute([(k, r.text) for k, r in sorted(before.items())], 5) if kept]
    assert not {50, 51, 52} & {r.doc_id for r in rows}

    before, rows = seen["benchmark_decontamination"]
    item = plain_words(spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 7").first().text)
    windows = {tuple(item[k : k + 10]) for k in range(len(item) - 9)}
    hit = {k for k, r in before.items() for w in [plain_words(r.text)] if any(tuple(w[i : i + 10]) in windows for i in range(len(w)))}
    assert hit == {54} and {r.doc_id for r in rows} == set(before) - hit

    before, rows = seen["personal_data"]
    model = pii.trained()
    assert {r.doc_id: (r.text, r.n_chars) for r in rows} == {k: (t := pii.masked(r.text, model), len(t)) for k, r in before.items()}
    assert "mail <email> or <ip> now" in {r.doc_id: r.text for r in rows}[55]

    before, rows = seen["best_fit_packing"]
    assert {r.doc_id for r in rows} == set(before)
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 4096 and len(at) <= -(-sum(at.values()) // 4096) + 1


def test_run(spark, folder):
    first = corpus_pipeline.run(spark, folder).select("doc_id", "piece", "length", "ids_crc32").orderBy("doc_id", "piece").collect()
    assert first == corpus_pipeline.run(spark, folder).select("doc_id", "piece", "length", "ids_crc32").orderBy("doc_id", "piece").collect()
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][0] == "quality_rules"


def test_nulls_and_empty(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    null = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        assert stage(spark, null, folder).where("doc_id IS NULL").count() >= 1, name


def test_decided_by_row(spark, tmp_path):
    """Null ids, repeated rows, and one id with two texts: what stays is decided for each row."""
    r = random.Random(5)
    text = lambda n: " ".join(f"{r.choice('abcdefgh')}{r.choice('aeiou')}{r.choice('klmnrst')}{r.randint(1, 9)}" for _ in range(n))
    a, b, c, item = text(100), text(100), text(100), text(20)
    junk = "too short"
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    quality_stage, near_stage, clean_stage = (s for _, s in corpus_pipeline.STAGES[:3])

    def left(stage, rows):
        df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        path = f"{tmp_path}/{stage.__name__}.parquet"
        df.write.mode("overwrite").parquet(path)
        stored, made = ([(x.doc_id, x.text) for x in stage(spark, y, str(tmp_path)).collect()] for y in (spark.read.parquet(path), df))
        key = lambda x: (x[0] is None, x[0] or 0, x[1])
        assert sorted(stored, key=key) == sorted(made, key=key)
        return sorted(stored, key=key)

    assert len({a, b, c}) == 3 and plain_figures(junk)[-1] and not plain_figures(a)[-1]
    assert left(quality_stage, [(1, junk), (1, a), (None, junk), (None, a), (2, a), (2, a)]) == [(1, a), (2, a), (2, a), (None, a)]
    assert left(near_stage, [(3, a), (2, a), (2, a), (2, b), (None, a), (None, c), (None, c)]) == sorted([(2, a), (2, b)], key=lambda x: x[1]) + [(None, c)]
    hit = f"{a} {item} {b}"
    assert left(clean_stage, [(1, hit), (1, a), (None, hit), (None, b)]) == [(1, a), (None, b)]
