r"""Quality rules: fixed text statistics and a hashed n-gram log-likelihood ratio.

Method: character n-grams (bytes of UTF-8) are hashed into a fixed number of buckets. Two multinomials are
fitted with additive smoothing: the trusted target (documents labelled good) and the raw corpus (all
documents). A document's score is the mean over its n-grams of log p_target - log p_raw, so length cancels.
A document is kept or rejected by comparing its score with one threshold: deterministic, no sampling.

The threshold is the middle of the widest gap among the cuts with the least error on labelled documents
(rejecting a good one costs `clean_cost` times as much as keeping a bad one). While scoring a document of
the target its own n-grams are taken out of the target (leave-one-out). Every copy of such a text, labelled
or not, has that same score: copies meet by a 64-bit digest and their number of n-grams, so equal texts get
equal verdicts.

Size: raw counts, scores and decisions cover every row. Only the labels are a bounded sample: at most
`most_labels` labelled ids, the lowest by hash, are broadcast as sorted 64-bit numbers (16 bytes each).
Each task sends one row of counts per bucket it saw, at most `buckets`. The digests of the target's texts are
a stored table, which Spark broadcasts if its files are small and joins by a shuffle if ids are repeated so
often that they aren't.

Defined results: null or empty text has no words and fails the base rules; ids without a label are only
raw; several labels of one id count as their lowest; without labels of both kinds nothing is rejected by
score; a score equal to the threshold is kept; repeated rows each give a row; a null id is scored as an unlabelled one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import batch, bounded_batches, documents, spool, table, texts

_CONTINUED = bytes(range(0x80, 0xC0))
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_COUNTS = pa.schema([("bucket", pa.int32()), ("target", pa.int64()), ("raw", pa.int64())])
_STATS = pa.schema([(k, pa.int64()) for k in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("base_failed", pa.bool_()), ("label", pa.int32()), ("digest", pa.int64()), ("n_grams", pa.int64()), ("score", pa.float64())])


def repeated(words: list[bytes], width: int = 3) -> int:
    """How many words lie in windows of `width` words that are found twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    codes, base = ids[:n], len(number)
    for k in range(1, width):
        if k > 1 and base ** (k + 1) >= 1 << 62:
            codes = np.unique(codes, return_inverse=True)[1]
        codes = codes * base + ids[k : k + n]
    ordered = np.sort(codes)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(codes, twice))
    covered = np.zeros(len(words), dtype=bool)
    for k in range(width):
        covered[at + k] = True
    return int(covered.sum())


def base_stats(text: bytes) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, _CONTINUED + _SPACE))
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    again = repeated(words)
    return n, chars, symbols, len(lines) - len(set(lines)), again, n < 50 or 100 * again > 50 * n


def grams(text: bytes, width: int, buckets: int) -> np.ndarray:
    """The bucket of each byte n-gram (width 4 at most); a shorter text has none."""
    a = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
    n = len(a) - width + 1
    if n < 1:
        return np.empty(0, dtype=np.uint32)
    g = a[:n].copy()
    for k in range(1, width):
        g |= a[k : k + n] << np.uint32(8 * k)
    g *= np.uint32(2654435761)
    return g >> np.uint32(32 - buckets.bit_length() + 1)


def _labels(labels: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids of at most `most` labelled documents, lowest by hash, and their labels."""
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    rows = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).toArrow()
    ids, q = rows["doc_id"].to_numpy(), rows["quality"].to_numpy()
    order = np.argsort(ids)
    return ids[order], (q[order] > 0).astype(np.int32)


def _label_of(ids: pa.Array, known: np.ndarray, quality: np.ndarray) -> np.ndarray:
    """1 good, 0 bad, -1 unknown."""
    if not len(known):
        return np.full(len(ids), -1, dtype=np.int32)
    null = ids.is_null().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).to_numpy()
    at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
    return np.where((known[at] == ids) & ~null, quality[at], -1).astype(np.int32)


def _fit(batches: Iterable[pa.RecordBatch], known, quality, width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    target, raw = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
    for b in batches:
        for label, text in zip(_label_of(b["doc_id"], known, quality), texts(b["text"]), strict=True):
            g = grams(text, width, buckets)
            if len(g) < buckets // 8:
                np.add.at(raw, g, 1)
                if label == 1:
                    np.add.at(target, g, 1)
            else:
                c = np.bincount(g, minlength=buckets)
                raw += c
                target += c * (label == 1)
    at = np.flatnonzero(raw)
    yield batch(_COUNTS, bucket=at.astype(np.int32), target=target[at], raw=raw[at])


def _score(batches: Iterable[pa.RecordBatch], known, quality, target, raw, width: int, buckets: int, alpha: float) -> Iterator[pa.RecordBatch]:
    import xxhash

    all_target, all_raw = target.sum(), raw.sum()
    log_raw = np.log(raw + alpha) - math.log(all_raw + alpha * buckets)
    ratio = np.log(target + alpha) - math.log(all_target + alpha * buckets) - log_raw
    own = np.zeros(buckets, dtype=np.int32)
    for b in batches:
        labels, rows, digests, n_grams, scores = _label_of(b["doc_id"], known, quality), [], [], [], []
        for label, text in zip(labels, texts(b["text"]), strict=True):
            rows.append(base_stats(text))
            digests.append(xxhash.xxh3_64_intdigest(text) - (1 << 63))
            g = grams(text, width, buckets)
            n_grams.append(len(g))
            if not len(g):
                scores.append(0.0)
            elif label == 1:
                np.add.at(own, g, 1)
                left = target[g] - own[g]
                scores.append(float((np.log(left + alpha) - math.log(all_target - len(g) + alpha * buckets) - log_raw[g]).mean()))
                own[g] = 0
            else:
                scores.append(float(ratio[g].mean()))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        numbers = {"row": b["row"]} if "row" in b.schema.names else {}
        schema = _STATS.append(pa.field("row", pa.int64())) if numbers else _STATS
        yield batch(schema, doc_id=b["doc_id"], label=labels, digest=digests, n_grams=n_grams, score=scores, **numbers, **dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))


def cut(bins: list[tuple[int, int, int]], step: float, clean_cost: float) -> float | None:
    """The threshold from (bin, good, bad) counts of the score's histogram; None without both kinds."""
    bins = sorted(bins)
    good, bad = sum(x[1] for x in bins), sum(x[2] for x in bins)
    if not good or not bad:
        return None
    edges, lost, caught = [], 0, 0
    for k, (at, g, b) in enumerate(bins):
        low = bins[k - 1][0] + 1 if k else at - 1  # a cut anywhere in (low, at) rejects the same documents
        edges.append((clean_cost * lost + bad - caught, -(at - low), low, at))
        lost, caught = lost + g, caught + b
    _, _, low, at = min(edges)
    return (low + at) / 2 * step


def _copies_alike(scored: DataFrame) -> DataFrame:
    """The leave-one-out score of a text of the target for all its copies."""
    target = spool(scored.where("label = 1 AND n_grams > 0").groupBy("digest", "n_grams").agg(F.max("score").alias("own")), "quality-target")
    return scored.join(target, ["digest", "n_grams"], "left").select(*(F.coalesce("own", "score").alias(c) if c == "score" else F.col(c) for c in scored.columns))


def score(docs: DataFrame, labels: DataFrame, *, width: int = 4, buckets: int = 1 << 16, alpha: float = 0.5, most_labels: int = 200_000, clean_cost: float = 10.0, step: float = 1e-3, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per document: the base figures, base_failed, n_grams, score (mean log-likelihood ratio),
    threshold (null where none could be set) and kept; with row_col also that column (long), as row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    row = [F.col(f"`{row_col}`").alias("row")] if row_col else []
    docs, rows = documents(docs, id_col, text_col), docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *row)
    known = spark.sparkContext.broadcast(_labels(labels, most_labels))
    counts = docs.mapInArrow(lambda it: _fit(it, *known.value, width, buckets), "bucket int, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toArrow()
    target, raw = np.zeros(buckets), np.zeros(buckets)
    target[counts["bucket"].to_numpy()], raw[counts["bucket"].to_numpy()] = counts["target"].to_numpy(), counts["raw"].to_numpy()
    model = spark.sparkContext.broadcast((target, raw))
    fields = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, label int, digest long, n_grams long, score double" + (", row long" if row_col else "")
    scored = spool(rows.mapInArrow(lambda it: _score(it, *known.value, *model.value, width, buckets, alpha), fields), "quality")
    scored = _copies_alike(scored)
    seen = scored.where("label >= 0 AND NOT base_failed").groupBy(F.floor(F.col("score") / step).cast("int").alias("bin")).agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad"))
    at = cut([tuple(r) for r in seen.collect()], step, clean_cost)
    kept = ~F.col("base_failed") & ((F.col("score") >= at) if at is not None else F.lit(True))
    return scored.drop("label", "digest").withColumn("threshold", F.lit(at).cast("double")).withColumn("kept", kept)


def query(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_grams", "score")
