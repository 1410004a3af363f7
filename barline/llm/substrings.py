r"""Substring deduplication by content-defined chunking.

A gear rolling hash runs over the UTF-8 bytes of each text (32 bits, so it depends on the last 32 bytes
only). A chunk ends where the hash's top bits are zero, `average` bytes apart on average, but not before
`smallest` bytes; where none comes within `largest`, it ends at the lowest hash on the way (a content-defined
place, too, so that periodic texts are cut at the same phase). As boundaries depend on content, an insertion shifts only the
chunks around it, and a passage that is repeated elsewhere is cut there in the same way after its first
boundary. Chunks are deduplicated by a 128-bit digest: the first occurrence in the order (doc_id, place)
stays, all others are repeats. A run of adjacent chunks that all occur twice or more is a repeated passage
if it is at least `passage` bytes long; single chunks that happen to recur don't count.

The digests are counted by group-by with partial aggregation, joined back on the digest and gathered by
document. No group is collected: of a digest only its count and its first place travel. Digests that hold a
thousandth of all chunks or more, of which there are a thousand at most, are broadcast, so that no key of the
shuffled join is hot.

Defined results: null or empty text has no chunks; a null doc_id sorts before all others; repeated rows are
copies of each other like any two documents; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import batch, bounded_batches, documents, joined_evenly, lists, spool, table, texts

_GEAR = np.random.default_rng(41).integers(0, 1 << 32, 256, dtype=np.uint32)
_CHUNKS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_bytes", pa.int64()), ("ends", pa.list_(pa.int32())), ("digests", pa.binary())])


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - j]] << j for j below 32, by doubling."""
    h = _GEAR[data]
    for j in (1, 2, 4, 8, 16):
        if j < len(h):
            more = h.copy()
            more[j:] += h[:-j] << np.uint32(j)
            h = more
    return h


def boundaries(text: bytes, average: int, smallest: int, largest: int) -> np.ndarray:
    """Ends of the chunks, ascending; the last is the text's end."""
    n = len(text)
    if not n:
        return np.empty(0, dtype=np.int32)
    bits = average.bit_length() - 1
    h = gear(np.frombuffer(text, dtype=np.uint8))
    marks = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    out, last = [], 0
    for m in [*marks.tolist(), n]:
        while m - last > largest:
            last += smallest + int(h[last + smallest - 1 : last + largest].argmin())
            out.append(last)
        if m - last >= smallest or m == n:
            if m > last:
                out.append(m)
            last = m
    return np.array(out, dtype=np.int32)


def _chunk(batches: Iterable[pa.RecordBatch], average: int, smallest: int, largest: int) -> Iterator[pa.RecordBatch]:
    import xxhash
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 33
    for b in batches:
        sizes, ends, digests = [], [], []
        for text in texts(b["text"]):
            e = boundaries(text, average, smallest, largest)
            cuts = e.tolist()
            sizes.append(len(text)), ends.append(e)
            digests.append(b"".join(xxhash.xxh3_128_digest(text[x:y]) for x, y in zip([0, *cuts], cuts, strict=False)))
        yield batch(_CHUNKS, doc_id=b["doc_id"], row=np.arange(row, row + b.num_rows), n_bytes=sizes, ends=lists(np.concatenate(ends), [len(x) for x in ends], pa.int32()), digests=digests)
        row += b.num_rows


def _exploded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk: its digest as two numbers, its row and its place."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("k", pa.int32())])
    for b in batches:
        n = np.diff(b["ends"].offsets.to_numpy())
        pairs = np.frombuffer(b"".join(b["digests"].to_pylist()), dtype=np.int64).reshape(-1, 2)
        at = np.repeat(np.arange(b.num_rows), n)
        first = np.concatenate([[0], np.cumsum(n)])[:-1]
        yield batch(schema, a=np.ascontiguousarray(pairs[:, 0]), b=np.ascontiguousarray(pairs[:, 1]), doc_id=b["doc_id"].take(pa.array(at)), row=b["row"].to_numpy()[at], k=(np.arange(len(at)) - first[at]).astype(np.int32))


def passages(ends: np.ndarray, repeated: np.ndarray, passage: int) -> list[tuple[int, int]]:
    """Byte spans of runs of repeated chunks that are long enough."""
    starts = np.concatenate([[0], ends[:-1]])
    edge = np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]]))
    return [(int(starts[a]), int(ends[b - 1])) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True) if ends[b - 1] - starts[a] >= passage]


_OUT = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in ("n_bytes", "n_chunks", "n_repeated_chunks", "n_dropped_chunks", "repeated_bytes")), ("has_repeat", pa.bool_()), ("spans", pa.string()), ("kept_bytes", pa.int64())])


def _summary(batches: Iterable[pa.RecordBatch], passage: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for r in b.to_pylist():
            ends = np.array(r["ends"], dtype=np.int64)
            twice, later = np.zeros(len(ends), dtype=bool), np.zeros(len(ends), dtype=bool)
            twice[[*(r["firsts"] or []), *(r["laters"] or [])]] = True
            later[r["laters"] or []] = True
            spans = passages(ends, twice, passage)
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            inside = np.zeros(len(ends), dtype=bool)
            for s, e in spans:
                inside |= (starts >= s) & (ends <= e)
            dropped = inside & later
            out.append((r["doc_id"], r["n_bytes"], len(ends), int(twice.sum()), int(dropped.sum()), sum(e - s for s, e in spans), bool(spans), ",".join(f"{s}:{e}" for s, e in spans), int((ends - starts)[~dropped].sum())))
        yield batch(_OUT, **dict(zip(_OUT.names, map(list, zip(*out, strict=True)) if out else [[]] * len(_OUT.names), strict=True)))


def repeated_substrings(docs: DataFrame, *, average: int = 32, smallest: int = 16, largest: int = 256, passage: int = 96, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_bytes, n_chunks, n_repeated_chunks, n_dropped_chunks (later occurrences within
    repeated passages), repeated_bytes, has_repeat, spans of the passages (start:end in bytes) and
    kept_bytes (bytes that stay when later occurrences are dropped)."""
    bounded_batches(docs.sparkSession)
    docs = documents(docs, id_col, text_col)
    chunks = spool(docs.mapInArrow(lambda it: _chunk(it, average, smallest, largest), "doc_id long, row long, n_bytes long, ends array<int>, digests binary"), "chunks")
    one = chunks.select("doc_id", "row", "ends", "digests").mapInArrow(_exploded, "a long, b long, doc_id long, row long, k int")
    place = F.struct("doc_id", "row", "k")
    seen = spool(one.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1"), "repeated")
    total = chunks.agg(F.sum(F.size("ends"))).first()[0] or 0
    again = joined_evenly(one, ["a", "b"], seen, "n", total).where("n IS NOT NULL")
    here = F.col("row").eqNullSafe(F.col("first.row")) & (F.col("k") == F.col("first.k"))
    marks = again.groupBy("row").agg(F.collect_list(F.when(here, F.col("k"))).alias("firsts"), F.collect_list(F.when(~here, F.col("k"))).alias("laters")).withColumnRenamed("row", "r")
    joined = chunks.join(marks, F.col("row") == F.col("r"), "left").select("doc_id", "n_bytes", "ends", "firsts", "laters")
    fields = "doc_id long, n_bytes long, n_chunks long, n_repeated_chunks long, n_dropped_chunks long, repeated_bytes long, has_repeat boolean, spans string, kept_bytes long"
    return joined.mapInArrow(lambda it: _summary(it, passage), fields)


def query(spark, sf_dir: str) -> DataFrame:
    return repeated_substrings(table(spark, sf_dir, "documents"))
