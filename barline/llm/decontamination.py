r"""Benchmark decontamination with a distributed positional inverted index.

The corpus is indexed once, in segments of at most `SEGMENT` documents that are built where the documents are
read: a segment is a row with the sorted dictionary of all its terms (by 64-bit hash), how often each occurs, and
the posting list of each (ascending positions on the segment's axis), as a Parquet table in the shared folder. The
index depends on no test set: `build_index` can be stored and given to `matches` for any set of items and
parameters, and all blocks of one set read the same index.

Test items become windows of `width` consecutive words. A segment's posting lists of test terms are looked up in
its dictionary. A window's terms are ordered from the rarest to the most frequent (corpus frequencies come from the
index itself), the posting list of the rarest is shifted by its offset in the window, and the shifted lists of the
others are intersected with it one after another. What is left are exact phrase matches; a second pass over the
same lists finds proximity matches (all distinct terms of a window within `slop` words of the rarest one).

Segments are by document, so no key of the corpus is shuffled and a hot source, document, word or passage stays
spread. The test set is taken in blocks of about `block_words` words, long items in overlapping parts; what is
broadcast is one block, never anything that grows with the corpus.

Defined results: null or empty text has no words and no hits; an item without words never matches; an
item shorter than `width` is one window; repeated rows each give a row; an empty test table gives zero
hits; an item with a null id is searched like all others and counts in the words hit and in contaminated, but
has no id to be listed; an item with null text is left out; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import ROW, SMALL_GROUPS, Numbers, batch, bounded_batches, documents, numbered, release, spool, table, texts, without

#: Lower-cases A-Z; keeps 0-9, a-z and bytes from 0x80; all else becomes a space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_INDEX = pa.schema([("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.binary()), ("terms", pa.binary()), ("counts", pa.binary()), ("positions", pa.binary())])
_HITS = pa.schema([("doc_id", pa.int64()), ("segment", pa.int64()), ("place", pa.int32()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string()))])
#: Documents of a segment.
SEGMENT = 256
_hashes = Numbers()
_COUNTS = pa.schema([("term", pa.int32()), ("n", pa.int64())])
#: Candidates that are intersected at once.
_CHUNK = 1 << 20


def words(text: bytes) -> list[bytes]:
    r"""Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of UTF-8 bytes after A-Z became a-z."""
    return text.translate(_WORD_BYTES).split()


class TestSet:
    """Windows of some test items: terms, and for each window its term ids, length and items."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int):
        self.width = width
        vocabulary: dict[bytes, int] = {}
        of: dict[tuple[int, ...], list[str]] = {}
        for item, text in items:
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words(text)]
            for k in range(max(1, len(ids) - width + 1)) if ids else ():
                at = of.setdefault(tuple(ids[k : k + width]), [])
                if item is not None and (not at or at[-1] != item):
                    at.append(item)
        self.items = list(of.values())
        #: Sorted hashes of the terms, and which term each is.
        hashes = Numbers(1 << 62).array(list(vocabulary))
        self.ids = np.argsort(hashes, kind="stable").astype(np.int32)
        self.hashes = hashes[self.ids]
        self.lengths = np.array([len(w) for w in of], dtype=np.int32)
        self.terms = np.full((len(of), width), -1, dtype=np.int32)
        for k, w in enumerate(of):
            self.terms[k, : len(w)] = w

    def rarest_first(self, frequency: np.ndarray) -> None:
        """Orders each window's (term, offset) pairs by corpus frequency; windows with a term that the corpus lacks go."""
        present = np.where(self.terms >= 0, frequency[self.terms] > 0, True).all(axis=1)
        keep = np.flatnonzero(present)
        self.items, self.lengths, terms = [self.items[k] for k in keep], self.lengths[keep], self.terms[keep]
        rank = np.where(terms >= 0, frequency[terms], np.iinfo(np.int64).max)
        order = np.argsort(rank, axis=1, kind="stable")
        self.terms, self.offsets = np.take_along_axis(terms, order, 1), order.astype(np.int32)


def _build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    segment = TaskContext.get().partitionId() << 33
    packed = lambda x: x.astype("<i4").tobytes()
    for b in batches:
        for at in range(0, b.num_rows, SEGMENT):
            part = b.slice(at, SEGMENT)
            ws = [words(t) for t in texts(part["text"])]
            terms = np.concatenate([_hashes.array(w) for w in ws])
            order = np.argsort(terms, kind="stable")
            terms = terms[order]
            first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.empty(0, dtype=np.int64)
            counts = np.diff(np.append(first, len(terms)))
            yield batch(_INDEX, segment=[segment], doc_ids=[part["doc_id"].to_pylist()], n_words=[packed(np.array([len(w) for w in ws]))], terms=[terms[first].astype("<u8").tobytes()], counts=[packed(counts)], positions=[packed(order)])
            segment += 1
    release(_hashes)


def _numbers(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype="<i4")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of all terms of all documents: one row a segment, with packed little-endian numbers."""
    bounded_batches(docs.sparkSession)
    return spool(documents(docs, id_col, text_col).mapInArrow(_build, _ddl(_INDEX)), "postings", SMALL_GROUPS)


def _looked_up(terms: bytes, test: TestSet) -> tuple[np.ndarray, np.ndarray]:
    """Of the test terms that a segment's dictionary holds: their places in it, and which they are."""
    own = np.frombuffer(terms, dtype="<u8")
    at = np.searchsorted(own, test.hashes)
    held = np.flatnonzero(own[np.minimum(at, len(own) - 1)] == test.hashes) if len(own) else np.empty(0, dtype=np.int64)
    return at[held], test.ids[held]


def _frequencies(index: DataFrame, test: TestSet) -> np.ndarray:
    """Occurrences of each test term in the whole corpus."""
    size = len(test.ids)
    sent = index.sparkSession.sparkContext.broadcast(test)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            for terms, counts in zip(b["terms"].to_pylist(), b["counts"].to_pylist(), strict=True):
                at, ids = _looked_up(terms, sent.value)
                total[ids] += _numbers(counts)[at]
        at = np.flatnonzero(total)
        yield batch(_COUNTS, term=at.astype(np.int32), n=total[at])

    out = np.zeros(size, dtype=np.int64)
    for term, n in index.select("terms", "counts").mapInArrow(add, _ddl(_COUNTS)).groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return out


class _Postings:
    """A segment's posting lists of the test terms, on an axis with gaps between documents that no window or slop
    can cross."""

    def __init__(self, row: dict, test: TestSet, gap: int):
        n_words = _numbers(row["n_words"]).astype(np.int64)
        ends = np.cumsum(n_words)
        self.base = gap + np.concatenate([[0], np.cumsum(n_words + gap)])
        at, ids = _looked_up(row["terms"], test)
        counts = _numbers(row["counts"])
        sizes, first = counts[at].astype(np.int64), (np.cumsum(counts) - counts)[at]
        where = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        place = _numbers(row["positions"])[where].astype(np.int64)
        doc = np.searchsorted(ends, place, side="right")
        place += self.base[doc] - (ends - n_words)[doc]
        term = np.repeat(ids, sizes)
        self.at = np.full(int(self.base[-1]) + gap, -1, dtype=np.int32)
        self.at[place] = term
        self.span = len(self.at)
        self.keys = term.astype(np.int64) * self.span + place
        self.keys.sort()

    def anchors(self, term: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Chunks of (window, place) over all places of each window's rarest term."""
        low = np.searchsorted(self.keys, term.astype(np.int64) * self.span)
        n = np.searchsorted(self.keys, (term.astype(np.int64) + 1) * self.span) - low
        ends = np.cumsum(n)
        for start in range(0, int(ends[-1]) if len(ends) else 0, _CHUNK):
            k = np.arange(start, min(start + _CHUNK, int(ends[-1])))
            window = np.searchsorted(ends, k, side="right")
            yield window, self.keys[low[window] + k - (ends[window] - n[window])] % self.span

    def phrases(self, test: TestSet) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of each exact occurrence: offset-adjusted lists, intersected from the rarest on."""
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for window, place in self.anchors(test.terms[:, 0]):
            start = place - test.offsets[window, 0]
            for k in range(1, test.width):
                term = test.terms[window, k]
                ok = (term < 0) | (self.at[start + test.offsets[window, k]] == term)
                window, start = window[ok], start[ok]
            found.append((window, start))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def near(self, test: TestSet, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, place of the rarest term) where every term of the window is within slop words of it."""
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for window, place in self.anchors(test.terms[:, 0]):
            for k in range(1, test.width):
                term = test.terms[window, k].astype(np.int64)
                first = np.searchsorted(self.keys, term * self.span + place - slop)
                key = self.keys[np.minimum(first, len(self.keys) - 1)]
                ok = (term < 0) | ((first < len(self.keys)) & (key >= term * self.span + place - slop) & (key <= term * self.span + place + slop))
                window, place = window[ok], place[ok]
            found.append((window, place))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _search(batches: Iterable[pa.RecordBatch], test: TestSet, slop: int) -> Iterator[pa.RecordBatch]:
    for row in (row for b in batches for row in b.to_pylist()):
        n = len(row["doc_ids"])
        starts: list[list[int]] = [[] for _ in range(n)]
        lengths: list[list[int]] = [[] for _ in range(n)]
        items: list[list[str]] = [[] for _ in range(n)]
        near: list[list[str]] = [[] for _ in range(n)]
        if len(test.terms) and len(row["terms"]):
            p = _Postings(row, test, max(test.width, 2 * slop) + 1)
            window, start = p.phrases(test)
            doc = np.searchsorted(p.base, start, side="right") - 1
            order = np.lexsort((window, start, doc))
            for d, s, w in zip(doc[order].tolist(), (start - p.base[doc])[order].tolist(), window[order].tolist(), strict=True):
                starts[d].append(s), lengths[d].append(int(test.lengths[w])), items[d].extend(test.items[w])
            window, place = p.near(test, slop)
            pairs = np.unique(np.stack([np.searchsorted(p.base, place, side="right") - 1, window]), axis=1)
            for d, w in pairs.T.tolist():
                near[d].extend(test.items[w])
        yield batch(_HITS, doc_id=row["doc_ids"], segment=np.full(n, row["segment"], dtype=np.int64), place=np.arange(n, dtype=np.int32), n_words=_numbers(row["n_words"]).astype(np.int64), starts=starts, lengths=lengths, items=[sorted(set(x)) for x in items], near_items=[sorted(set(x)) for x in near])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string", pa.bool_(): "boolean", pa.list_(pa.int32()): "array<int>", pa.list_(pa.int64()): "array<long>", pa.list_(pa.string()): "array<string>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


_PARTS = pa.schema([("item", pa.string()), ("words", pa.binary()), ("n", pa.int64())])


def _parts(batches: Iterable[pa.RecordBatch], longest: int, width: int) -> Iterator[pa.RecordBatch]:
    """Items in parts of at most `longest` words that overlap by a window less one word: no window is lost."""
    for b in batches:
        out = []
        for item, text in zip(b["item"].to_pylist(), texts(b["text"]), strict=True):
            ws = words(text)
            out += [(item, b" ".join(ws[k : k + longest]), len(ws[k : k + longest])) for k in range(0, max(1, len(ws) - width + 1), longest - width + 1) if ws]
        yield batch(_PARTS, **dict(zip(_PARTS.names, map(list, zip(*out, strict=True)) if out else [[]] * 3, strict=True)))


def matches(docs: DataFrame, items: DataFrame, *, width: int = 10, slop: int = 20, block_words: int = 500_000, reported: bool = False, index: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: `starts`/`lengths` (in words) of all exact window matches, `items` with an
    exact match and `near_items` with a proximity match, each sorted as strings. With `reported` it gives
    what report() makes of these rows. index: of build_index(docs), if there is one already."""
    spark = docs.sparkSession
    bounded_batches(spark)
    index = build_index(docs, id_col, text_col) if index is None else index
    given = items.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("text")).where("text IS NOT NULL")
    longest = max(block_words, 4 * width)
    parts = spool(given.mapInArrow(lambda it: _parts(it, longest, width), _ddl(_PARTS)), "items")
    blocks = 1 + (parts.agg(F.sum("n")).first()[0] or 0) // block_words
    found = []
    for k in range(blocks):
        part = parts.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k) if blocks > 1 else parts
        test = TestSet([(r.item, bytes(r.words)) for r in sorted(part.collect(), key=lambda r: (r.item or "", r.item is None, r.words))], width)
        test.rarest_first(_frequencies(index, test) if len(test.ids) else np.zeros(0, np.int64))
        sent = spark.sparkContext.broadcast(test)
        if blocks == 1 and reported:  # in the same Python worker
            return index.mapInArrow(lambda it, sent=sent: _report(_search(it, sent.value, slop)), _ddl(_REPORT))
        found.append(index.mapInArrow(lambda it, sent=sent: _search(it, sent.value, slop), _ddl(_HITS)))
    if blocks == 1:
        return found[0].drop("segment", "place")
    # Of several blocks: a document's rows are known by its place in the index, so that equal documents stay apart.
    merged = found[0]
    for x in found[1:]:
        merged = merged.unionByName(x)
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    one = merged.groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list(F.arrays_zip("starts", "lengths")).alias("at"), flat("items"), flat("near_items"))
    at = F.array_sort(F.flatten("at"))
    one = one.select("doc_id", "n_words", at["starts"].alias("starts"), at["lengths"].alias("lengths"), *(F.array_sort(F.array_distinct(c)).alias(c) for c in ("items", "near_items")))
    return report(one) if reported else one


_REPORT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("n_near_items", pa.int64())])


def _report(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = b.to_pylist()
        hit = []
        for r in rows:
            mark = np.zeros(r["n_words"] + 1, dtype=np.int32)
            if r["starts"]:
                s, n = np.array(r["starts"]), np.array(r["lengths"])
                np.add.at(mark, s, 1), np.add.at(mark, s + n, -1)
            hit.append(int((np.cumsum(mark) > 0).sum()))
        yield batch(_REPORT, doc_id=b["doc_id"], n_words=b["n_words"], n_hit=hit, n_items=[len(r["items"]) for r in rows], items_sha256=[hashlib.sha256(",".join(r["items"]).encode()).hexdigest() for r in rows], contaminated=[h > 0 for h in hit], n_near_items=[len(r["near_items"]) for r in rows])


def report(found: DataFrame) -> DataFrame:
    """Per document: how many words lie inside a match, and which items match (count and digest)."""
    return found.mapInArrow(_report, _ddl(_REPORT))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, that share no window with the test items, whatever their ids."""
    options.pop("id_col", None)
    rows = numbered(docs)
    return without(rows, matches(rows, items, reported=True, id_col=ROW, **options).where("contaminated").select(F.col("doc_id").alias(ROW)))


def query(spark, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), reported=True)


#: The query's rows in DuckDB: windows by position, exact matches by list, near matches by posting joins.
SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, ws[k : k + 9] AS w FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS k FROM item WHERE len(ws) > 0)
), pos AS (
  SELECT doc_id, k AS p, ws[k] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM doc)
), freq AS (
  SELECT word, count(*) AS n FROM pos GROUP BY word
), hit AS (
  SELECT DISTINCT pos.doc_id, item_id, p, len(w) AS n FROM win JOIN pos ON win.w[1] = pos.word JOIN doc ON doc.doc_id = pos.doc_id WHERE doc.ws[p : p + len(w) - 1] = w
), hit_words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
), term AS (
  SELECT w, t, len(list_distinct(w)) AS n FROM (SELECT DISTINCT w, unnest(list_distinct(w)) AS t FROM win)
), rarest AS (
  SELECT w, min_by(t, ROW(coalesce(freq.n, 0), list_position(w, t))) AS t FROM term LEFT JOIN freq ON term.t = freq.word GROUP BY w
), near AS (
  SELECT w, a.doc_id, a.p FROM rarest JOIN pos a ON a.word = rarest.t JOIN term USING (w) JOIN pos b ON b.doc_id = a.doc_id AND b.word = term.t AND b.p BETWEEN a.p - 20 AND a.p + 20
  GROUP BY w, a.doc_id, a.p, term.n HAVING count(DISTINCT b.word) = term.n
), near_items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n FROM near JOIN win USING (w) GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(near_items.n, 0) AS n_near_items
FROM doc LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id) LEFT JOIN near_items USING (doc_id)
"""
