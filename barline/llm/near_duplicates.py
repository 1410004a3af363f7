r"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Method: a document is the set of its distinct `width`-word shingles. Under each of `permutations` hash
functions both the minimum and the maximum are kept, so a signature of 2 * permutations values costs half
the hash evaluations of plain MinHash, and min and max agreements are each an unbiased estimate of the
Jaccard similarity. Signatures are banded (`bands` of `rows` values, each band mixing minima and maxima of
different permutations). At similarity 0.8 a pair shares no band with probability (1 - 0.8^5)^40 = 1.3e-7.

Whole job without pairs of copies: documents with equal word sequences form a class (hash group-by with
partial aggregation), known by the number of one of its rows, and only classes go on. In every band bucket each
class has one pivot (the class with the most copies); connected components of the ties to pivots are candidate
clusters, which hold every pair that shares a bucket. Inside a cluster links are confirmed exactly, with numpy on
full sets: small clusters in one block, streamed by cluster; in a large one every class is first compared with the
cluster's hub, in slots of about `slot_hashes` shingles that each get the hub once, and only classes that remain
open are compared with the others, block by block with about `block_hashes` shingles a side. Pairs that are already
connected are skipped, as only components matter. No bucket, cluster or candidate is capped. Components come from a
distributed minimum-label iteration with pointer jumping; every round is stored in the shared folder.

Hot keys: classes, clusters, pivots and components with a thousandth of all rows or more, of which there are a
thousand at most, are joined by broadcast of their one row; everything else is joined by row numbers, which are
unique, or is bounded by the sizes of slots and blocks.

Shingles and texts are compared by 64-bit and 128-bit hashes.

Defined results: null or empty text has no shingle, links with nothing, component_id = doc_id, kept; a
null doc_id keeps its row and never becomes a component_id unless its whole component is null; repeated
rows each give a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import ROW, Numbers, batch, bounded_batches, joined_evenly, lists, numbered, release, sorted_groups, spaced_words, spool, table, texts, unspool

_SIGNED = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])
_SET = pa.schema([("node", pa.int64()), ("cluster", pa.int64()), ("copies", pa.int64()), ("n", pa.int64()), ("total", pa.int64()), ("hub", pa.int64()), ("hashes", pa.binary())])
_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])
_numbers = Numbers()


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of fewer words the whole sequence is one."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = _numbers.array(words)
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), dtype=np.uint64)
    for k in range(min(len(h), width)):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


class MinMax:
    """Signatures: for each permutation the minimum and the maximum; their bands as 64-bit keys."""

    def __init__(self, permutations: int, bands: int, rows: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.a = r.integers(0, 1 << 63, permutations, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.b = r.integers(0, 1 << 63, permutations, dtype=np.uint64)[:, None]
        # band j takes values j, j + bands, ... of minima followed by maxima: both kinds, of different permutations
        self.order = np.arange(bands)[:, None] + bands * np.arange(rows)[None, :]
        self.salt = r.integers(0, 1 << 63, bands, dtype=np.uint64)
        assert bands * rows <= 2 * permutations

    def signature(self, s: np.ndarray, step: int = 2048) -> np.ndarray:
        low = high = None
        for k in range(0, len(s), step):
            h = self.a * s[None, k : k + step] + self.b
            a, z = h.min(axis=1), h.max(axis=1)
            low, high = (a, z) if low is None else (np.minimum(low, a), np.maximum(high, z))
        return np.concatenate([low, high])

    def keys(self, s: np.ndarray) -> np.ndarray:
        parts = self.signature(s)[self.order]
        key = self.salt.copy()
        for k in range(parts.shape[1]):
            key = (key ^ parts[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
        return key.view(np.int64)


def _sign(batches: Iterable[pa.RecordBatch], width: int, minmax: MinMax) -> Iterator[pa.RecordBatch]:
    import xxhash

    none = np.empty(0, dtype=np.int64)
    for b in batches:
        n, digests, bands = [], [], []
        for text in texts(b["text"]):
            words = spaced_words(text)
            s = shingles(words, width)
            n.append(len(s)), digests.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None), bands.append(minmax.keys(s) if len(s) else none)
        yield batch(_SIGNED, doc_id=b["doc_id"], row=b["row"], n_shingles=n, digest=digests, bands=lists(np.concatenate(bands), [len(x) for x in bands], pa.int64()))
    release(_numbers)


def _sets(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The full set of each class's text."""
    for b in batches:
        yield batch(_SET, **{k: b[k] for k in _SET.names[:-1]}, hashes=[shingles(spaced_words(t), width).tobytes() for t in texts(b["text"])])
    release(_numbers)


class _Block:
    """Shingle sets numbered together, for many exact comparisons."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.ends = np.concatenate([[0], np.cumsum(self.sizes)])
        values, self.codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.values, self.flag = values, np.zeros(len(values) + 1, dtype=np.int64)

    def linked(self, s: np.ndarray, percent: int, first: int = 0) -> np.ndarray:
        """Which of the block's sets, from `first` on, have 100 * intersection >= percent * union with s."""
        at = np.searchsorted(self.values, s)
        at = at[(at < len(self.values)) & (self.values[np.minimum(at, len(self.values) - 1)] == s)]
        self.flag[at] = 1
        lo = self.ends[first]
        common = np.add.reduceat(self.flag[self.codes[lo:]], self.ends[first:-1] - lo)
        self.flag[at] = 0
        return np.flatnonzero(100 * common >= percent * (self.sizes[first:] + len(s) - common)) + first


def spanning_links(names: list, sets: list[np.ndarray], percent: int, asks: list[bool] | None = None) -> Iterator[tuple]:
    """Links that connect all that is connected among some sets (exact; pairs already connected are not
    compared). asks: which sets are compared with all; the others only answer."""
    if len(sets) < 2:
        return
    block, parent = _Block(sets), list(range(len(sets)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    groups = len(sets)
    for k, s in enumerate(sets):
        if groups == 1:
            return
        if asks is None or asks[k]:
            for other in block.linked(s, percent, k + 1 if asks is None else 0) if asks is not None or k + 1 < len(sets) else ():
                a, b = root(k), root(int(other))
                if a != b:
                    parent[b] = a
                    groups -= 1
                    yield names[k], names[int(other)]


def _confirm(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Confirmed links of each (cluster, a, b) block, out of rows sorted by it; hubs come first."""
    found: list[tuple] = []
    for _, rows in sorted_groups(batches, ["cluster", "a", "b"]):
        rows.sort(key=lambda r: (-r["copies"], r["node"]))
        one: dict[int, dict] = {}
        for r in rows:  # an open class is there both to ask and to answer
            one.setdefault(r["node"], r)["asks"] |= r["asks"]
        rows = list(one.values())
        asks = None if all(r["asks"] for r in rows) else [r["asks"] for r in rows]
        found += spanning_links([r["node"] for r in rows], [np.frombuffer(r["hashes"], dtype=np.uint64) for r in rows], percent, asks)
        if len(found) > 10_000:
            yield batch(_LINKS, u=[u for u, _ in found], v=[v for _, v in found])
            found = []
    if found:
        yield batch(_LINKS, u=[u for u, _ in found], v=[v for _, v in found])


def _with_hub(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links with the hub, out of rows sorted by cluster and slot, in each of which the hub comes first."""
    hub, block = None, None
    for b in batches:
        u, v = [], []
        for is_hub, node, hashes in zip(b["is_hub"].to_pylist(), b["node"].to_pylist(), b["hashes"].to_pylist(), strict=True):
            s = np.frombuffer(hashes, dtype=np.uint64)
            if is_hub:
                hub, block = node, _Block([s])
            elif len(block.linked(s, percent)):
                u.append(node), v.append(hub)
        yield batch(_LINKS, u=u, v=v)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of an undirected link table (u, v) of longs reaches.
    Minimum labels spread along links, then along labels, until nothing changes: a number of rounds that grows with
    the logarithm of a component's length. Nodes with many links and labels with many nodes are joined evenly."""
    both = spool(links.select("u", "v").union(links.select("v", "u")).where("u <> v").distinct(), "links")
    labels = spool(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("component"), F.count("*").alias("degree")), "labels")
    n_links, n_nodes = both.count(), labels.count()
    for _ in range(most_rounds):
        of = labels.select(F.col("node").alias("v"), "component", "degree")
        near = joined_evenly(both, ["v"], of, "degree", n_links).groupBy("u").agg(F.min("component").alias("near"))
        low = labels.join(near, F.col("node") == F.col("u"), "left").select("node", F.least("component", "near").alias("component"), "degree", F.col("component").alias("before"))
        low = spool(low, "labels")
        jump = low.select(F.col("node").alias("at"), F.col("component").alias("further"))
        held = low.groupBy("component").agg(F.count("*").alias("members")).join(jump, F.col("component") == F.col("at")).drop("at")
        after = joined_evenly(low, ["component"], held, "members", n_nodes)
        after = spool(after.select("node", F.least("component", "further").alias("component"), "degree", "before"), "labels")
        changed = after.where("component <> before").limit(1).count()
        unspool(labels), unspool(low)
        labels = after.drop("before")
        if not changed:
            unspool(both)
            return labels.drop("degree")
    raise RuntimeError("components: no end after the allowed rounds")


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, permutations: int = 100, bands: int = 40, rows: int = 5, slot_hashes: int = 50_000, block_hashes: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id that confirmed links reach),
    kept (doc_id = component_id). Words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased. row_col: a column of row
    numbers as numbered() adds it, if there is one."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs if row_col else numbered(docs.select(f"`{id_col}`", *([f"`{text_col}`"] if text_col != id_col else [])))
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{row_col or ROW}`").alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    minmax = MinMax(permutations, bands, rows)
    signed = spool(docs.mapInArrow(lambda it: _sign(it, width, minmax), "doc_id long, row long, n_shingles long, digest binary, bands array<long>"), "signatures")
    # A class is known by the lowest number of its rows, which stands for it wherever its signature or text is read.
    classes = spool(signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("low"), F.count("*").alias("copies"), F.max("n_shingles").alias("n")), "classes")
    banded = signed.select("row", "bands").join(classes.select("node", "copies"), F.col("row") == F.col("node")).select("node", "copies", F.explode("bands").alias("bucket"))
    pivot = banded.groupBy("bucket").agg(F.max(F.struct("copies", "node")).alias("top"), F.count("*").alias("size")).where("size > 1").select(F.col("bucket").alias("b"), "top")
    # Of each class at most one pivot a band. Its highest pivot stands for all of them: the class is tied to it,
    # and so are the other pivots, which many classes share, so that the distinct ties are few.
    held = banded.join(pivot, F.col("bucket") == F.col("b")).where(F.col("node") != F.col("top.node")).groupBy("node").agg(F.collect_set("top").alias("tops")).withColumn("high", F.array_max("tops")["node"])
    others = held.select(F.explode("tops").alias("p"), "high").select(F.col("p.node").alias("u"), F.col("high").alias("v")).where("u <> v")
    ties = spool(held.select(F.col("node").alias("u"), F.col("high").alias("v")).union(others).distinct(), "ties")
    clusters = components(ties)
    unspool(ties)
    members = clusters.select("node", F.col("component").alias("cluster")).join(classes.select("node", "copies", "n"), "node")
    sizes = spool(members.groupBy("cluster").agg(F.sum("n").alias("total"), F.max(F.struct("copies", "node")).alias("top"), F.count("*").alias("members")), "sizes")
    wanted = joined_evenly(members, ["cluster"], sizes, "members", clusters.count()).select("node", "cluster", "copies", "n", "total", F.col("top.node").alias("hub"))
    full = spool(docs.select("row", "text").join(wanted, F.col("row") == F.col("node")).drop("row").mapInArrow(lambda it: _sets(it, width), "node long, cluster long, copies long, n long, total long, hub long, hashes binary"), "clusters")
    unspool(clusters), unspool(sizes)
    small = full.where(F.col("total") <= slot_hashes).select("cluster", F.lit(0).alias("a"), F.lit(0).alias("b"), "node", "copies", F.lit(True).alias("asks"), "hashes")
    large = full.where(F.col("total") > slot_hashes)
    blocks, found, done = small, None, [full]
    if not large.isEmpty():
        slots, slot = F.ceil(F.col("total") / slot_hashes).cast("int"), lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
        hubs = large.where("node = hub").select("cluster", F.explode(F.sequence(F.lit(0), slots - 1)).alias("slot"), "node", "hashes", F.lit(True).alias("is_hub"))
        others = large.where("node <> hub").select("cluster", slot(slots).alias("slot"), "node", "hashes", F.lit(False).alias("is_hub"))
        dealt = hubs.unionByName(others).repartition("cluster", "slot").sortWithinPartitions("cluster", "slot", F.desc("is_hub"))
        closed = spool(dealt.select("is_hub", "node", "hashes").mapInArrow(lambda it: _with_hub(it, percent), "u long, v long"), "closed")
        state = large.join(closed.select(F.col("u").alias("x")), F.col("node") == F.col("x"), "left").withColumn("open", F.isnull("x") & (F.col("node") != F.col("hub"))).drop("x", "hub")
        # Of clusters with an open class: how many blocks ask, and how many answer.
        # A few open classes go to more, smaller blocks: to as many as make them as large as the cluster itself.
        whole, asks = F.sum("n"), F.sum(F.when(F.col("open"), F.col("n")))
        nb = F.greatest(F.ceil(whole / block_hashes), F.least(F.ceil(whole / slot_hashes), F.ceil(whole / asks)))
        counts = state.groupBy("cluster").agg(nb.cast("int").alias("nb"), F.ceil(asks / block_hashes).cast("int").alias("na"), F.count("*").alias("members")).where("na > 0")
        state = spool(joined_evenly(state, ["cluster"], spool(counts, "open-counts"), "members", full.count()).where("na > 0"), "open")
        asking = state.where("open").select("cluster", slot(F.col("na")).alias("a"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"), "node", "copies", F.lit(True).alias("asks"), "hashes")
        answering = state.select("cluster", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("a"), slot(F.col("nb")).alias("b"), "node", "copies", F.lit(False).alias("asks"), "hashes")
        blocks = small.unionByName(asking).unionByName(answering)
        found = closed
        done += [closed, state]
    links = blocks.repartition("cluster", "a", "b").sortWithinPartitions("cluster", "a", "b").mapInArrow(lambda it: _confirm(it, percent), "u long, v long")
    links = spool(links if found is None else links.unionByName(found), "confirmed")
    for x in done:
        unspool(x)
    joined = components(links)
    unspool(links)
    low = joined.join(classes.select("node", "low"), "node")
    reached = low.groupBy("component").agg(F.min("low").alias("reached"), F.count("*").alias("members"))
    low = joined_evenly(low.select("node", "component"), ["component"], reached, "members", joined.count()).select(F.col("node").alias("member"), "reached")
    of_class = classes.join(low, F.col("node") == F.col("member"), "left").select(F.col("digest").alias("class"), "copies", F.coalesce("reached", "low").alias("reached"))
    of_class = spool(of_class, "reached")
    unspool(joined), unspool(classes)
    rows = signed.select("doc_id", "n_shingles", "digest")
    out = _by_class(rows.where("digest IS NOT NULL"), of_class, of_class.agg(F.sum("copies")).first()[0] or 0)
    out = out.union(rows.where("digest IS NULL").select("doc_id", "n_shingles", "doc_id"))  # without a shuffle
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _by_class(rows: DataFrame, of_class: DataFrame, total: int, share: int = 1000) -> DataFrame:
    """Each document with its class's component. Classes with a thousandth of all documents or more, of which
    there are a thousand at most, are broadcast; so no key of the shuffled join is hot."""
    large = F.col("copies") * share >= total
    hot = of_class.where(large).select(F.col("class").alias("hot"), F.col("reached").alias("hot_reached"))
    tried = rows.join(F.broadcast(hot), F.col("digest") == F.col("hot"), "left")
    rest = tried.where("hot IS NULL").join(of_class.where(~large), F.col("digest") == F.col("class"))
    return tried.where("hot IS NOT NULL").select("doc_id", "n_shingles", F.col("hot_reached").alias("component_id")).union(rest.select("doc_id", "n_shingles", "reached"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, of which one row of each component stays: that of the least id, null ids
    last. It is decided by row, so equal ids and null ids are rows like all others."""
    key = F.col(f"`{options.pop('id_col', 'doc_id')}`").cast("long")
    rows = numbered(docs)
    found = near_duplicates(rows, id_col=ROW, row_col=ROW, **options).select(F.col("doc_id").alias("_number"), "component_id")
    named = found.join(rows.select(ROW, key.alias("_id")), F.col("_number") == F.col(ROW))
    first = named.groupBy("component_id").agg(F.min(F.struct(F.isnull("_id").alias("null"), "_id", "_number")).alias("first")).select(F.col("first._number").alias("_stays"))
    return rows.join(first, F.col(ROW) == F.col("_stays"), "left_semi").drop(ROW)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


#: The query's rows in DuckDB: all pairs that share a shingle, then reachability.
SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, list_aggregate(ws[k : k + 3], 'string_agg', ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS k FROM doc WHERE len(ws) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), link AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN size x ON x.doc_id = p.a JOIN size y ON y.doc_id = p.b WHERE 100 * common >= 80 * (x.n + y.n - common)
), reach AS (
  SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), low AS (
  SELECT a AS doc_id, least(a, min(b)) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN low USING (doc_id)
"""
