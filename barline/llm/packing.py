"""Best-fit packing of token sequences by hierarchical residual packing.

Whole documents are encoded, given an end id, and only those longer than `capacity` are cut. The pieces go
to shards of about `shard_pieces` pieces by a hash of their row number; each shard packs its pieces best-fit,
longest first. Bins that are full enough (`full` of the capacity) are final. The underfull ones move on: groups of
`fan_in` shards are merged, each underfull bin being one item, and best-fit runs again, level by level up
to one root. Only bins travel up the tree, never pieces.

A task of the tree is bounded. After best-fit at most one bin of a node is at most half full, and two bins that
are more than half full never fit together. So a parent can join at most `fan_in` bins to such small ones, and of
bins that are equally full at most `fan_in` have to move on; all others are final without any loss. A node thus
gets at most fan_in * fan_in * capacity / 2 bins, whatever the corpus and its lengths.

Encoding: white space never joins two tokens of this vocabulary, so each run between blanks or line ends is
encoded once and kept; a text's ids are the joined ids of its runs. (Tests compare this with encoding whole texts,
over all letters of Unicode.)

Defined results: null text is empty: one piece that holds just the end id; repeated rows are packed as
often as they come (with the same doc_id and piece); an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import batch, bounded_batches, documents, release, spool, table, texts, unspool

CAPACITY, END_ID = 4096, 1
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_encoders: dict[str, WordEncoder] = {}


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Signs at the end of a run, behind a digit or a Latin letter whose lower case is one letter: tokens of their own.
#: (The lower case of U+0130 ends with a combining dot, which is a sign and joins those behind it.)
_SIGNS = re.compile("(?<=[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f])[.,!?:;*$%&#|]+(?=[ \n]|$)")
#: A-Z in front of what might be a mark that composes with the letter: some pairs compose only in lower case.
_COMPOSES = re.compile("[A-Z](?=[^\x00-\u02ff\u0370-\u0482\u1e00-\u206f])")


class WordEncoder:
    """Little-endian 32-bit ids of runs without blanks, kept for the runs seen before.

    A-Z are lower-cased, as the vocabulary's normalizer does (not in a text that may hold a special token, which
    is matched before that, or a letter with a mark that composes, which comes before that, too), and signs at a run's end are set apart, so that there are fewer different
    runs. New runs are encoded many in one call: the ids of a purely alphabetic run end with the one token
    that carries the word-end mark.
    """

    def __init__(self, file: str, most: int = 400_000, longest: int = 64):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.longest = Tokenizer.from_file(file), most, longest
        words = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, dtype=bool)
        self.ends[[k for w, k in words.items() if w.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _one_by_one(self, runs: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]

    def _together(self, words: list[str], step: int = 2000) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(words), step):
            part = words[k : k + step]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
            at = np.flatnonzero(self.ends[ids])
            if len(at) != len(part):
                out += self._one_by_one(part)
                continue
            data, cuts = ids.tobytes(), (4 * (at + 1)).tolist()
            out += [data[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        return out

    def _learn(self, new: list[str]) -> None:
        words = [r for r in new if r.isalpha()]
        others = [r for r in new if not r.isalpha()]
        self.known.update(zip(words, self._together(words), strict=True))
        self.known.update(zip(others, self._one_by_one(others), strict=True))

    @staticmethod
    def runs(text: bytes) -> list[str]:
        plain = text.decode()
        if "<|" not in plain and (text.isascii() or not _COMPOSES.search(plain)):
            plain = text.lower().decode()
        return _SIGNS.sub(r" \g<0>", plain).replace("\n", " ").split(" ")

    def ids(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text. Of very long runs none is kept."""
        runs = [self.runs(t) for t in texts]
        if len(self.known) >= self.most:
            self.known = {}
        known = self.known
        new = list({r for run in runs for r in run if r not in known})
        self._learn(new)
        for run in runs:
            yield b"".join(map(known.__getitem__, run))
        for r in new:
            if len(r) > self.longest:
                del known[r]


def _pieces(batches: Iterable[pa.RecordBatch], file: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    encoder = _encoders.get(file) or _encoders.setdefault(file, WordEncoder(file))
    end, step = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
    for b in batches:
        out: list[tuple] = []
        for doc, ids in zip(b["doc_id"].to_pylist(), encoder.ids(texts(b["text"])), strict=True):
            ids += end
            out += [(doc, k, at // 4, min(step, len(ids) - at) // 4, zlib.crc32(ids[at : at + step])) for k, at in enumerate(range(0, len(ids), step))]
        yield batch(_PIECES, **dict(zip(_PIECES.names, map(list, zip(*out, strict=True)) if out else [[]] * 5, strict=True)))
    release()


def pieces(docs: DataFrame, *, file: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The encoded documents, cut where longer than capacity: doc_id, piece, start, length, ids_crc32."""
    bounded_batches(docs.sparkSession)
    return documents(docs, id_col, text_col).mapInArrow(lambda it: _pieces(it, file, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """For lengths in descending order: each item's bin and offset, and how full each bin is. An item goes
    to the open bin with the least room that it fits in; among equals to the one opened last."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms = 0  # bit r: some bin has room r
    used: list[int] = []
    bins, offsets = [], []
    for n in lengths:
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            k = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            k, room = len(used), capacity
            used.append(0)
        bins.append(k), offsets.append(used[k])
        used[k] += n
        if room > n:
            open_bins[room - n].append(k)
            rooms |= 1 << (room - n)
    return bins, offsets, used


_LEAF = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, inner long, used long, shard long, moves boolean"
_NODE = "item long, bin long, shift long, used long, node long, moves boolean"


def moving(used: list[int], least: int, fan_in: int) -> np.ndarray:
    """Which bins go up to the parent: the underfull ones (below `least`), of equally full ones at most fan_in."""
    n = np.array(used, dtype=np.int64)
    order = np.argsort(n, kind="stable")
    first = np.searchsorted(n[order], n[order], side="left")
    out = np.zeros(len(n), dtype=bool)
    out[order] = np.arange(len(n)) - first < fan_in
    return out & (n < least)


def _pack_leaf(key, group: pa.Table, capacity: int, least: int, fan_in: int) -> pa.Table:
    shard = key[0].as_py()
    group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
    bins, offsets, used = best_fit(group["length"].to_pylist(), capacity)
    at = np.array(bins, dtype=np.int64)
    out = {c: group[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
    return pa.table(out | {"bin": (shard << 32) + at, "inner": pa.array(offsets, pa.int64()), "used": np.array(used, dtype=np.int64)[at], "shard": np.full(len(at), shard, dtype=np.int64), "moves": moving(used, least, fan_in)[at]})


def _pack_node(key, group: pa.Table, capacity: int, least: int, fan_in: int) -> pa.Table:
    """A merge: items are underfull bins; a new bin takes the number of its first member."""
    node = key[0].as_py()
    group = group.sort_by([("used", "descending"), ("bin", "ascending")])
    items = group["bin"].to_numpy()
    bins, offsets, used = best_fit(group["used"].to_pylist(), capacity)
    bins = np.array(bins, dtype=np.int64)
    first = np.zeros(len(used), dtype=np.int64)
    first[bins[::-1]] = items[::-1]
    return pa.table({"item": items, "bin": first[bins], "shift": pa.array(offsets, pa.int64()), "used": np.array(used, dtype=np.int64)[bins], "node": np.full(len(bins), node, dtype=np.int64), "moves": moving(used, least, fan_in)[bins]})


def pack(cut: DataFrame, *, capacity: int = CAPACITY, shard_pieces: int = 50_000, fan_in: int = 16, full: float = 0.995) -> DataFrame:
    """Adds sequence_id and offset to pieces. `cut` must be a stored table: it is read twice."""
    shards, least = max(1, -(-cut.count() // shard_pieces)), int(full * capacity)
    # Dealt by row number, not by id: equal or null ids don't meet in one shard. The numbers of a stored table's
    # rows are the same when a lost task is run again.
    leaf = cut.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))).groupBy("shard").applyInArrow(lambda k, t: _pack_leaf(k, t, capacity, least, fan_in), _LEAF)
    leaf = spool(leaf, "packed")
    if shards == 1:
        return leaf.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("inner").alias("offset"))
    left = leaf.where("moves").groupBy("bin").agg(F.first("used").alias("used"), F.first("shard").alias("node"))
    moved = None  # item -> where it lies now: (bin, shift)
    width = shards
    while width > 1:
        width = -(-width // fan_in)
        step = spool(left.withColumn("node", F.floor(F.col("node") / fan_in).cast("long")).groupBy("node").applyInArrow(lambda k, t: _pack_node(k, t, capacity, least, fan_in), _NODE), "merged")
        here = step.select("item", "bin", "shift")
        if moved is None:
            moved = here
        else:
            up = here.select(F.col("item").alias("_at"), F.col("bin").alias("_bin"), F.col("shift").alias("_shift"))
            moved = moved.join(up, F.col("bin") == F.col("_at"), "left").select("item", F.coalesce("_bin", "bin").alias("bin"), (F.col("shift") + F.coalesce("_shift", F.lit(0))).alias("shift"))
        left = step.where("moves").groupBy("bin").agg(F.first("used").alias("used"), F.first("node").alias("node"))
    to = moved.select(F.col("item").alias("_item"), F.col("bin").alias("_seq"), F.col("shift").alias("_shift"))
    return leaf.join(to, F.col("bin") == F.col("_item"), "left").select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("_seq", "bin").alias("sequence_id"), (F.col("inner") + F.coalesce("_shift", F.lit(0))).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, *, file: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    cut = spool(pieces(docs, file=file or tokenizer_file(), capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col), "pieces")
    out = pack(cut, capacity=capacity, **options)
    unspool(cut)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
