r"""Language-model scoring with a gated recurrent network, trained and run in numpy on the executors.

Tokens are words `[^\x20\x09-\x0D]+` (A-Z lower-cased) and one end for each document. Documents whose
crc32(doc_id as text) mod 5 is 1 are held out; all others are learned from.

Method: a GRU reads the previous token and its output softmax is factored into classes,
P(token) = P(class | state) * P(token | class, state). The `short` most frequent tokens form `classes`
classes of equal size, whose inner softmax also sees the state. All other words belong to one of the tail
classes by shape (last character, first accented character). Inside a tail class words are shared out as in the
base score: (c + 0.5) / (n + 0.5 * (v + 1)), with the class's own n and v, and an unknown word is one more type with
a count of 0. So what a score gains on its base comes from the network: from the classes and listed words that it
expects. The state is carried across windows over the whole document and is reset only at a document's start.

Training: truncated backpropagation through windows of `window` tokens with Adam. Every token of the training
documents is used once. In each of the rounds (a sixteenth, three sixteenths, three quarters of the documents, by
hash) every task trains a copy on its own documents, and the copies are averaged, weighted by tokens, by a
distributed sum over weight numbers. The weights are of fixed size, so what reaches the driver is, too.

Documents are encoded once, into a stored table of token numbers that training and scoring read.

Counts: word counts of all training tokens are pre-aggregated in each task and then summed by word. The
`head` most frequent words of at most 64 bytes, a fixed number, are broadcast; all others are looked up by a join of
(document, word) rows with the count table by 128-bit digests, in which long words that are a thousandth of all
tokens are broadcast as digests. So nothing broadcast grows with the vocabulary, and no key is hot.

Defined results: null text is empty: one token, the end; a null doc_id counts as the empty text (crc32 0,
learned from); repeated rows each count and each give a row; in a corpus without training documents every
token is unknown; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import batch, bounded_batches, documents, joined_evenly, lists, spaced_words, spool, table, texts

END = b"\n"  # no word holds a line end
_CLIP = 60.0
_ACCENTS, _ENDINGS = 6, 5
TAILS = _ACCENTS * _ENDINGS
_COUNTS = pa.schema([("word", pa.binary()), ("n", pa.int64())])
_ENCODED = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("held_out", pa.bool_()), ("known", pa.int64()), ("base", pa.float64()), ("inner", pa.float64()), ("ids", pa.list_(pa.int32())), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int32())), ("shapes", pa.list_(pa.int32()))])


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def shape(word: bytes) -> int:
    """The tail class of a word: its last byte's kind and its first character beyond ASCII."""
    last = word[-1]
    ending = 0 if last >= 128 or 97 <= last <= 122 else 1 if 48 <= last <= 57 else 2 if last == 46 else 3 if last == 44 else 4
    if word.isascii():
        return ending
    second = next(b for b in word if 128 <= b < 192)
    return ending + _ENDINGS * (1 + second % (_ACCENTS - 1))


class Vocabulary:
    """The head words with their counts, the totals of the corpus, and the factored output's layout."""

    def __init__(self, head: list[tuple[bytes, int]], n: int, v: int, tokens: np.ndarray, types: np.ndarray, short: int, classes: int):
        """head: by falling count; tokens, types: tokens and different words, by shape, of all words beyond
        `short`."""
        self.n, self.v, self.short, self.classes = n, v, short, classes
        self.size = short // classes
        self.ids = {w: k for k, (w, _) in enumerate(head)}
        self.counts = np.array([c for _, c in head], dtype=np.float64)
        total = n + 0.5 * (v + 1)
        self.log_total = math.log10(total)
        self.shapes = np.array([shape(w) if k >= short else 0 for k, (w, _) in enumerate(head)], dtype=np.int32)
        self.log_tail = np.log10(tokens + 0.5 * (types + 1.0))  # by tail class, of its smoothed counts
        # The first outputs are the classes of the shortlist, the others the tail classes.
        own = np.full(short, 0.5)
        own[: min(short, len(head))] = self.counts[:short] + 0.5
        by_class = own.reshape(classes, self.size)
        self.class_bias = np.log(np.concatenate([by_class.sum(1), tokens + 0.5])).astype(np.float32)
        self.word_bias = np.log(by_class / by_class.sum(1, keepdims=True)).astype(np.float32)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """For words and the end: model ids (shortlist, or short + shape), head ids (-1 beyond), words beyond the head."""
        words.append(END)
        head = np.fromiter(map(self.ids.get, words, repeat(-1)), dtype=np.int32, count=len(words))
        ids = head.copy()
        far = head >= self.short
        ids[far] = self.short + self.shapes[head[far]]
        beyond = np.flatnonzero(head < 0)
        rest = [words[k] for k in beyond.tolist()]
        ids[beyond] = [self.short + shape(w) if w is not END else self.short for w in rest]
        return ids, head, rest


class GRU:
    """Weights in one flat vector; forward, truncated backpropagation, log-probabilities."""

    def __init__(self, vocabulary: Vocabulary, hidden: int = 16, seed: int = 3):
        self.v, self.h = vocabulary, hidden
        s, c, k = vocabulary.short + TAILS, vocabulary.classes, vocabulary.size
        outputs = c + TAILS
        self.parts = {"G": (s, 3 * hidden), "U": (hidden, 3 * hidden), "C": (hidden, outputs), "c": (outputs,), "W": (c, hidden, k), "w": (c, k)}
        self.ones = np.ones(1 << 14, dtype=np.float32)
        self.flat = np.zeros(sum(math.prod(x) for x in self.parts.values()), dtype=np.float32)
        self.views = self.split(self.flat)
        r = np.random.default_rng(seed)
        self.views["G"][:] = r.normal(0, 0.3, self.parts["G"])
        self.views["G"][:, hidden : 2 * hidden] += 1.0  # to remember at first
        self.views["U"][:] = r.normal(0, 0.5 / math.sqrt(hidden), self.parts["U"])
        self.views["c"][:], self.views["w"][:] = vocabulary.class_bias, vocabulary.word_bias
        self.views["c"][:] -= self.views["c"].max()

    def ones_for(self, n: int) -> np.ndarray:
        if n > len(self.ones):
            self.ones = np.ones(2 * n, dtype=np.float32)
        return self.ones[:n]

    def split(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, dims in self.parts.items():
            n = math.prod(dims)
            out[name] = flat[at : at + n].reshape(dims)
            at += n
        return out

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """One step: new state, gates r and z, candidate, recurrent part of the candidate."""
        n = self.h
        a, u = self.views["G"][x], h @ self.views["U"]
        gates = 0.5 + 0.5 * np.tanh(0.5 * (a[:, : 2 * n] + u[:, : 2 * n]))
        r, z = gates[:, :n], gates[:, n:]
        un = u[:, 2 * n :]
        c = np.tanh(a[:, 2 * n :] + r * un)
        return c + z * (h - c), r, z, c, un

    def output(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probability of each target (of its class only, in a tail class); with grads also the
        slope by state, and the slopes of the output weights."""
        v, w = self.v, self.views
        inner = targets < v.short
        classes = np.where(inner, targets // v.size, v.classes + targets - v.short)
        # Clipped logits need no maximum; row sums by matrix product are faster than along a short axis.
        logits = np.clip(states @ w["C"] + w["c"], -_CLIP, _CLIP)
        rows = np.arange(len(targets))
        picked = logits[rows, classes]
        np.exp(logits, out=logits)
        sums = logits @ self.ones[: logits.shape[1]]
        logp = picked - np.log(sums)
        d_states = None
        if grads is not None:
            logits *= (-1.0 / sums)[:, None]
            logits[rows, classes] += 1.0
            grads["C"] += states.T @ logits
            grads["c"] += self.ones_for(len(logits)) @ logits
            d_states = logits @ w["C"].T
        order = np.argsort(classes, kind="stable")
        edges = np.searchsorted(classes[order], np.arange(v.classes + 1)).tolist()
        for k in range(v.classes):
            own = order[edges[k] : edges[k + 1]]
            if not len(own):
                continue
            s = states[own]
            q = np.clip(s @ w["W"][k] + w["w"][k], -_CLIP, _CLIP)
            at, hit = rows[: len(own)], targets[own] - k * v.size
            one = q[at, hit]
            np.exp(q, out=q)
            total = q @ self.ones[: v.size]
            logp[own] += one - np.log(total)
            if grads is not None:
                q *= (-1.0 / total)[:, None]
                q[at, hit] += 1.0
                grads["W"][k] += s.T @ q
                grads["w"][k] += self.ones_for(len(q)) @ q
                d_states[own] += q @ w["W"][k].T
        return logp, d_states

    def window(self, x: np.ndarray, y: np.ndarray, keep: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Truncated backpropagation over one window (steps, streams): slope of the mean log-likelihood, the
        state after it, and the log-likelihood."""
        steps, n = len(x), self.h
        seen = []
        states = np.empty((steps, *h.shape), dtype=np.float32)
        for t in range(steps):
            before = h * keep[t][:, None]
            h, *rest = self.step(x[t], before)
            seen.append((before, *rest))
            states[t] = h
        flat = np.zeros_like(self.flat)
        g = self.split(flat)
        logp, d = self.output(states.reshape(-1, n), y.reshape(-1), g)
        d = d.reshape(states.shape)
        da, du = np.empty((steps, h.shape[0], 3 * n), dtype=np.float32), np.empty((steps, h.shape[0], 3 * n), dtype=np.float32)
        dh = np.zeros_like(h)
        for t in range(steps - 1, -1, -1):
            before, r, z, c, un = seen[t]
            dh = dh + d[t]
            pre_c = dh * (1 - z) * (1 - c * c)
            da[t, :, :n] = pre_c * un * r * (1 - r)
            da[t, :, n : 2 * n] = dh * (before - c) * z * (1 - z)
            da[t, :, 2 * n :] = pre_c
            du[t, :, : 2 * n] = da[t, :, : 2 * n]
            du[t, :, 2 * n :] = pre_c * r
            dh = (dh * z + du[t] @ self.views["U"].T) * keep[t][:, None]
        g["U"] += np.concatenate([s[0] for s in seen]).T @ du.reshape(-1, 3 * n)
        ids = x.reshape(-1)
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.diff(ids[order], prepend=-1))
        g["G"][ids[order][first]] += np.add.reduceat(da.reshape(-1, 3 * n)[order], first, axis=0)
        flat /= len(ids)
        return flat, h, float(logp.sum())


class Trainer:
    """Adam over windows of a stream of documents."""

    def __init__(self, model: GRU, rate: float = 0.01, window: int = 16, streams: int = 256, enough: int = 1_000_000):
        self.model, self.rate, self.window, self.streams, self.enough = model, rate, window, streams, enough
        self.m, self.s = np.zeros_like(model.flat), np.zeros_like(model.flat)
        self.updates = self.tokens = self.waiting = 0
        self.docs: list[np.ndarray] = []

    def add(self, ids: np.ndarray, end: int) -> None:
        self.docs.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.enough:
            self.run(end)

    def run(self, end: int) -> None:
        if not self.waiting:
            return
        y = np.concatenate(self.docs)
        x = np.concatenate([[end], y[:-1]])
        keep = np.ones(len(y), dtype=np.float32)
        starts = np.cumsum([0, *map(len, self.docs[:-1])])
        x[starts], keep[starts] = end, 0
        self.tokens += len(y)
        self.docs, self.waiting = [], 0
        streams = max(1, min(self.streams, len(y) // (64 * self.window)))
        # Streams of equal length, or one token shorter: the last step has the first `more` streams only.
        length, more = divmod(len(y), streams)
        lengths = length + (np.arange(streams) < more)
        first = np.cumsum(lengths) - lengths
        h = np.zeros((streams, self.model.h), dtype=np.float32)
        for t in range(0, length, self.window):
            at = first[None, :] + np.arange(t, min(t + self.window, length))[:, None]
            h = self._step(x[at], y[at], keep[at], h)
        if more:
            at = first[None, :more] + length
            self._step(x[at], y[at], keep[at], h[:more])

    def _step(self, x: np.ndarray, y: np.ndarray, keep: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Adam with the slope of one window; the state behind it."""
        g, h, _ = self.model.window(x, y, keep, h)
        self.updates += 1
        np.clip(g, -0.05, 0.05, out=g)
        self.m += 0.1 * (g - self.m)
        self.s += 0.01 * (g * g - self.s)
        a, b = 1 - 0.9**self.updates, 1 - 0.99**self.updates
        self.model.flat += (self.rate / a) * self.m / (np.sqrt(self.s / b) + 1e-6)
        return h


def score_documents(model: GRU, docs: list[np.ndarray], end: int, slots: int = 1024, flush: int = 32) -> np.ndarray:
    """Natural log-likelihood of each whole document. Documents share slots one after the other; a slot's
    state is carried on from step to step and reset at a document's start."""
    total = np.zeros(len(docs))
    queue = [(0, k) for k in range(min(slots, len(docs)))]
    rows: list[list[int]] = [[] for _ in queue]
    for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
        load, k = heapq.heappop(queue)
        rows[k].append(d)
        heapq.heappush(queue, (load + len(docs[d]), k))
    rows.sort(key=lambda r: -sum(len(docs[d]) for d in r))
    loads = np.array([sum(len(docs[d]) for d in r) for r in rows])
    ends = np.concatenate([[0], np.cumsum(loads)])[:-1]
    y = np.concatenate([docs[d] for r in rows for d in r])
    owner = np.concatenate([np.full(len(docs[d]), d, dtype=np.int32) for r in rows for d in r])
    new = np.diff(owner, prepend=-1) != 0
    new[ends] = True
    x = np.concatenate([[end], y[:-1]])
    x[new] = end
    fresh = ~new
    h = np.zeros((len(rows), model.h), dtype=np.float32)
    states, places = [], []
    longest = int(loads[0])
    active = np.searchsorted(-loads, -np.arange(longest), side="left")
    for t in range(longest):
        a = int(active[t])
        at = ends[:a] + t
        h = model.step(x[at], h[:a] * fresh[at][:, None])[0]
        states.append(h), places.append(at)
        if len(states) == flush or t == longest - 1:
            p = np.concatenate(places)
            logp, _ = model.output(np.concatenate(states), y[p])
            total += np.bincount(owner[p], weights=logp, minlength=len(docs))
            states, places = [], []
    return total


# --- the distributed passes --------------------------------------------------------------------------


def _count(batches: Iterable[pa.RecordBatch], most: int = 400_000) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        b = batch(_COUNTS, word=list(seen.keys()), n=list(seen.values()))
        seen.clear()
        return b

    for b in batches:
        for text in texts(b["text"]):
            seen.update(spaced_words(text))
            seen[END] += 1
        if len(seen) > most:
            yield out()
    yield out()


def _encode(batches: Iterable[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Each document once: its ids, its base score and inner part as far as the head words give them, and the
    words beyond the head with counts and shapes."""
    from pyspark import TaskContext

    log_base = np.log10(vocabulary.counts + 0.5) - vocabulary.log_total
    log_count = np.log10(vocabulary.counts + 0.5)
    row = TaskContext.get().partitionId() << 33
    for b in batches:
        docs = b["doc_id"].to_pylist()
        ids, known, base, inner, words, counts, shapes = [], [], [], [], [], [], []
        for text in texts(b["text"]):
            x, head, rest = vocabulary.encode(spaced_words(text))
            head = head[head >= 0]
            far = head[head >= vocabulary.short]
            beyond = Counter(rest)
            ids.append(x), known.append(len(head)), base.append(float(log_base[head].sum()))
            inner.append(float((log_count[far] - vocabulary.log_tail[vocabulary.shapes[far]]).sum()))
            words.append(list(beyond.keys())), counts.extend(beyond.values()), shapes.extend(shape(w) if w != END else 0 for w in beyond)
        sizes = [len(w) for w in words]
        yield batch(
            _ENCODED, doc_id=b["doc_id"], row=np.arange(row, row + b.num_rows), held_out=[held_out(d) for d in docs], known=known, base=base, inner=inner, ids=lists(np.concatenate(ids), [len(x) for x in ids], pa.int32()),
            words=words, counts=lists(np.array(counts, dtype=np.int32), sizes, pa.int32()), shapes=lists(np.array(shapes, dtype=np.int32), sizes, pa.int32()),
        )
        row += b.num_rows


def _documents(column: pa.Array) -> list[np.ndarray]:
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _train(batches: Iterable[pa.RecordBatch], vocabulary: Vocabulary, weights: np.ndarray, options: dict) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("k", pa.int32()), ("value", pa.float64())])
    model = GRU(vocabulary, options["hidden"])
    model.flat[:] = weights
    trainer = Trainer(model, options["rate"], options["window"])
    end = vocabulary.ids.get(END, vocabulary.short)
    for b in batches:
        for ids in _documents(b["ids"]):
            trainer.add(ids, end)
    trainer.run(end)
    if trainer.tokens:
        values = np.append(model.flat.astype(np.float64) * trainer.tokens, trainer.tokens)
        yield batch(schema, k=np.arange(len(values), dtype=np.int32), value=values)


def _score(batches: Iterable[pa.RecordBatch], vocabulary: Vocabulary, weights: np.ndarray, options: dict) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("model", pa.float64())])
    model = GRU(vocabulary, options["hidden"])
    model.flat[:] = weights
    end = vocabulary.ids.get(END, vocabulary.short)
    held: list[pa.RecordBatch] = []
    ids: list[np.ndarray] = []

    def out() -> Iterator[pa.RecordBatch]:
        logs, at = score_documents(model, ids, end) / math.log(10), 0
        for b in held:
            part = slice(at, at + b.num_rows)
            yield batch(schema, **{k: b[k] for k in ("row", "doc_id", "held_out", "known", "base")}, n_tokens=[len(x) for x in ids[part]], model=logs[part] + b["inner"].to_numpy())
            at += b.num_rows

    waiting = 0
    for b in batches:
        here = _documents(b["ids"])
        ids += here
        held.append(b)
        waiting += sum(map(len, here))
        if waiting > 3_000_000:
            yield from out()
            held, ids, waiting = [], [], 0
    if ids:
        yield from out()


def score(docs: DataFrame, *, short: int = 1024, classes: int = 32, head: int = 200_000, hidden: int = 16, window: int = 16, rate: float = 0.01, trained: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10). Without
    `trained` the network stays as it begins: classes and words by their counts, whatever the state."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = documents(docs, id_col, text_col)
    options = {"hidden": hidden, "window": window, "rate": rate}
    learned = docs.where(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) != 1)
    counts = spool(learned.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    # The head: as many words as asked for, of at most 64 bytes each, so that what is broadcast has a bound.
    top = counts.where(F.length("word") <= 64).orderBy(F.desc("n"), "word").limit(head).toArrow()
    words = list(zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True))
    tokens, types, n, v = np.zeros(TAILS), np.zeros(TAILS), 0, 0
    for r in counts.mapInArrow(_by_shape, "shape int, types long, tokens long").groupBy("shape").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).collect():
        tokens[r["shape"]], types[r["shape"]] = r.tokens, r.types
        n, v = n + r.tokens, v + r.types
    for w, c in words[:short]:
        k = shape(w) if w != END else 0
        tokens[k] -= c
        types[k] -= 1
    vocabulary = Vocabulary(words, n, v, tokens, types, short, classes)
    sent = spark.sparkContext.broadcast(vocabulary)
    fields = "doc_id long, row long, held_out boolean, known long, base double, inner double, ids array<int>, words array<binary>, counts array<int>, shapes array<int>"
    encoded = spool(docs.mapInArrow(lambda it: _encode(it, sent.value), fields), "encoded")
    weights = GRU(vocabulary, hidden).flat
    deal = F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(16))
    for low, high in ((0, 1), (1, 4), (4, 16)) if trained else ():
        now = spark.sparkContext.broadcast(weights)
        part = encoded.where(~F.col("held_out") & deal.between(low, high - 1)).select("ids")
        summed = part.mapInArrow(lambda it, now=now: _train(it, sent.value, now.value, options), "k int, value double").groupBy("k").agg(F.sum("value").alias("value")).toArrow()
        if summed.num_rows:
            values = np.zeros(len(weights) + 1)
            values[summed["k"].to_numpy()] = summed["value"].to_numpy()
            weights = (values[:-1] / values[-1]).astype(np.float32)
    now = spark.sparkContext.broadcast(weights)
    scored = encoded.select("row", "doc_id", "held_out", "known", "base", "inner", "ids").mapInArrow(lambda it: _score(it, sent.value, now.value, options), "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double")
    rest = encoded.select("row", F.explode(F.arrays_zip("words", "counts", "shapes")).alias("x")).select("row", F.col("x.words").alias("w"), F.col("x.counts").alias("times"), (F.col("x.shapes") + 1).alias("k"))
    known, none = F.col("n").isNotNull(), F.lit(0.0)
    tail = F.element_at(F.array(*map(F.lit, vocabulary.log_tail.tolist())), F.col("k"))
    inner = F.log10(F.coalesce("n", F.lit(0)) + 0.5) - tail
    digest = lambda c: (F.xxhash64(c).alias("a"), F.xxhash64(F.lit(1), c).alias("b"))
    of = counts.select(*digest(F.col("word")), "n")
    found = joined_evenly(rest.select("row", "times", "k", *digest(F.col("w"))), ["a", "b"], of, "n", n).groupBy("row").agg(
        F.sum(F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 0.5) - vocabulary.log_total)).alias("base_part"),
        F.sum(F.col("times") * inner).alias("model_part"),
        F.sum(F.when(known, F.col("times")).otherwise(0)).alias("also_known"),
    ).withColumnRenamed("row", "r")
    base, model = F.col("base") + F.coalesce("base_part", none), F.col("model") + F.coalesce("model_part", none)
    out = scored.join(found, F.col("row") == F.col("r"), "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("also_known", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), model.alias("score"))


def _by_shape(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and tokens by shape."""
    types, tokens = (np.zeros(TAILS, dtype=np.int64) for _ in range(2))
    for b in batches:
        s = np.fromiter((0 if w == END else shape(w) for w in b["word"].to_pylist()), dtype=np.int64, count=b.num_rows)
        types += np.bincount(s, minlength=TAILS)
        tokens += np.bincount(s, weights=b["n"].to_numpy(), minlength=TAILS).astype(np.int64)
    schema = pa.schema([("shape", pa.int32()), ("types", pa.int64()), ("tokens", pa.int64())])
    yield batch(schema, shape=np.arange(TAILS, dtype=np.int32), types=types, tokens=tokens)


def query(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
