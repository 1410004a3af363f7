r"""Token counts by section, by offset-mapped attribution.

A whole document is encoded once. The byte offsets of its tokens follow from the tokens' byte lengths (the
tokens of a byte-level vocabulary spell the text exactly) and become character spans; these are joined, as
intervals, with the spans of the document's sections. A token that lies in one section is that section's.
A token that crosses a boundary goes whole to one section by the rule `crossing`:
    "first"  the section in which it starts (default)
    "most"   the section that holds most of its characters, the earlier one of equals
    "split"  to each section by its share of the token's characters
A token's characters are those whose first byte it holds; a token without any (the rest of a character's
bytes) is counted where that character is. So the sections' counts always add up to the document's.

Sections of the query: paragraphs, that is lines, each with its line end; or any columns as fields, joined
by a line end (`field_counts`).

Defined results: null or empty text has no section and no row in `section_counts`, and a row with zeros in
`document_counts`; repeated rows each give their rows; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import batch, bounded_batches, documents, table, texts

_encodings: dict[tuple[str, str], ByteEncoder] = {}
RULES = ("first", "most", "split")


def vocabulary_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class ByteEncoder:
    def __init__(self, file: str, pattern: str):
        import tiktoken

        with open(file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.sizes[list(ranks.values())] = [len(t) for t in ranks]
        self.parts = pattern == split_pattern()

    def ends(self, text: bytes, step: int = 1 << 20) -> np.ndarray:
        """Byte offset of each token's end. Very long texts are encoded in parts cut between two words, where the
        known pattern never joins (a blank belongs to the word behind it); with any other pattern, as a whole."""
        out, at = [], 0
        while at < len(text):
            cut = len(text) if not self.parts or len(text) - at <= step else self._cut(text, at + step)
            ids = self.encoding.encode_ordinary(text[at:cut].decode())
            out.append(at + np.cumsum(self.sizes[ids]))
            at = cut
        return np.concatenate(out) if out else np.empty(0, dtype=np.int64)

    @staticmethod
    def _cut(text: bytes, at: int) -> int:
        """The next place from `at` on where an ASCII letter is followed by one blank and an ASCII letter."""
        while 0 <= (at := text.find(b" ", at)) < len(text) - 1:
            if text[at - 1 : at].isalpha() and text[at + 1 : at + 2].isalpha():
                return at
            at += 1
        return len(text)


def character_starts(text: bytes) -> np.ndarray:
    """Byte offset -> number of characters that start before it (one entry more than bytes)."""
    a = np.frombuffer(text, dtype=np.uint8)
    return np.concatenate([[0], np.cumsum((a & 0xC0) != 0x80)])


def attribute(ends: np.ndarray, chars: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section (float for "split") and how many of them cross a boundary. sections: ends in
    characters, ascending, the last being the text's end; each begins where the one before it ends."""
    starts = np.concatenate([[0], ends[:-1]])
    a, b = chars[starts], chars[ends]
    empty = a == b
    a = np.where(empty, np.maximum(a - 1, 0), a)
    b = np.maximum(b, a + 1)
    low, high = np.searchsorted(sections, a, side="right"), np.searchsorted(sections, b - 1, side="right")
    crosses = high > low
    n = len(sections)
    crossing = np.bincount(low[crosses], minlength=n)
    if rule == "first":
        return np.bincount(low, minlength=n).astype(np.float64), crossing
    counts = np.bincount(low[~crosses], minlength=n).astype(np.float64)
    for k in np.flatnonzero(crosses):
        edges = np.concatenate([[a[k]], sections[low[k] : high[k]], [b[k]]])
        share = np.diff(edges) / (b[k] - a[k])
        if rule == "split":
            counts[low[k] : high[k] + 1] += share
        else:
            counts[low[k] + int(np.argmax(share))] += 1
    return counts, crossing


def line_sections(text: bytes, chars: np.ndarray) -> np.ndarray:
    """Ends, in characters, of the lines, each with its line end."""
    marks = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 10) + 1
    if not len(marks) or marks[-1] != len(text):
        marks = np.append(marks, len(text))
    return chars[marks]


_SECTIONS = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.float64()), ("n_crossing", pa.int64())])


def _encoder(file: str, pattern: str) -> ByteEncoder:
    return _encodings.get((file, pattern)) or _encodings.setdefault((file, pattern), ByteEncoder(file, pattern))


def _count(batches: Iterable[pa.RecordBatch], file: str, pattern: str, rule: str) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(file, pattern)
    for b in batches:
        ids, number, starts, ends, tokens, crossing = [], [], [], [], [], []
        for doc, text in zip(b["doc_id"].to_pylist(), texts(b["text"]), strict=True):
            if text:
                chars = character_starts(text)
                s = line_sections(text, chars)
                n, c = attribute(encoder.ends(text), chars, s, rule)
                ids += [doc] * len(s)
                number.append(np.arange(len(s))), starts.append(np.concatenate([[0], s[:-1]])), ends.append(s), tokens.append(n), crossing.append(c)
        if ids:
            yield batch(_SECTIONS, doc_id=ids, section=np.concatenate(number).astype(np.int32), start=np.concatenate(starts), end=np.concatenate(ends), n_tokens=np.concatenate(tokens), n_crossing=np.concatenate(crossing))


def section_counts(docs: DataFrame, *, file: str | None = None, pattern: str | None = None, crossing: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line of each document: section (from 0), start and end in characters, n_tokens (double),
    n_crossing (tokens that start here and reach into a later line)."""
    if crossing not in RULES:
        raise ValueError(f"crossing: one of {RULES}")
    bounded_batches(docs.sparkSession)
    file, pattern = file or vocabulary_file(), pattern or split_pattern()
    return documents(docs, id_col, text_col).mapInArrow(lambda it: _count(it, file, pattern, crossing), "doc_id long, section int, start long, end long, n_tokens double, n_crossing long")


_DOCS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_sections", pa.int64()), ("n_crossing", pa.int64()), ("section_tokens", pa.list_(pa.float64()))])


def _per_document(batches: Iterable[pa.RecordBatch], file: str, pattern: str, rule: str) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(file, pattern)
    for b in batches:
        rows = []
        for text in texts(b["text"]):
            chars = character_starts(text)
            s, ends = line_sections(text, chars) if text else np.empty(0, dtype=np.int64), encoder.ends(text)
            n, c = attribute(ends, chars, s, rule) if text else (np.empty(0), np.empty(0, dtype=np.int64))
            rows.append((len(ends), len(s), int(c.sum()), n))
        yield batch(_DOCS, doc_id=b["doc_id"], **{k: [r[i] for r in rows] for i, k in enumerate(_DOCS.names[1:])})


def document_counts(docs: DataFrame, *, file: str | None = None, pattern: str | None = None, crossing: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_tokens, n_sections, n_crossing and the tokens of each line in order."""
    if crossing not in RULES:
        raise ValueError(f"crossing: one of {RULES}")
    bounded_batches(docs.sparkSession)
    file, pattern = file or vocabulary_file(), pattern or split_pattern()
    return documents(docs, id_col, text_col).mapInArrow(lambda it: _per_document(it, file, pattern, crossing), "doc_id long, n_tokens long, n_sections long, n_crossing long, section_tokens array<double>")


def field_counts(rows: DataFrame, fields: list[str], *, file: str | None = None, pattern: str | None = None, crossing: str = "first", id_col: str = "doc_id") -> DataFrame:
    """One row per row of `rows`: doc_id, n_tokens and tokens_<field> of the fields joined by line ends, each
    line end being its left field's. Null fields are empty."""
    bounded_batches(rows.sparkSession)
    file, pattern = file or vocabulary_file(), pattern or split_pattern()
    given = rows.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"f{k}") for k, c in enumerate(fields)))
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *((f"tokens_{c}", pa.float64()) for c in fields)])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(file, pattern)
        for b in batches:
            total, parts = [], []
            for values in zip(*(texts(b[f"f{k}"]) for k in range(len(fields))), strict=True):
                text = b"\n".join(values)
                chars = character_starts(text)
                sections = chars[np.minimum(np.cumsum([len(v) + 1 for v in values]), len(text))]
                ends = encoder.ends(text)
                total.append(len(ends)), parts.append(attribute(ends, chars, sections, crossing)[0] if text else np.zeros(len(fields)))
            yield batch(out, doc_id=b["doc_id"], n_tokens=total, **{f"tokens_{c}": [p[k] for p in parts] for k, c in enumerate(fields)})

    return given.mapInArrow(count, ", ".join(["doc_id long", "n_tokens long", *(f"`tokens_{c}` double" for c in fields)]))


def query(spark, sf_dir: str) -> DataFrame:
    return document_counts(table(spark, sf_dir, "documents"))
