"""Helpers shared by the training-data operators: shared-folder tables, Arrow columns, words."""

from __future__ import annotations

import atexit
import itertools
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one batch, whichever is reached first.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20
_own_folder: list[str] = []
_stored: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes from Parquet and to Python, so that long
    texts add up neither in the JVM's column vectors nor in a worker. Results are lazy, so these settings of the
    session stay; they change sizes of batches, no results. Smaller values that are set already are kept."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.parquet.columnarReaderBatchSize", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, as in tests, a temporary one, if all tasks
    run in this process; on a cluster other machines couldn't read that."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="barline-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return _own_folder[0]


#: Row groups of a few MB even where a row is large: a reader holds one of them.
SMALL_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}


def spool(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: cuts the lineage, and any
    executor that is lost later costs only a re-read. What unspool() doesn't delete goes with the session's end."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/barline/{name}-{uuid.uuid4().hex}"
    if not _stored:
        atexit.register(_forget)
    _stored.add(path)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _forget() -> None:
    """At the end of the driver's process, while its session lives: lazy results may have read these until now."""
    spark = SparkSession.getActiveSession()
    while spark is not None and _stored:
        _delete(spark, _stored.pop())


def unspool(df: DataFrame) -> None:
    """Deletes the files of a table made by spool(), once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/barline/" in folder:
            _delete(df.sparkSession, folder)
            _stored.difference_update([p for p in _stored if folder.endswith(p.rsplit("/", 1)[-1])])


#: The column that numbered() adds.
ROW = "_row"


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number of its own for each row, the same in every read of it: the file's number and the row's
    place in it where docs is a Parquet table as stored; everything else is stored first."""
    spark = docs.sparkSession
    try:
        stored = docs._jdf.queryExecution().analyzed().children().isEmpty() and docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:  # no file
        stored = None
    if not stored:
        return spool(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    names = sorted(r.file_path for r in stored.select("file_path").distinct().collect())
    files = spark.createDataFrame(list(enumerate(names)), "_k long, _name string")
    placed = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    number = F.shiftleft("_k", 40) + F.col("_at")
    return placed.join(F.broadcast(files), F.col("_file") == F.col("_name")).select(*(F.col(f"`{c}`") for c in docs.columns), number.alias(ROW))


def without(rows: DataFrame, drop: DataFrame) -> DataFrame:
    """Of numbered rows those whose number isn't in drop, without the number."""
    return rows.join(drop.select(F.col(ROW).alias("_drop")), F.col(ROW) == F.col("_drop"), "left_anti").drop(ROW)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, by name; other columns, whatever their names, are left out."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch; Python lists, numpy arrays and Arrow arrays are taken as columns."""
    arrays = [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, type=f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def lists(values: np.ndarray, sizes: Iterable[int], kind: pa.DataType) -> pa.Array:
    """A list column out of concatenated values and the length of each row's part."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


#: Lower-cases A-Z and leaves every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def spaced_words(text: bytes) -> list[bytes]:
    r"""Words `[^\x20\x09-\x0D]+` of UTF-8 bytes, A-Z lower-cased."""
    return text.translate(LOWER).split()


class Numbers(dict):
    """Word -> 64-bit hash, worked out once for each word; emptied when it holds too many."""

    def __init__(self, most: int = 200_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        n = self[word] = xxhash.xxh3_64_intdigest(word)
        return n

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def release(*caches: dict) -> None:
    """At a task's end: a worker lives on for other tasks, but not what this one gathered."""
    for c in caches:
        c.clear()
    pa.default_memory_pool().release_unused()


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Groups of rows with equal keys out of batches sorted by them."""
    rows = (row for b in batches for row in b.to_pylist())
    for key, group in itertools.groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
        yield key, list(group)


def joined_evenly(rows: DataFrame, keys: list[str], of: DataFrame, weight: str, total: int, share: int = 1000) -> DataFrame:
    """rows with the other columns of `of` (one row for each value of the long columns `keys`; nulls where there is
    none), though one key may hold any part of the rows. weight: the column of `of` with a key's share of `total`.
    Keys with a thousandth or more, of which there are a thousand at most, are broadcast; their rows pass the
    shuffled join of all others under numbers of their own, and what they meet there is left out."""
    large = F.col(weight) * share >= total
    names = [c for c in of.columns if c not in keys]
    hot = of.where(large).select(F.lit(True).alias("_hot"), *(F.col(k).alias(f"_hot_{k}") for k in keys), *(F.col(c).alias(f"_hot_{c}") for c in names))
    rest = of.where(~large).select(*(F.col(k).alias(f"_rest_{k}") for k in keys), *(F.col(c).alias(f"_rest_{c}") for c in names))
    tried = rows.join(F.broadcast(hot), reduce(and_, (F.col(k) == F.col(f"_hot_{k}") for k in keys)), "left")
    own = F.when(F.col("_hot"), F.monotonically_increasing_id()).otherwise(F.col(keys[0]))
    on = reduce(and_, (F.col("_own" if k == keys[0] else k) == F.col(f"_rest_{k}") for k in keys))
    out = tried.withColumn("_own", own).join(rest, on, "left")
    return out.select(*rows.columns, *(F.when(F.col("_hot"), F.col(f"_hot_{c}")).otherwise(F.col(f"_rest_{c}")).alias(c) for c in names))
