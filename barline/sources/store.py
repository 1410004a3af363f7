"""Stores: a bar cache, content-addressed tables, run bundles, a run index, factor ranks, an audit log.

All are Parquet folders on any file system that Spark reads. Rows replace others by key through partition
overwrite (dynamic mode) or a latest-wins view; readers prune by partition.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from barline.schema import BARS, EQUITY, TRADES


def canonical_key(**parts) -> str:
    """SHA-256 of the parts as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _files(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _files(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _files(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def _replace(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


class BarCache:
    """Bars by provider, symbol, interval and range."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self, provider: str, symbol: str, interval: str, start: str, end: str) -> str:
        return f"{self.path}/{canonical_key(provider=provider, symbol=symbol.upper(), interval=interval, start=start, end=end)}"

    def get(self, *key: str) -> DataFrame | None:
        """The bars; None where there are none or they can't be read."""
        if not self.has(*key):
            return None
        try:
            return self.spark.read.schema(BARS).parquet(self._folder(*key))
        except AnalysisException:
            return None

    def has(self, *key: str) -> bool:
        return exists(self.spark, self._folder(*key) + "/_SUCCESS")

    def put(self, bars: DataFrame, *key: str) -> None:
        bars.write.mode("overwrite").parquet(self._folder(*key))

    def clear(self) -> None:
        delete(self.spark, self.path)


def content_digest(df: DataFrame, descriptor: str = "") -> str:
    """A digest of the rows, whatever their order and partitioning: sums of two row hashes and the count, one
    partial aggregate a task. Columns are taken in order of name."""
    names = [f"`{c}`" for c in sorted(df.columns)]
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), *names).cast("decimal(38,0)")).alias(f"s{seed}")
    row = df.agg(F.count("*").alias("n"), wide(1), wide(2)).first()
    types = ",".join(f"{c}:{t}" for c, t in sorted(df.dtypes))
    return hashlib.sha256(f"{descriptor}:{types}:{row.n}:{row.s1}:{row.s2}".encode()).hexdigest()


class ContentStore:
    """Tables by digest of their content: the same data is stored once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, df: DataFrame, descriptor: str = "") -> str:
        digest = content_digest(df, descriptor)
        if not self.exists(digest):
            df.write.mode("overwrite").parquet(f"{self.path}/{digest}")
        return digest

    def exists(self, digest: str) -> bool:
        return exists(self.spark, f"{self.path}/{digest}/_SUCCESS")

    def get(self, digest: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/{digest}") if self.exists(digest) else None


def save_bundle(path: str, summary: dict, equity: DataFrame, trades: DataFrame, extra: dict | None = None) -> str:
    """A run as a folder <path>.bundle: metadata.json, equity_curve/, trades/."""
    spark = equity.sparkSession
    path = path if path.endswith(".bundle") else f"{path}.bundle"
    equity.write.mode("overwrite").parquet(f"{path}/equity_curve")
    trades.write.mode("overwrite").parquet(f"{path}/trades")
    meta = {"version": 1, "summary": summary, "extra": extra or {}, "equity_curve_path": "equity_curve", "trades_path": "trades"}
    write_text(spark, f"{path}/metadata.json", json.dumps(meta, default=str, sort_keys=True))
    return path


def load_bundle(spark: SparkSession, path: str, summary_only: bool = False) -> dict:
    """The metadata, with the two (lazy) tables unless summary_only."""
    meta = json.loads(read_text(spark, f"{path}/metadata.json"))
    if not summary_only:
        meta["equity_curve"], meta["trades"] = spark.read.parquet(f"{path}/equity_curve"), spark.read.parquet(f"{path}/trades")
    return meta


def latest_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with an equal key the one of the highest order; rows without a key all stay."""
    w = Window.partitionBy(F.coalesce(F.col(key).cast("string"), F.concat(F.lit("\0"), F.col(order).cast("string")))).orderBy(F.desc(order))
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


class RunIndex:
    """Runs with their figures. Inserts append; reads show the latest row of each backtest_id."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def insert(self, runs: DataFrame) -> None:
        """Columns: backtest_id, strategy_id, symbols (array), total_return, max_drawdown, num_trades, parameters."""
        runs.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(self.path)

    def runs(self) -> DataFrame:
        return latest_wins(self.spark.read.parquet(self.path), "backtest_id", "created_at")

    def query(self, strategy_id: str | None = None, min_total_return: float | None = None) -> DataFrame:
        return query_runs(self.runs(), strategy_id, min_total_return)


def query_runs(runs: DataFrame, strategy_id: str | None = None, min_total_return: float | None = None) -> DataFrame:
    """Newest first."""
    if strategy_id is not None:
        runs = runs.where(F.col("strategy_id") == strategy_id)
    if min_total_return is not None:
        runs = runs.where(F.col("total_return") >= min_total_return)
    return runs.orderBy(F.desc("created_at"))


def ranked(values: DataFrame, keys: tuple[str, ...] = ("date", "factor_name")) -> DataFrame:
    """Adds rank: 1 for the highest value of its key, nulls last, ties by symbol."""
    w = Window.partitionBy(*keys).orderBy(F.col("value").desc_nulls_last(), "symbol")
    return values.withColumn("rank", F.row_number().over(w))


class RankIndex:
    """Factor values by (date, factor), a partition each: a snapshot replaces the one before."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, values: DataFrame) -> None:
        """Columns: date (string), factor_name, symbol, value."""
        _replace(ranked(values.select("date", "factor_name", "symbol", "value")), self.path, "date", "factor_name")

    def _at(self, date: str, factor: str) -> DataFrame:
        return self.spark.read.schema("symbol string, value double, rank int, date string, factor_name string").parquet(self.path).where((F.col("date") == date) & (F.col("factor_name") == factor))

    def top(self, date: str, factor: str, n: int) -> DataFrame:
        return self._at(date, factor).orderBy("rank").limit(n).select("symbol", "value", "rank")

    def exists(self, date: str, factor: str) -> bool:
        return exists(self.spark, self.path) and not self._at(date, factor).isEmpty()


# Names whose values are not to be logged.
SECRET_NAMES = frozenset({"api_key", "token", "password", "secret", "authorization"})


def redacted(detail):
    """The value with secrets replaced, into dicts and lists."""
    if isinstance(detail, dict):
        return {k: "[REDACTED]" if str(k).lower() in SECRET_NAMES else redacted(v) for k, v in detail.items()}
    if isinstance(detail, (list, tuple)):
        return [redacted(x) for x in detail]
    return detail


def redacted_map(column) -> F:
    """The same for a map<string,string> Column."""
    return F.transform_values(column, lambda k, v: F.when(F.lower(k).isin(*SECRET_NAMES), F.lit("[REDACTED]")).otherwise(v))


class AuditLog:
    """Actions, appended; the detail is redacted, its digest is that of the whole."""

    SCHEMA = "id string, at timestamp, session_id string, action string, detail string, detail_sha256 string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, action: str, detail: dict, session_id: str | None = None) -> None:
        self.extend([(action, detail, session_id)])

    def extend(self, actions: list[tuple[str, dict, str | None]]) -> None:
        """Many actions (name, detail, session) in one job and one file."""
        rows = []
        for action, detail, session_id in actions:
            digest = hashlib.sha256(json.dumps(detail, sort_keys=True, default=str).encode()).hexdigest()
            rows.append((uuid.uuid4().hex, session_id, action, json.dumps(redacted(detail), sort_keys=True, default=str), digest))
        df = self.spark.createDataFrame(rows, "id string, session_id string, action string, detail string, detail_sha256 string").coalesce(1)
        df.withColumn("at", F.current_timestamp()).select("id", "at", "session_id", "action", "detail", "detail_sha256").write.mode("append").parquet(self.path)

    def query(self, action: str | None = None, session_id: str | None = None, limit: int = 100) -> DataFrame:
        df = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        for name, value in (("action", action), ("session_id", session_id)):
            if value is not None:
                df = df.where(F.col(name) == value)
        return df.orderBy(F.desc("at"), F.desc("id")).limit(limit)


def empty_equity(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EQUITY)


def empty_trades(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TRADES)
