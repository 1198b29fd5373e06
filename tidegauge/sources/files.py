"""File and table scans: declared schemas, tolerant headers, nested records."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import sha256
from tidegauge.functions.scalar import bool_text, positive
from tidegauge.plans.stage import materialise

SPAN = 128 << 20  # bytes of a file that one task hashes at a time
PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst|passthrough)$"

# fixed values: column order of the public kline and trade-print archives
KLINE = (
    "open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades",
    "taker_buy_volume", "taker_buy_quote_volume", "ignore",
)
PRINTS = ("agg_id", "price", "qty", "first_id", "last_id", "ts", "ibm")
TRADE_SCHEMA = (
    "pair string, open_date timestamp, close_date timestamp, open_rate double, close_rate double, "
    "stake_amount double, profit_abs double, profit_ratio double, exit_reason string"
)
LOG_SCHEMA = (
    "schema int, run_id string, config_id string, seed long, global_step long, episode_id long, timestamp_ms long, "
    "candle_idx long, obs_hash string, action int, action_probs map<string,double>, position int, cash double, "
    "equity double, reward double, cumulative_reward double, regime string, config_hash string, env_hash string, "
    "normalizer_hash string, model_hash string, dataset_hash string, schema_header boolean, schema_trailer boolean"
)


def require(cols: Sequence[str], df: DataFrame) -> DataFrame:
    lacking = sorted(set(cols) - set(df.columns))
    if lacking:
        raise ValueError(f"missing columns: {lacking}")
    return df


def candles(spark: SparkSession, path: str, symbol: str | None = None, start=None, end=None) -> DataFrame:
    """Candle table with symbol and time predicates the scan can push down."""
    df = require(("symbol", "ts", "open", "high", "low", "close", "volume"), spark.read.parquet(path))
    if symbol is not None:
        df = df.filter(F.col("symbol") == symbol)
    if start is not None:
        df = df.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    return df


def role_window(df: DataFrame, role: str, windows: dict[str, tuple[str, str]], ts: str = "ts") -> DataFrame:
    """Rows of a named role's window; an undeclared role is an error."""
    if role not in windows:
        raise ValueError(f"unknown role {role}; declared: {sorted(windows)}")
    a, b = windows[role]
    return df.filter(F.col(ts).between(F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp")))


def _texts(names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` string" for n in names)


def klines(spark: SparkSession, path: str, keep: Sequence[str] = ("open_time", "close")) -> DataFrame:
    """Kline CSV with or without a header line; header lines fail the number test."""
    raw = spark.read.schema(_texts(KLINE)).csv(path)
    at = F.expr("try_cast(open_time AS BIGINT)")
    cols = [at.alias("open_ms") if c == "open_time" else F.col(c).cast("double").alias(c) for c in keep]
    return raw.filter(at.isNotNull()).select(*cols)


def zipped_klines(spark: SparkSession, path: str) -> DataFrame:
    """Kline CSV members inside zip archives; one archive at a time per task."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for blob in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(blob)) as z:
                    for name in z.namelist():
                        if name.endswith(".csv"):
                            with z.open(name) as member:
                                for part in pd.read_csv(member, header=None, usecols=[0, 4], dtype=str, chunksize=200_000):
                                    part.columns = ["open_time", "close"]
                                    yield part

    raw = spark.read.format("binaryFile").load(path).select("content")
    text = raw.mapInPandas(unpack, "open_time string, close string")
    at = F.expr("try_cast(open_time AS BIGINT)")
    return text.filter(at.isNotNull()).select(at.alias("open_ms"), F.col("close").cast("double").alias("close"))


def prints(spark: SparkSession, path: str) -> DataFrame:
    """Trade-print CSV; the file splits, header lines drop, side text is normalised.

    Prints with an unknown side keep their price but count as zero volume.
    """
    raw = spark.read.schema(_texts(PRINTS)).csv(path)
    agg = F.expr("try_cast(agg_id AS BIGINT)")
    side = bool_text(F.col("ibm"))
    px, qty = F.col("price").cast("double"), F.col("qty").cast("double")
    known = side.isNotNull()
    return raw.filter(agg.isNotNull()).select(
        agg.alias("agg_id"),
        px.alias("price"),
        qty.alias("qty"),
        F.timestamp_millis(F.col("ts").cast("long")).alias("ts"),
        side.alias("buyer_maker"),
        F.when(known, px * qty).otherwise(0.0).alias("notional"),
        F.when(side, -px * qty).when(~side, px * qty).otherwise(0.0).alias("signed"),
    )


def daily_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot CSVs, one per day; non-positive interest becomes null, source day kept."""
    raw = spark.read.schema("create_time string, oi string").csv(path)
    day = F.regexp_extract(F.col("_metadata.file_path"), r"day=(\d{4}-\d{2}-\d{2})", 1)
    at = F.to_timestamp("create_time")
    return raw.select(at.alias("ts"), positive(F.expr("try_cast(oi AS DOUBLE)")).alias("oi"), day.alias("src_day")).filter(
        F.col("ts").isNotNull()
    )


def missing_days(found: DataFrame, day: str, start: str, end: str) -> DataFrame:
    """Calendar days between bounds without a source file."""
    spine = found.sparkSession.sql(f"SELECT explode(sequence(DATE'{start}', DATE'{end}')) AS day")
    have = found.select(F.to_date(day).alias("day")).distinct()
    return spine.join(have, "day", "left_anti")


def backtest_trades(spark: SparkSession, path: str, strategy: str, multi_line: bool = True) -> DataFrame:
    """Trades nested under strategy.<name>.trades of result JSON files."""
    trade = "pair string, open_ms long, close_ms long, stake_amount double, profit_abs double, profit_ratio double"
    schema = f"strategy struct<`{strategy}`: struct<trades: array<struct<{_nested(trade)}>>>>"
    raw = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    return raw.select(F.explode(F.col(f"strategy.`{strategy}`.trades")).alias("t")).select("t.*")


def _nested(ddl: str) -> str:
    return ", ".join(f"{p.split()[0]}: {p.split()[1]}" for p in ddl.split(", "))


def trades_csv(spark: SparkSession, path: str) -> DataFrame:
    """Ledger CSV; an absent path gives an empty ledger."""
    try:
        return spark.read.schema(TRADE_SCHEMA).option("header", True).csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], TRADE_SCHEMA)


def jdbc_trades(spark: SparkSession, url: str, table: str, bounds: Sequence[str], properties: dict | None = None) -> DataFrame:
    """Relational trades, one partition per predicate (for example id ranges)."""
    return spark.read.jdbc(url, table, predicates=list(bounds), properties=properties or {})


def action_steps(spark: SparkSession, path: str) -> DataFrame:
    """Action and equity arrays of run artefacts as one row per step."""
    raw = spark.read.schema("run string, actions array<int>, equities array<double>").json(path)
    return raw.select("run", F.posexplode(F.arrays_zip("actions", "equities")).alias("step", "z")).select(
        "run", "step", F.col("z.actions").alias("action"), F.col("z.equities").alias("equity")
    )


def decision_log(spark: SparkSession, path: str) -> DataFrame:
    """Decision records without header and trailer lines."""
    raw = spark.read.schema(LOG_SCHEMA).json(path)
    return raw.filter(F.col("schema_header").isNull() & F.col("schema_trailer").isNull()).drop("schema_header", "schema_trailer")


def log_errors(df: DataFrame) -> DataFrame:
    """Adds ``errors``: what breaks the record rules, empty when valid."""
    needed = [c for c in df.columns if c not in ("errors",)]
    checks: list[Column] = [F.when(F.col(c).isNull(), f"missing {c}") for c in needed]
    checks += [
        F.when(F.col("schema") != 1, "schema not 1"),
        F.when(~F.col("action").isin(0, 1, 2), "action out of range"),
        F.when(~F.col("position").isin(0, 1), "position out of range"),
    ]
    return df.withColumn("errors", F.array_compact(F.array(*checks)))


def file_digests(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SHA-256 and size per file.

    A file of up to ``SPAN`` bytes is hashed by one task.  The digest of a longer one is carried from turn to turn, see
    ``_carried_digests``.  Without OpenSSL's functions, and for files that Spark would unpack by their names, one task
    hashes the whole file; Spark holds 2 GB at most then.
    """
    size, file = F.col("_metadata.file_size"), F.col("_metadata.file_name")
    at_once = (size <= SPAN) | file.rlike(PACKED) if sha256.resumable() else F.lit(True)  # known before a file is opened
    raw = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    found = raw.filter(at_once).select(name, F.sha2("content", 256).alias("sha256"), "length")
    long = raw.filter(~at_once).select(F.col("_metadata.file_path").alias("path"), name, "length").collect()
    if not long:
        return found
    digests = _carried_digests(spark.read.text(path, lineSep="\n").filter(~at_once), {r["path"]: r["length"] for r in long})
    return found.unionByName(spark.createDataFrame([(r["file"], digests[r["path"]], r["length"]) for r in long], "file string, sha256 string, length long"))


def _carried_digests(lines: DataFrame, lengths: dict[str, int]) -> dict[str, str]:
    """Digests of long files, each read by many tasks.

    Spark's text reader splits a file at any byte and gives its lines as they are, so they are its bytes but for the
    newline at the end and a byte order mark, which the length tells.  Pieces are stored by turns of ``SPAN`` bytes; in
    a turn one task for each file takes up the state of the chain, adds the turn's pieces and hands on 112 bytes.
    """
    spark, paths = lines.sparkSession, sorted(lengths)
    at = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, at int")
    start = F.col("_metadata.file_block_start")
    rows = lines.select(F.col("_metadata.file_path").alias("path"), start.alias("start"), F.col("value").cast("binary").alias("line"))
    pieces = rows.join(F.broadcast(at), "path").select("at", "start", "line").mapInArrow(_joined, "at int, start long, n long, size long, piece binary")
    stored = materialise(pieces.withColumn("turn", F.expr(f"start div {SPAN}")), "pieces", by=["turn"])
    place = F.struct("start", "n")
    sums = stored.groupBy("at").agg(F.sum("size").alias("size"), F.min(place).alias("first"), F.max(place).alias("last")).collect()
    ends = {}
    for r in sums:
        lacks = lengths[paths[r["at"]]] - r["size"]  # every line has its newline here: the last one may be too many
        if lacks not in (0, -1, 3, 2):
            raise ValueError(f"{paths[r['at']]} changed or was not read byte for byte")
        ends[r["at"]] = (tuple(r["first"]) if lacks > 0 else None, tuple(r["last"]) if lacks in (-1, 2) else None)
    states: dict[int, bytes] = {}
    for (turn,) in sorted(stored.select("turn").distinct().collect()):
        part = stored.filter(F.col("turn") == turn).select("at", "start", "n", "piece").repartitionById(len(paths), "at")
        done = part.sortWithinPartitions("at", "start", "n").mapInArrow(_added(states, ends), "at int, state binary").collect()
        states = states | {r["at"]: bytes(r["state"]) for r in done}
    return {p: sha256.Sha256(states[i]).hexdigest() for i, p in enumerate(paths)}


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive lines of one split as one piece, each line with its newline."""
    n = 0
    for batch in batches:
        at, start = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (start[1:] != start[:-1])) + 1).tolist(), len(at)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                piece = b"\n".join([*batch.column(2).slice(a, b - a).to_pylist(), b""])
                cols = [pa.array([at[a]], pa.int32()), pa.array([start[a]], pa.int64()), pa.array([n], pa.int64()), pa.array([len(piece)], pa.int64()), pa.array([piece], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["at", "start", "n", "size", "piece"])
                n += 1


def _added(states: dict[int, bytes], ends: dict[int, tuple]):
    """Task that adds ordered pieces to the states of their files."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains: dict[int, sha256.Sha256] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                at, start, n, piece = (c[i].as_py() for c in batch.columns)
                chain = chains.setdefault(at, sha256.Sha256(states.get(at)))
                first, last = ends[at]
                if (start, n) == first:
                    chain.update(b"\xef\xbb\xbf")
                chain.update(piece[:-1] if (start, n) == last else piece)
        yield pa.RecordBatch.from_arrays([pa.array([*chains], pa.int32()), pa.array([c.state() for c in chains.values()], pa.binary())], ["at", "state"])

    return add


def failed_digests(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest entries whose file is absent or differs."""
    return manifest.join(found.select("file", "sha256"), ["file", "sha256"], "left_anti")


def run_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Run-metric JSON corpus flattened to one row per run."""
    schema = "run string, metrics struct<net: double, trades: long, max_dd: double>, gates struct<warnings: array<string>>"
    raw = spark.read.schema(schema).json(path)
    return raw.select("run", "metrics.*", F.col("gates.warnings").alias("warnings"))
