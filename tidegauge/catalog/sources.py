"""Scans and sinks: A1-A19, D35, D40, H7-H10.  Files are written from the tables, then scanned back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidegauge.catalog.base import BARS, SNAPSHOTS, TICKS, TRADES, ms, query, r, rounded
from tidegauge.operators import quality as Q
from tidegauge.session import checkpoint_root
from tidegauge.sources import files, sinks


def _folder(v, name: str) -> str:
    return f"{checkpoint_root(v.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "scan_candles_symbol_and_end",
    "A1 A2 A4 A17 B3",
    f"WITH {BARS} SELECT symbol, epoch_ms(ts) AS ts_ms, close FROM bars WHERE symbol = 'S3' AND ts <= TIMESTAMP '2024-01-20 00:00:00'",
)
def _(v):
    path = _folder(v, "candles")
    sinks.write(v.bars, path, by=["symbol"])
    out = files.candles(v.spark, path, "S3", end="2024-01-20 00:00:00")
    return out.select("symbol", ms("ts").alias("ts_ms"), "close")


@query(
    "scan_role_window",
    "A3 B6",
    f"WITH {BARS} SELECT symbol, epoch_ms(ts) AS ts_ms, close FROM bars WHERE ts BETWEEN TIMESTAMP '2024-01-11' AND TIMESTAMP '2024-01-20'",
)
def _(v):
    w = {"train": ("2024-01-01", "2024-01-10"), "validation": ("2024-01-11", "2024-01-20")}
    return files.role_window(v.bars, "validation", w).select("symbol", ms("ts").alias("ts_ms"), "close")


@query(
    "scan_kline_csv",
    "A5",
    f"WITH {BARS} SELECT epoch_ms(ts) AS open_ms, close FROM bars",
)
def _(v):
    path = _folder(v, "klines")
    b = v.bars.select(
        F.unix_millis("ts").alias("open_time"), "open", "high", "low", "close", "volume",
        *[F.lit(0).alias(c) for c in files.KLINE[6:]],
    )
    sinks.write(b, path, "csv")
    return files.klines(v.spark, path)


@query(
    "scan_trade_prints_csv",
    "A6 B10",
    f"""WITH {TICKS} SELECT agg_id, price, qty, CASE WHEN agg_id % 97 <> 0 THEN buyer_maker END AS buyer_maker,
      round(CASE WHEN agg_id % 97 <> 0 THEN price * qty ELSE 0 END, 4) + 0.0 AS notional, epoch_us(ts) // 1000 AS ts_ms FROM ticks""",
)
def _(v):
    path = _folder(v, "prints")
    side = F.when(F.col("agg_id") % 97 == 0, "?").when(F.col("agg_id") % 2 == 0, F.initcap(F.col("buyer_maker").cast("string")))
    t = v.ticks.select(
        "agg_id", "price", "qty", F.col("agg_id").alias("first_id"), F.col("agg_id").alias("last_id"), F.unix_millis("ts").alias("ts"),
        F.coalesce(side, F.col("buyer_maker").cast("string")).alias("ibm"),
    )
    sinks.write(t, path, "csv")
    out = files.prints(v.spark, path)
    return out.select("agg_id", "price", "qty", "buyer_maker", r("notional", 4).alias("notional"), ms("ts").alias("ts_ms"))


@query(
    "scan_daily_metrics_missing_days",
    "A7 B9 B11",
    f"""WITH {SNAPSHOTS}, d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM snapshots WHERE day(ts) % 7 <> 0),
      g AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day)
      SELECT CAST(day AS VARCHAR) AS day FROM g ANTI JOIN d USING (day)""",
)
def _(v):
    path = _folder(v, "metrics")
    s = v.snapshots.filter(F.dayofmonth("ts") % 7 != 0).select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("create_time"), F.coalesce("oi", F.lit(0.0)).alias("oi"), F.to_date("ts").alias("day")
    )
    s.write.partitionBy("day").csv(path)
    m = files.daily_metrics(v.spark, path)
    return files.missing_days(m, "src_day", "2024-01-01", "2024-01-30").select(F.col("day").cast("string").alias("day"))


@query(
    "scan_nested_backtest_json",
    "A8 H9",
    f"WITH {TRADES} SELECT pair, count(*) AS n, round(sum(profit_abs), 4) + 0.0 AS net FROM trades GROUP BY 1",
)
def _(v):
    path = _folder(v, "results")
    t = v.trades.select(
        "pair", F.unix_millis("open_date").alias("open_ms"), F.unix_millis("close_date").alias("close_ms"), "stake_amount", "profit_abs", "profit_ratio", "order_id"
    )
    # one result document per order keeps every trade array small
    docs = t.groupBy("order_id").agg(F.collect_list(F.struct(*[c for c in t.columns if c != "order_id"])).alias("trades"))
    docs.select(F.struct(F.struct("trades").alias("X")).alias("strategy")).write.json(path)
    out = files.backtest_trades(v.spark, path, "X", multi_line=False)
    return out.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), r(F.sum("profit_abs"), 4).alias("net"))


@query(
    "scan_trades_csv_or_empty",
    "A9 A10 A17",
    f"WITH {TRADES} SELECT pair, count(*) AS n, round(avg(profit_ratio), 7) + 0.0 AS mean FROM trades GROUP BY 1",
)
def _(v):
    path = _folder(v, "ledger")
    empty = files.trades_csv(v.spark, path)  # nothing there yet
    t = v.trades.select(
        "pair", "open_date", "close_date", F.lit(0.0).alias("open_rate"), F.lit(0.0).alias("close_rate"), "stake_amount", "profit_abs", "profit_ratio",
        F.lit("roi").alias("exit_reason"),
    )
    sinks.write(t, path, "csv")
    both = files.trades_csv(v.spark, path).unionByName(empty)
    return both.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), r(F.avg("profit_ratio"), 7).alias("mean"))


@query(
    "scan_action_arrays",
    "A11 H9",
    f"""WITH {TICKS} SELECT symbol || '-' || strftime(ts, '%Y-%m-%d-%H') AS run, row_number() OVER (PARTITION BY symbol, date_trunc('hour', ts) ORDER BY ts) - 1 AS step,
      CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 ELSE 0 END AS action, price AS equity FROM ticks""",
)
def _(v):
    path = _folder(v, "actions")
    code = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "error", 2).otherwise(0)
    run = F.concat_ws("-", "symbol", F.date_format("ts", "yyyy-MM-dd-HH"))
    day = v.ticks.groupBy(run.alias("run")).agg(F.array_sort(F.collect_list(F.struct("ts", code.alias("a"), "price"))).alias("z"))
    day.select("run", F.col("z.a").alias("actions"), F.col("z.price").alias("equities")).write.json(path)
    out = files.action_steps(v.spark, path)
    return out.select("run", F.col("step").cast("long").alias("step"), "action", "equity")


def _log(v):
    t = v.ticks
    h = F.sha2(F.col("agg_id").cast("string"), 256)
    code = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "error", 2).when(F.col("event_type") == "view", 3).otherwise(0)
    return t.select(
        F.lit(1).alias("schema"), F.lit("run").alias("run_id"), F.lit("cfg").alias("config_id"), F.lit(7).cast("long").alias("seed"),
        F.col("agg_id").alias("global_step"), F.lit(0).cast("long").alias("episode_id"), F.unix_millis("ts").alias("timestamp_ms"),
        F.col("agg_id").alias("candle_idx"), F.substring(h, 1, 16).alias("obs_hash"), code.alias("action"),
        F.create_map(F.lit("0"), F.lit(0.5), F.lit("1"), F.lit(0.5)).alias("action_probs"), F.lit(0).alias("position"),
        F.col("price").alias("cash"), F.col("price").alias("equity"), F.lit(0.0).alias("reward"), F.lit(0.0).alias("cumulative_reward"),
        F.when(F.col("value") > 100, F.lit(None).cast("string")).otherwise("calm").alias("regime"), F.lit("a").alias("config_hash"), F.lit("b").alias("env_hash"),
        F.lit("c").alias("normalizer_hash"), F.lit("d").alias("model_hash"), F.lit("e").alias("dataset_hash"),
    )


@query(
    "decision_log_round_trip",
    "A12 A13 L9",
    f"""WITH {TICKS} SELECT CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'view' THEN 3 ELSE 0 END AS action, count(*) AS n,
      round(avg(price), 6) + 0.0 AS mean_equity, round(avg(0.5), 6) AS p_hold FROM ticks GROUP BY 1""",
)
def _(v):
    path = _folder(v, "log")
    marks = v.spark.range(1).select(F.lit(True).alias("schema_header"), F.lit("run").alias("run_id"))
    sinks.append_log(marks, path)
    sinks.append_log(_log(v), path)
    sinks.append_log(marks.withColumnRenamed("schema_header", "schema_trailer"), path)
    out = files.decision_log(v.spark, path)
    p = F.element_at("action_probs", "0")
    return out.groupBy("action").agg(F.count(F.lit(1)).alias("n"), r(F.avg("equity")).alias("mean_equity"), r(F.avg(p)).alias("p_hold"))


@query(
    "decision_log_validation",
    "A14",
    f"""WITH {TICKS}, e AS (SELECT agg_id, value > 100 AS m, event_type = 'view' AS a FROM ticks)
      SELECT unnest([CASE WHEN m THEN 'missing regime' END, CASE WHEN a THEN 'action out of range' END]) AS error, count(*) AS n FROM e GROUP BY 1 HAVING error IS NOT NULL""",
)
def _(v):
    bad = files.log_errors(_log(v)).select(F.explode("errors").alias("error"))
    return bad.groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("file_integrity_digests", "A15 H10")
def _(v):
    tables = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
    found = files.file_digests(v.spark, [f"{v.path}/{t}.parquet" for t in tables])
    manifest = found.withColumn("sha256", F.when(F.col("file").startswith("orders"), F.lit("0" * 64)).otherwise(F.col("sha256")))
    return files.failed_digests(found, manifest).select("file", "length")


@query(
    "download_manifest",
    "A18",
    f"""WITH {TICKS} SELECT symbol AS part, count(*) AS rows, epoch_us(min(ts)) // 1000 AS first_ms, epoch_us(max(ts)) // 1000 AS last_ms FROM ticks GROUP BY 1""",
)
def _(v):
    path = _folder(v, "parts")
    v.ticks.select("symbol", "ts").write.partitionBy("symbol").parquet(path)
    back = v.spark.read.parquet(path).select("ts", "_metadata.file_path").withColumn("part", F.regexp_extract("file_path", "symbol=([^/]+)/", 1))
    m = sinks.manifest(back, "part", "ts")
    return m.select("part", "rows", ms("first_ts").alias("first_ms"), ms("last_ts").alias("last_ms"))


@query(
    "run_metric_corpus",
    "A19 D32 D40",
    f"""WITH {TRADES}, g AS (SELECT order_id % 200 AS run, sum(profit_abs) AS net, count(*) AS trades FROM trades GROUP BY 1)
      SELECT count(*) AS runs, CAST(sum(trades) AS BIGINT) AS trades, round(avg(net), 3) + 0.0 AS mean_net, count(*) FILTER (net < 0) AS losing,
        CAST(sum(CASE WHEN net < 0 THEN 1 ELSE 0 END + CASE WHEN trades < 20 THEN 1 ELSE 0 END) AS BIGINT) AS warnings,
        round(max(trades) FILTER (run = 199) / (max(trades) FILTER (run = 0) * 1.0), 6) + 0.0 AS last_over_first FROM g""",
)
def _(v):
    path = _folder(v, "runs")
    g = v.trades.groupBy((F.col("order_id") % 200).alias("run")).agg(F.sum("profit_abs").alias("net"), F.count(F.lit(1)).alias("trades"))
    warn = F.array_compact(F.array(F.when(F.col("net") < 0, "losing"), F.when(F.col("trades") < 20, "few_trades")))
    g.select(
        F.col("run").cast("string").alias("run"), F.struct("net", "trades", F.lit(0.1).alias("max_dd")).alias("metrics"), F.struct(warn.alias("warnings")).alias("gates")
    ).write.json(path)
    m = files.run_metrics(v.spark, path).withColumn("i", F.col("run").cast("int"))
    return m.agg(
        F.count(F.lit(1)).alias("runs"), F.sum("trades").alias("trades"), r(F.avg("net"), 3).alias("mean_net"),
        F.count_if(F.array_contains("warnings", "losing")).alias("losing"), F.sum(F.size("warnings")).alias("warnings"),
        r(F.max_by("trades", "i") / F.min_by("trades", "i")).alias("last_over_first"),
    )


@query(
    "ordered_content_hash",
    "D35 H10",
    f"""WITH {BARS}, c AS (SELECT symbol, epoch_ms(ts) // 2592000000 AS c, sha256(string_agg(epoch_us(ts) || ':' || printf('%.8f', close), ',' ORDER BY ts)) AS h FROM bars GROUP BY 1, 2)
      SELECT symbol, sha256(string_agg(h, '' ORDER BY c)) AS digest FROM c GROUP BY 1""",
)
def _(v):
    from tidegauge.sources.views import BAR_SERIES

    return Q.content_hash(v.bars, BAR_SERIES, "close")


_TREE = """l AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS p, count(*) OVER (PARTITION BY symbol) AS n, sha256(epoch_us(ts) || ':' || printf('%.8f', close)) AS h FROM bars),
      up AS (SELECT symbol, n, p, h FROM l UNION ALL SELECT symbol, (n + 255) // 256, p // 256, sha256(string_agg(h, '' ORDER BY p)) FROM up WHERE n > 1 GROUP BY symbol, n, p // 256),
      tree AS (SELECT symbol, h AS digest FROM up WHERE n = 1)"""


@query("ordered_content_tree", "D35 H10", f"WITH RECURSIVE {BARS}, {_TREE} SELECT symbol, rows, digest FROM tree JOIN (SELECT symbol, count(*) AS rows FROM bars GROUP BY 1) USING (symbol)")
def _(v):
    from tidegauge.sources.views import BAR_SERIES

    return Q.content_tree(v.bars, BAR_SERIES, "close")


@query(
    "download_manifest_files",
    "A18 D35",
    f"""WITH RECURSIVE {BARS}, {_TREE} SELECT symbol AS part, count(*) AS rows, epoch_us(min(ts)) // 1000 AS first_ms, epoch_us(max(ts)) // 1000 AS last_ms, max(digest) AS digest
      FROM bars JOIN tree USING (symbol) GROUP BY 1""",
)
def _(v):
    path = _folder(v, "files")
    v.bars.select("symbol", "ts", "close").repartition("symbol").write.partitionBy("symbol").parquet(path)  # one file for each symbol
    back = v.spark.read.parquet(path).select("ts", "close", F.col("_metadata.file_path").alias("file"))
    m = sinks.file_manifest(back, "file", "ts", "close", span=30 * 86_400)
    return m.select(F.regexp_extract("file", "symbol=([^/]+)/", 1).alias("part"), "rows", ms("first_ts").alias("first_ms"), ms("last_ts").alias("last_ms"), "digest")


@query(
    "stored_merge_versions",
    "A16",
    f"""WITH {BARS} SELECT symbol, epoch_ms(ts) AS ts_ms, CASE WHEN epoch_ms(ts) // 3600000 % 3 = 0 THEN close + 2 WHEN epoch_ms(ts) // 3600000 % 3 = 1 THEN close + 1 ELSE close END AS close FROM bars""",
)
def _(v):
    """A table written once and merged twice: each merge replaces a share of the rows by key."""
    root, hour = _folder(v, "versions"), F.unix_seconds("ts") / 3600
    b = v.bars.select("symbol", "ts", "close")
    sinks.save_version(root, b)
    sinks.merge_version(root, b.filter(hour % 3 < 2).withColumn("close", F.col("close") + 1), ["symbol", "ts"])
    sinks.merge_version(root, b.filter(hour % 3 == 0).withColumn("close", F.col("close") + 2), ["symbol", "ts"])
    return sinks.current(v.spark, root).select("symbol", ms("ts").alias("ts_ms"), "close")


@query(
    "string_and_time_functions",
    "H1 H2 H3 H4 H7 H8",
    f"""WITH {TRADES} SELECT isoyear(close_date) || '-W' || week(close_date) AS wk, dayofweek(open_date) IN (0, 6) AS weekend, replace(pair || '/USDT', '/', '') AS sym, split_part(pair || '/USDT', '/', 1) AS base,
      count(*) AS n, round(avg(date_diff('second', open_date, close_date) / 60.0), 3) + 0.0 AS mean_minutes, min(epoch_ms(open_date)) AS first_ms FROM trades GROUP BY 1, 2, 3, 4""",
)
def _(v):
    from tidegauge.functions import scalar as S

    pair = F.concat("pair", F.lit("/USDT"))
    a, b = S.window_bounds(F.concat(F.col("open_date").cast("string"), F.lit(" → "), F.col("close_date").cast("string"), F.lit("  # note")))
    return v.trades.withColumns({"a": a, "b": b}).groupBy(
        S.iso_week(F.col("close_date")).alias("wk"), F.dayofweek("open_date").isin(1, 7).alias("weekend"), S.pair_to_symbol(pair).alias("sym"), S.base_currency(pair).alias("base")
    ).agg(
        F.count(F.lit(1)).alias("n"), r(F.avg(S.minutes_between(F.col("a"), F.col("b"))), 3).alias("mean_minutes"), F.min(S.to_ms(F.col("a"))).alias("first_ms")
    )
