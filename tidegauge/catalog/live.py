"""Streaming rules: L1-L7 and L9.  Each query drains the event files through a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidegauge.catalog.accounts import CORE, EQ, LOCK
from tidegauge.catalog.base import BARS, SETTLEMENTS, TICKS, TRADES, ms, query, r, rounded
from tidegauge.plans.single import attach
from tidegauge.session import checkpoint_root
from tidegauge.streaming import live
from tidegauge.streaming.state import AccountStep, latest_settlement, stateful


def _events(v):
    """The events table as a stream, be it a file or a folder of files."""
    schema = v.table("events").schema
    return live.read_files(v.spark, f"{v.path}/events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _symbol():
    return F.concat(F.lit("S"), (F.col("user_id") % 8).cast("string")).alias("symbol")


def _ticks(v):
    return _events(v).select(
        _symbol(), F.col("event_id").alias("agg_id"), "ts", (F.col("value") + 100).alias("price"),
        (F.get_json_object("props", "$.k").cast("double") + 1).alias("qty"), F.col("event_type").isin("error", "view").alias("buyer_maker"),
    )


@query(
    "stream_closed_bars",
    "L1",
    f"""WITH {BARS}, m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM ticks)
      SELECT symbol, epoch_ms(ts) AS ts_ms, open, high, low, close, volume FROM bars, m WHERE ts + INTERVAL 1 HOUR <= wm""",
)
def _(v):
    out, _ = live.drain(live.closed_bars(_ticks(v), 3600, "10 minutes"), "bars")
    return out.select("symbol", ms("ts").alias("ts_ms"), "open", "high", "low", "close", "volume")


@query(
    "stream_complete_bars",
    "L2",
    f"""WITH {BARS}, g AS (SELECT symbol, (epoch_ms(ts) // 10800000) * 10800000 AS ts_ms, arg_max(close, ts) AS close, count(*) AS k FROM bars GROUP BY 1, 2), m AS (SELECT max(epoch_ms(ts)) AS wm FROM bars)
      SELECT symbol, ts_ms, close FROM g, m WHERE k = 3 AND ts_ms + 10800000 <= wm""",
)
def _(v):
    from tidegauge.plans.stage import materialise

    path_df = materialise(v.bars, "bars")
    path = path_df.inputFiles()[0].rsplit("/", 1)[0]
    stream = live.read_files(v.spark, path, path_df.schema)
    out, _ = live.drain(live.complete_bars(stream, 3600, 10_800, "0 seconds"), "complete")
    return out.select("symbol", ms("ts").alias("ts_ms"), "close")


@query(
    "stream_sliding_imbalance",
    "L3",
    f"""WITH {TICKS}, w AS (SELECT symbol, date_trunc('hour', ts) + to_hours(CAST(k AS INTEGER)) AS e, CASE WHEN buyer_maker THEN -1.0 ELSE 1.0 END * qty * price AS s, qty * price AS v FROM ticks, (SELECT unnest([1, 2]) AS k)),
      m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM ticks)
      SELECT symbol, epoch_ms(e) AS ts_ms, round(sum(s) / sum(v), 6) + 0.0 AS imbalance FROM w, m WHERE e <= wm GROUP BY 1, 2""",
)
def _(v):
    out, _ = live.drain(live.sliding_imbalance(_ticks(v), "2 hours", "1 hour", "10 minutes"), "slide")
    return out.select("symbol", ms("ts").alias("ts_ms"), r("imbalance").alias("imbalance"))


@query(
    "stream_dedup_within_watermark",
    "L4 B12",
    f"WITH {TICKS} SELECT agg_id, epoch_us(ts) // 1000 AS ts_ms FROM ticks",
)
def _(v):
    t = _ticks(v).select("agg_id", "ts")
    doubled = t.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out, _ = live.drain(live.first_copies(doubled, ["agg_id"], "1 hour").select("agg_id", "ts"), "dedup")
    return out.select("agg_id", ms("ts").alias("ts_ms"))


@query(
    "stream_late_row_metrics",
    "L5 D6",
    """WITH m AS (SELECT epoch_ms(max(ts)) AS wm FROM events WHERE event_id % 2 = 0)
      SELECT count(*) AS rows, count(*) AS streamed, count(*) FILTER (event_id % 2 = 1 AND epoch_us(ts) <= wm * 1000) AS dropped_late,
        count(*) FILTER (event_id % 2 = 0 OR epoch_us(ts) > wm * 1000) AS kept FROM events, m""",
)
def _(v):
    """The odd half of the events arrives after the even half: what the watermark has passed is dropped and counted."""
    root = f"{checkpoint_root(v.spark)}/late-{uuid.uuid4().hex}"
    e = v.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    seen = []
    for half in (0, 1):
        e.filter(F.col("event_id") % 2 == half).write.mode("append").parquet(f"{root}/landing")
        arrived = live.read_files(v.spark, f"{root}/landing", e.schema)
        out, counts = live.drain(live.first_copies(arrived, ["event_id"], "0 seconds"), "late", root=root)
        seen.append(counts)
    streamed, dropped = (F.lit(sum(c[k] for c in seen)).cast("long") for k in ("input_rows", "dropped_late"))
    n, kept = e.agg(F.count(F.lit(1)).alias("rows")), out.agg(F.count(F.lit(1)).alias("kept"))
    return attach(n, kept).select("rows", streamed.alias("streamed"), dropped.alias("dropped_late"), "kept")


@query(
    "stream_asof_funding_state",
    "L6 C5",
    f"""WITH {TICKS}, {SETTLEMENTS}, b AS (SELECT * FROM ticks WHERE event_type <> 'signup')
      SELECT b.agg_id AS row_id, s.rate, epoch_us(s.ts) AS settled_us FROM b ASOF LEFT JOIN settlements s ON b.symbol = s.symbol AND b.ts >= s.ts""",
)
def _(v):
    e = _events(v)
    side = F.when(F.col("event_type") == "signup", 0).otherwise(1)
    rows = e.select(
        _symbol(), F.unix_micros("ts").alias("ts_us"), F.col("event_id").alias("row_id"), side.alias("side"), ((F.col("value") - 100) / 1e5).alias("rate")
    )
    out = stateful(rows, ["symbol"], ["ts_us", "side"], latest_settlement, "symbol string, ts_us long, row_id long, rate double, settled_us long")
    done, _ = live.drain(out, "asof")
    return done.select("row_id", "rate", "settled_us")


@query(
    "stream_account_state",
    "L7 E42",
    f"""WITH RECURSIVE {EQ}, c AS (SELECT pair, ts, i, hw, locked, greatest(realised, 0) * {LOCK} AS cap, least(locked, greatest(realised, 0) * {LOCK}) AS tgt FROM p),
      z AS (SELECT pair, ts, i, hw, locked, greatest(0, tgt) AS res FROM c WHERE i = 1
        UNION ALL SELECT c.pair, c.ts, c.i, c.hw, c.locked, CASE WHEN z.res > c.cap + 1e-9 THEN c.tgt ELSE greatest(z.res, c.tgt) END FROM z JOIN c ON c.pair = z.pair AND c.i = z.i + 1)
      SELECT pair, epoch_ms(ts) AS ts_ms, round(hw, 6) + 0.0 AS high_water, round(locked, 6) + 0.0 AS locked, round(res, 6) + 0.0 AS reserve FROM z""",
)
def _(v):
    from tidegauge.catalog.accounts import _rows
    from tidegauge.operators.capital import ReserveStep
    from tidegauge.plans.stage import materialise

    flat = materialise(_rows(v).select("pair", ms("ts").alias("ts_ms"), "realised", "unrealised"), "equity_rows")
    path = flat.inputFiles()[0].rsplit("/", 1)[0]
    stream = live.read_files(v.spark, path, flat.schema)
    out = stateful(
        stream, ["pair"], ["ts_ms"], AccountStep(CORE, ReserveStep(LOCK)), "pair string, ts_ms long, high_water double, locked double, reserve double, harvest double"
    )
    done, _ = live.drain(out, "account")
    return rounded(done.select("pair", "ts_ms", "high_water", "locked", "reserve"), "high_water", "locked", "reserve")


@query(
    "stream_decision_log_sink",
    "L9 A13",
    f"WITH {TICKS} SELECT symbol, count(*) AS n FROM ticks GROUP BY 1",
)
def _(v):
    root = f"{checkpoint_root(v.spark)}/stream-log-{uuid.uuid4().hex}"
    rec = _ticks(v).select("symbol", "agg_id", F.unix_millis("ts").alias("timestamp_ms"), F.lit(1).alias("schema"))
    live.append_log(rec, f"{root}/log", f"{root}/state").awaitTermination()
    back = v.spark.read.schema(rec.schema).json(f"{root}/log")
    return back.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
