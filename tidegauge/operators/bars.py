"""Ticks to bars, bar resampling, grids and gap filling."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.plans.series import Series, running


def bucket(ts: Column | str, seconds: int) -> Column:
    """Start of the ``seconds``-wide bucket, aligned to the epoch."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_seconds(F.floor(F.unix_seconds(col) / F.lit(seconds)) * seconds)


def moment(ts: str = "ts", tie: str = "agg_id") -> Column:
    """Time and then an integer id as one number, which a hash aggregate can keep (a struct would need a sort)."""
    micros = F.unix_micros(F.col(ts).cast("timestamp")).cast("decimal(19,0)")
    return micros * F.lit(Decimal(10**19)) + F.col(tie).cast("decimal(19,0)")


def ohlcv(ticks: DataFrame, seconds: int, keys: Sequence[str] = ("symbol",), label: str = "start", tie: str = "agg_id") -> DataFrame:
    """Trade prints to bars.  First and last price by time, then by the id of the print; one hash aggregation."""
    start, order = bucket("ts", seconds), moment("ts", tie)
    out = ticks.groupBy(*keys, start.alias("ts")).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("qty").alias("volume"),
    )
    return _labelled(out, seconds, label)


def resample(bars: DataFrame, seconds: int, keys: Sequence[str] = ("symbol",), label: str = "start") -> DataFrame:
    """Bars to coarser bars; ``label='end'`` stamps the bucket's end."""
    out = bars.groupBy(*keys, bucket("ts", seconds).alias("ts")).agg(*_ohlcv_parts())
    return _labelled(out, seconds, label)


def resample_complete(bars: DataFrame, step: int, seconds: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Coarser bars from buckets holding every ``step`` slot; partial ones are dropped."""
    slots = seconds // step
    offset = F.unix_seconds("ts") % seconds
    out = bars.groupBy(*keys, bucket("ts", seconds).alias("ts")).agg(
        *_ohlcv_parts(),
        # the slots seen: at most seconds / step of them, merged map-side
        F.size(F.collect_set((offset / step).cast("int"))).alias("__slots"),
        F.max((offset % step != 0).cast("int")).alias("__off"),
    )
    return out.filter((F.col("__slots") == slots) & (F.col("__off") == 0)).drop("__slots", "__off")


def _ohlcv_parts() -> list[Column]:
    return [
        F.min_by("open", F.col("ts")).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", F.col("ts")).alias("close"),
        F.sum("volume").alias("volume"),
    ]


def _labelled(df: DataFrame, seconds: int, label: str) -> DataFrame:
    if label == "end":
        return df.withColumn("ts", F.timestamp_seconds(F.unix_seconds("ts") + seconds))
    if label != "start":
        raise ValueError(f"label must be start or end, not {label}")
    return df


def second_bars(ticks: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Order-flow bars of one second: signed quantity, volume, last price, prints."""
    sign = F.when(F.col("buyer_maker"), -1.0).otherwise(1.0)
    return ticks.groupBy(*keys, bucket("ts", 1).alias("ts")).agg(
        F.sum(sign * F.col("qty") * F.col("price")).alias("signed"),
        F.sum(F.col("qty") * F.col("price")).alias("vol"),
        F.max_by("price", F.struct("ts", "agg_id")).alias("px"),
        F.count(F.lit(1)).alias("n"),
    )


def spine(df: DataFrame, step: int, keys: Sequence[str] = ("symbol",), ts: str = "ts", span: int | None = None) -> DataFrame:
    """Every grid instant between a key's first and last row.

    The grid is laid out per day first and per instant second, so no task
    expands a whole key.
    """
    day = span or max(86_400, step)
    sec = F.unix_seconds(ts)
    ends = df.groupBy(*keys).agg(
        (F.floor(F.min(sec) / step) * step).alias("__lo"), (F.floor(F.max(sec) / step) * step).alias("__hi")
    )
    days = ends.withColumn(
        "__day", F.explode(F.sequence(F.floor(F.col("__lo") / day), F.floor(F.col("__hi") / day)))
    ).repartition(*keys, "__day")
    start = F.greatest(F.col("__lo"), F.ceil(F.col("__day") * day / F.lit(step)) * step)
    stop = F.least(F.col("__hi"), (F.col("__day") + 1) * day - 1)
    grid = F.when(start <= stop, F.sequence(start, stop, F.lit(step).cast("long")))
    return days.select(*keys, F.explode(grid).alias("__at")).select(*keys, F.timestamp_seconds("__at").alias(ts))


def on_grid(df: DataFrame, step: int, zero: Sequence[str] = (), keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Left join onto the grid; ``zero`` columns become 0 where no row exists."""
    out = spine(df, step, keys).join(df, [*keys, "ts"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in zero})


def filled(df: DataFrame, step: int, carry: Sequence[str], zero: Sequence[str], s: Series) -> DataFrame:
    """Grid with carried-forward prices and zero volumes; ``was_filled`` marks new rows."""
    grid = spine(df, step, s.keys).join(df.withColumn("__seen", F.lit(True)), [*s.keys, "ts"], "left")
    out = running(grid, s, {f"__c_{c}": ("last", c) for c in carry})
    out = out.withColumns({c: F.col(f"__c_{c}") for c in carry}).drop(*[f"__c_{c}" for c in carry])
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in zero})
    return out.withColumn("was_filled", F.col("__seen").isNull()).drop("__seen")


def missing(df: DataFrame, step: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Grid instants without a row."""
    return spine(df, step, keys).join(df.select(*keys, "ts"), [*keys, "ts"], "left_anti")


def daily_zero_filled(daily: DataFrame, day: str, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Calendar spine per key; days without a row get zero."""
    stamped = daily.withColumn(day, F.col(day).cast("timestamp"))
    out = on_grid(stamped.withColumnRenamed(day, "ts"), 86_400, values, keys) if keys else _one_calendar(stamped, day, values)
    return out.withColumn("ts", F.col("ts").cast("date")).withColumnRenamed("ts", day)


def _one_calendar(df: DataFrame, day: str, values: Sequence[str]) -> DataFrame:
    one = df.withColumnRenamed(day, "ts").withColumn("__one", F.lit(1))
    return on_grid(one, 86_400, values, ("__one",)).drop("__one")
