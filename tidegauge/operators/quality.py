"""Row-quality rules: masks, counters, guards, continuity, deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalar import finite
from tidegauge.plans.series import Series, framed


def clean_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NaN and infinities to null."""
    return df.withColumns({c: finite(F.col(c)) for c in cols})


def equal_width(df: DataFrame, group: list[str], value: str, bins: int, out: str = "bin") -> DataFrame:
    """0-based equal-width bin between the group's min and max; the max falls in the last bin."""
    e = df.groupBy(*group).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    place = F.floor(F.try_divide(F.col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo")) * bins)
    joined = df.join(e, group)
    return joined.withColumn(out, F.least(F.lit(bins - 1).cast("long"), F.coalesce(place, F.lit(0)))).drop("__lo", "__hi")


def ohlcv_breaks(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Counts of broken candle rules per key."""
    o, h, low, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    return bars.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if((o <= 0) | (h <= 0) | (low <= 0) | (c <= 0)).alias("non_positive"),
        F.count_if(v < 0).alias("negative_volume"),
        F.count_if(h < F.greatest(o, c, low)).alias("high_broken"),
        F.count_if(low > F.least(o, c, h)).alias("low_broken"),
        F.count_if(o.isNull() | h.isNull() | low.isNull() | c.isNull() | v.isNull()).alias("null_rows"),
    )


def continuity(df: DataFrame, s: Series, step: int) -> DataFrame:
    """Gaps, backward steps and missing rows of a grid series per key."""
    sec = F.unix_seconds(s.ts)

    def build(d, b):
        return d.withColumn("__d", sec - F.lag(sec).over(b.w))

    out = framed(df.select(*s.keys, s.ts), s, build, back=1)
    return out.groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("__d") > step).alias("gaps"),
        F.count_if(F.col("__d") == 0).alias("duplicates"),
        (F.floor((F.max(sec) - F.min(sec)) / step) + 1 - F.count(F.lit(1))).alias("missing"),
        F.max("__d").alias("widest_gap_s"),
    )


def tick_counters(ticks: DataFrame, s: Series, gap_s: int = 60) -> DataFrame:
    """One-pass quality counters of trade prints in arrival (id) order."""

    def build(d, b):
        prev, pid = F.lag("ts").over(b.w), F.lag("agg_id").over(b.w)
        return d.withColumns(
            {
                "__back": F.col("ts") < prev,
                "__gap": F.unix_micros("ts") - F.unix_micros(prev) > gap_s * 1_000_000,
                "__skip": F.col("agg_id") <= pid,
            }
        )

    out = framed(ticks, s, build, back=1)
    return out.groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("price").isNull() | F.col("qty").isNull()).alias("nulls"),
        F.count_if((F.col("price") <= 0) | (F.col("qty") <= 0)).alias("non_positive"),
        F.count_if("__back").alias("ts_backward"),
        F.count_if("__gap").alias("gaps"),
        F.count_if("__skip").alias("id_backward"),
        F.count_if(F.col("buyer_maker")).alias("maker_true"),
        F.count_if(~F.col("buyer_maker")).alias("maker_false"),
    )


def on_time_grid(ts_ms: Column, period_ms: int, tolerance_ms: int) -> Column:
    """Within ``tolerance`` of a multiple of ``period``."""
    off = F.pmod(ts_ms, F.lit(period_ms))
    return (off <= tolerance_ms) | (off >= period_ms - tolerance_ms)


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key by the order columns, as a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in key]
    ordered = F.struct(*order, *[c for c in rest if c not in order])
    packed = df.groupBy(*key).agg(F.min(ordered).alias("__r"))
    return packed.select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def union_null_rate(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Share of rows with any of the columns null."""
    any_null = F.lit(False)
    for c in cols:
        any_null = any_null | F.col(c).isNull()
    return df.groupBy(*by).agg(F.avg(any_null.cast("double")).alias("null_rate"))


def protected_hits(df: DataFrame, ts: str, windows: DataFrame) -> DataFrame:
    """Count and time range of rows inside each protected window (empty if none).

    The window list is configuration, a few rows.
    """
    hit = df.join(F.broadcast(windows), (F.col(ts) >= F.col("win_start")) & (F.col(ts) <= F.col("win_end")))
    return hit.groupBy("win").agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def guard_protected(df: DataFrame, ts: str, bounds: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Fail the job on the first row inside a protected window (inclusive bounds)."""
    bad = F.lit(False)
    for _, a, b in bounds:
        bad = bad | F.col(ts).between(F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp"))
    said = F.raise_error(F.concat(F.lit("protected row at "), F.col(ts).cast("string"))).cast("boolean")
    return df.filter(F.when(bad, said).otherwise(True))  # a filter: column pruning cannot drop it


def label_bound(ts: Column, start: Column, end: Column, horizon: int, step: int) -> Column:
    """Rows whose whole forward window lies inside the slice."""
    return (ts >= start) & (ts <= end - F.make_dt_interval(secs=F.lit(horizon * step)))


def content_hash(df: DataFrame, s: Series, value: str) -> DataFrame:
    """Ordered content hash per key: bounded chunks first, then the chunk hashes."""
    from tidegauge.plans.series import CHUNK

    line = F.concat_ws(":", F.unix_micros(s.ts).cast("string"), F.format_number(value, 8))
    parts = df.withColumn(CHUNK, s.chunk()).groupBy(*s.keys, CHUNK).agg(
        F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct(s.ts, line.alias("x")))), lambda z: z["x"])), 256).alias("h")
    )
    return parts.groupBy(*s.keys).agg(
        F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(CHUNK, "h"))), lambda z: z["h"])), 256).alias("digest")
    )


TREE = 256  # children of a node of a content tree


def content_tree(df: DataFrame, s: Series, value: str, fan: int = TREE) -> DataFrame:
    """One digest per key over its rows in order, and their number.

    Rows are leaves by their exact position, ``fan`` neighbours become the digest of their digests, level by level
    until one is left.  So the digest depends on rows and order alone, not on how they were cut into chunks or
    tasks, and no task holds more of a key than ``fan`` digests at a time.
    """
    from tidegauge.plans.series import POS, number_rows

    line = F.concat_ws(":", F.unix_micros(s.ts).cast("string"), F.format_string("%.8f", F.col(value)))
    at = number_rows(df.select(*s.keys, s.ts, *s.ties, value), s, total="rows").select(*s.keys, "rows", F.col("rows").alias("n"), F.col(POS).alias("p"), F.sha2(line, 256).alias("h"))
    most = at.agg(F.max("n")).first()[0] or 0
    while most > 1:
        together = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]))
        up = F.when(F.col("n") == 1, F.max("h")).otherwise(F.sha2(together, 256))  # a lone node is done and stays
        at = at.groupBy(*s.keys, "rows", "n", F.expr(f"p div {fan}").alias("__up")).agg(up.alias("h"))
        at = at.select(*s.keys, "rows", F.expr(f"(n + {fan - 1}) div {fan}").alias("n"), F.col("__up").alias("p"), "h")
        most = -(-most // fan)
    return at.select(*s.keys, "rows", F.col("h").alias("digest"))
