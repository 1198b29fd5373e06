"""Event studies: forward returns, excursions per event, schedules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators import joins, windows as w
from tidegauge.plans.series import Series, framed


def forward_returns(df: DataFrame, s: Series, horizons: Sequence[int], price: str = "close") -> DataFrame:
    """Long table (row, h, ret): return over the next h rows, cut off at the end."""
    c = F.col(price)

    def build(d, b):
        arr = F.array(
            *[F.struct(F.lit(h).alias("h"), w.forward_return(b, c, h).alias("ret")) for h in horizons]
        )
        return d.withColumn("__r", arr)

    out = framed(df, s, build, ahead=max(horizons))
    return out.withColumn("__r", F.explode(F.filter("__r", lambda x: x["ret"].isNotNull()))).select(
        *df.columns, F.col("__r.h").alias("h"), F.col("__r.ret").alias("ret")
    )


def study(events: DataFrame, prices: DataFrame, s: Series, horizons: Sequence[int], event_key: str) -> DataFrame:
    """Return from the first price at or after t to the first at or after t + h seconds."""
    base = joins.asof(events.select(*s.keys, event_key, s.ts), prices, s, ["price"], "forward")
    base = base.withColumnRenamed("price", "p0")
    offsets = F.explode(F.array(*[F.lit(h) for h in horizons]))
    later = base.withColumn("h", offsets).withColumn(s.ts, F.col(s.ts) + F.make_dt_interval(secs=F.col("h")))
    hit = joins.asof(later, prices, s, ["price"], "forward")
    return hit.select(*s.keys, event_key, "h", w.ratio(F.col("price"), F.col("p0")).alias("__q")).withColumn(
        "ret", F.col("__q") - 1
    ).drop("__q")


def scheduled(bars: DataFrame, rules: dict[str, tuple[Column, int]], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Calendar rules: entry where the predicate holds on a bar, exit hold seconds later.

    Only events whose exit bar exists are kept; both prices come with them.
    """
    tagged = bars.withColumn(
        "__rule",
        F.explode(
            F.array_compact(
                F.array(
                    *[
                        F.when(pred, F.struct(F.lit(name).alias("rule"), F.lit(hold).alias("hold")))
                        for name, (pred, hold) in rules.items()
                    ]
                )
            )
        ),
    ).select(*keys, F.col("ts").alias("entry"), F.col("close").alias("entry_price"), "__rule.rule", "__rule.hold")
    exits = bars.select(*keys, F.col("ts").alias("exit"), F.col("close").alias("exit_price"))
    opened = tagged.withColumn("exit", F.col("entry") + F.make_dt_interval(secs=F.col("hold")))
    return opened.join(exits, [*keys, "exit"], "inner").drop("hold")


def net_of_cost(events: DataFrame, direction: Column, cost: float) -> DataFrame:
    gross = direction * (F.col("exit_price") / F.col("entry_price") - 1)
    return events.withColumns({"gross": gross, "net": gross - F.lit(cost)})
