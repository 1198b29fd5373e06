"""Ordered folds whose next state depends on the last one.

Only rules no window or prefix can express come here (cooldowns, harvest
periods).  Time is cut into slices; a task holds one (key, slice), and a state
row per key is written between slices.  The same step function drives the
streaming versions.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.session import checkpoint_root

# step(state dict or None, time-ordered rows, last slice?) -> (state dict, output rows)
Step = Callable[[dict | None, pd.DataFrame, bool], tuple[dict, pd.DataFrame]]


def sliced_fold(
    df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], span: int, step: Step, out_schema: str
) -> DataFrame:
    """Fold rows of each key in time order, slice by slice of ``span`` seconds."""
    spark = df.sparkSession
    ends = df.agg(F.floor(F.unix_seconds(F.min(ts)) / span), F.floor(F.unix_seconds(F.max(ts)) / span)).first()
    lo, hi = (ends[0] or 0), (ends[1] or 0)
    names = [part.strip().split(" ")[0] for part in out_schema.split(",")]
    schema = f"{out_schema}, __state string"
    keyed = list(keys)

    def run(rows: pd.DataFrame, state: pd.DataFrame, final: bool) -> pd.DataFrame:
        held = json.loads(state["__state"].iloc[0]) if len(state) else None
        after, out = step(held, rows.sort_values(list(order)).reset_index(drop=True), final)
        key = (rows if len(rows) else state).iloc[0][keyed].to_dict()
        for k, v in key.items():
            out[k] = v
        out = out.reindex(columns=names)
        note = {**{c: None for c in names}, **key}
        table = {c: [*out[c].tolist(), note[c]] for c in names}
        table["__state"] = [None] * len(out) + [json.dumps(after)]
        return pd.DataFrame(table)

    if lo == hi:  # everything fits one slice: stay lazy
        nothing = pd.DataFrame(columns=[*keyed, "__state"])
        one = df.groupBy(*keyed).applyInPandas(lambda pdf: run(pdf, nothing, True), schema)
        return one.filter(F.col("__state").isNull()).drop("__state")

    root = f"{checkpoint_root(spark)}/fold-{uuid.uuid4().hex}"
    fields = [f for f in df.schema.fields if f.name in keyed]
    state = spark.createDataFrame([], T.StructType([*fields, T.StructField("__state", T.StringType())]))
    for i, cut in enumerate(range(lo, hi + 1)):
        begin, end = F.timestamp_seconds(F.lit(cut * span)), F.timestamp_seconds(F.lit((cut + 1) * span))
        part = df.filter((F.col(ts) >= begin) & (F.col(ts) < end))
        folded = _paired(run, cut == hi)
        part.groupBy(*keyed).cogroup(state.groupBy(*keyed)).applyInPandas(folded, schema).write.parquet(f"{root}/{i}")
        written = spark.read.parquet(f"{root}/{i}")
        state = written.filter(F.col("__state").isNotNull()).select(*keyed, "__state")
    parts = spark.read.schema(schema).parquet(*[f"{root}/{i}" for i in range(hi - lo + 1)])
    return parts.filter(F.col("__state").isNull()).drop("__state")


def _paired(run, final: bool):
    """Two-argument form: a third parameter would be taken for the group key."""

    def apply(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        return run(rows, state, final)

    return apply
