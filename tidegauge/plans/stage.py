"""Written intermediate tables.

Ordered operators read their input twice (summary and rows).  A chain of them
would repeat the work below it, doubling per step; a stored table between steps
keeps a chain linear, gives later steps column pruning, and survives the loss of
executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidegauge.session import checkpoint_root


def materialise(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Write once to the shared folder, in folders by some columns if given, and read back."""
    path = f"{checkpoint_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
