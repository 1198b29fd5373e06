"""Small helpers of the operators: text columns, batches and stored tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.session import checkpoint_root, prepare

#: Fixed value of the contracts: the characters that count as white space.
BLANK = "\\x20\\x09-\\x0D"
ROWS = 256


def texts(batch: pa.RecordBatch, column: str = "text", rows: int = ROWS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with their texts; null counts as empty.  Slices keep Python copies small."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part, [t or "" for t in part.column(part.schema.get_field_index(column)).to_pylist()]


def whole(text: Column | str) -> Column:
    """The text, with null as empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(col, F.lit(""))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind them until no column of the table has one of them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Stored:
    """Intermediate tables of one operator call, in a folder of its own under the shared checkpoint folder.

    The result of the call still reads the last tables, so the folder stays until the cluster's clean-up of
    ``spark.checkpoint.dir``; tables that later ones replace are dropped as soon as they are replaced.
    """

    def __init__(self, df: DataFrame, name: str):
        self.spark = prepare(df.sparkSession)
        self.root = f"{checkpoint_root(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: list[str] = []

    def put(self, df: DataFrame, replaces: int = 0) -> DataFrame:
        """Write once, read back; drop the ``replaces`` tables written before it."""
        path = f"{self.root}/{len(self.paths)}"
        df.write.parquet(path)
        old, self.paths = self.paths[len(self.paths) - replaces :], [*self.paths, path]
        for gone in old:
            jvm = self.spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(gone)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        return self.spark.read.schema(df.schema).parquet(path)
