"""Writes: plain sinks, keyed merge, download manifest."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.quality import content_tree
from tidegauge.plans.series import Series
from tidegauge.session import checkpoint_root


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Old rows whose key is not re-delivered, plus all new rows."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def write_upsert(path: str, new: DataFrame, key: Sequence[str], fmt: str = "parquet") -> None:
    """Merge into a plain folder.  The result is staged in full before it replaces the old one, but the last step
    overwrites in place: use ``merge_version`` where readers or failures in between matter."""
    spark = new.sparkSession
    stage = f"{checkpoint_root(spark)}/stage-{uuid.uuid4().hex}"
    merged = upsert(spark.read.format(fmt).load(path), new, key)
    merged.write.format(fmt).save(stage)
    spark.read.format(fmt).load(stage).write.format(fmt).mode("overwrite").save(path)


# --------------------------------------------------------------------------- versioned tables

POINTER = "CURRENT"


def current(spark: SparkSession, root: str, fmt: str = "parquet") -> DataFrame | None:
    """The version a table's pointer names, or None before the first."""
    name = _pointed(spark, root)
    return spark.read.format(fmt).load(f"{root}/{name}") if name else None


def save_version(root: str, df: DataFrame, fmt: str = "parquet") -> str:
    """Write a table as a new version and then turn the pointer to it; returns the version's name.

    The version is complete before the pointer moves, and the pointer moves by one atomic rename, so a job that fails
    or is killed at any time leaves readers with the old version or the new one.  The version before stays for
    jobs that still read it; older ones, and those no pointer ever named, are removed.
    """
    spark = df.sparkSession
    before, name = _pointed(spark, root), f"v-{uuid.uuid4().hex}"
    df.write.format(fmt).save(f"{root}/{name}")
    _turn(spark, root, name)
    fs, path = _files(spark, root)
    for status in fs.listStatus(path(root)):
        other = status.getPath().getName()
        if other.startswith("v-") and other not in (name, before):
            fs.delete(status.getPath(), True)
    return name


def merge_version(root: str, new: DataFrame, key: Sequence[str], fmt: str = "parquet") -> str:
    """Merge rows by key into the current version of a table; one writer at a time."""
    old = current(new.sparkSession, root, fmt)
    return save_version(root, new if old is None else upsert(old, new, key), fmt)


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _pointed(spark: SparkSession, root: str) -> str | None:
    fs, path = _files(spark, root)
    if not fs.exists(path(f"{root}/{POINTER}")):
        return None
    return spark.read.text(f"{root}/{POINTER}").first()[0]


def _turn(spark: SparkSession, root: str, name: str) -> None:
    fs, path = _files(spark, root)
    fresh, jvm = path(f"{root}/{POINTER}-{uuid.uuid4().hex}"), spark._jvm
    out = fs.create(fresh)
    out.write(bytearray(name, "ascii"))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    context.rename(fs.makeQualified(fresh), fs.makeQualified(path(f"{root}/{POINTER}")), options)


def write(df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    w = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        w = w.option("header", True)
    (w.partitionBy(*by) if by else w).save(path)


def append_log(records: DataFrame, path: str) -> None:
    """Append decision records as JSON lines."""
    records.write.mode("append").json(path)


def file_manifest(df: DataFrame, file_col: str, ts: str, value: str, span: int = 86_400) -> DataFrame:
    """Rows, time bounds and content digest per source file; the digest is that of its rows in time order."""
    tree = content_tree(df, Series((file_col,), ts, (), span), value)
    return manifest(df, file_col, ts).join(tree.select(file_col, "digest"), file_col)


def manifest(df: DataFrame, file_col: str, ts: str) -> DataFrame:
    """Rows and time bounds per source file."""
    return df.groupBy(file_col).agg(
        F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")
    )
