"""Session defaults.

``builder`` is for tests, benches and small deployments.  ``prepare`` only sets
the runtime options that results depend on, so it is safe to call on a session
the cluster handed over.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def builder(app: str = "tidegauge", cores: str = "*", memory: str = "8g") -> SparkSession.Builder:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the options that change results: UTC clock and adaptive re-planning."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    ship(spark)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    base = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "tidegauge_pkg"
    sc.addPyFile(shutil.make_archive(str(base), "zip", root_dir=here.parent, base_dir=here.name))
    _SHIPPED.add(sc.applicationId)


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions of this session; sizes value buckets."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  A local folder is only
    taken where that setting is absent and the master is local, as in tests.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    path = os.environ.get("TIDEGAUGE_LOCAL_CHECKPOINT") or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", path)
    return path
