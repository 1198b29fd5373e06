"""Cases that earlier forms got wrong: many slots, tied prints, missing keys, pruned guards, equal benchmarks, folders as streams."""

import os
import tempfile

import duckdb
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.check import diff, oracle
from tidegauge.catalog import load
from tidegauge.functions.scalar import collapse_regime
from tidegauge.operators import bars, gates, quality
from tidegauge.plans.series import Series, framed, number_rows, running
from tidegauge.streaming import live

S = Series(("symbol",), "ts", (), 3600)


@pytest.mark.parametrize("slots", [48, 72, 288])
def test_complete_bars_of_any_number_of_slots(spark, slots):
    n = 2 * slots
    pdf = pd.DataFrame({"symbol": "a", "ts": pd.date_range("2024-01-01", periods=n, freq="5min"), "open": 1.0, "high": 2.0, "low": 0.5, "close": 1.5, "volume": 1.0})
    pdf = pdf.drop(index=slots + 3)
    df = spark.createDataFrame(pd.concat([pdf, pdf.head(1)]))
    assert bars.resample_complete(df, 300, slots * 300).count() == 1  # the second bucket lacks a slot
    whole = spark.createDataFrame(pdf.head(slots))
    assert bars.resample_complete(whole, 300, slots * 300).count() == 1


def test_tied_prints_take_the_first_and_last_id(spark):
    rows = [("a", k, "2024-01-01 00:00:00", float(k), 1.0) for k in range(50)]
    df = spark.createDataFrame(rows, "symbol string, agg_id long, t string, price double, qty double").withColumn("ts", F.to_timestamp("t")).repartition(7)
    row = bars.ohlcv(df, 60).first()
    assert (row.open, row.close) == (0.0, 49.0)


def test_rows_without_key_or_time_stop_the_job(spark):
    df = spark.createDataFrame([("a", "2024-01-01"), (None, "2024-01-02"), ("a", None)], "symbol string, d string").withColumn("ts", F.to_timestamp("d")).withColumn("x", F.lit(1.0))
    for use in (lambda d: number_rows(d, S), lambda d: running(d, S, {"y": ("sum", "x")}), lambda d: framed(d, S, lambda e, b: e, back=1)):
        with pytest.raises(Exception, match="no place in a series"):
            use(df).count()
        assert use(df.filter("symbol IS NOT NULL AND ts IS NOT NULL")).count() == 1


def test_guards_survive_column_pruning(spark):
    df = spark.createDataFrame([(1.0, "2024-01-05")], "x double, d string").withColumn("ts", F.to_timestamp("d"))
    with pytest.raises(Exception, match="protected row"):
        quality.guard_protected(df, "ts", [("w", "2024-01-01", "2024-02-01")]).agg(F.sum("x")).collect()
    assert quality.guard_protected(df, "ts", [("w", "2024-02-01", "2024-03-01")]).count() == 1


def test_an_equal_benchmark_dominates_nothing(spark):
    runs = spark.createDataFrame([("r", 0.5, 0.1), ("s", 0.5, 0.05), ("t", 0.4, 0.1), ("u", 0.6, 0.1)], "run string, e double, n double")
    benches = spark.createDataFrame([("b", 0.5, 0.1)], "bench string, e double, n double")
    got = {r.run: r.dominated for r in gates.dominance(runs, benches, "run", "e", "n").collect()}
    assert got == {"r": False, "s": True, "t": False, "u": True}
    assert not any(r.dominated for r in gates.dominance(runs, benches.limit(0), "run", "e", "n").collect())


def test_regimes_that_collapse(spark):
    names = ["bull", "bull_high_vol", "bear_high_vol", "sideways", "sideways_high_vol", "unknown", "bullish"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "r string").select(collapse_regime(F.col("r"))).collect()]
    assert got == ["bull", "bull", "bear", "sideways", "sideways_high_vol", "unknown", "bullish"]


def test_streams_read_folders_and_files(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.range(10).repartition(3).write.parquet(f"{path}/t.parquet")
    pd.DataFrame({"id": [1, 2]}).to_parquet(f"{path}/one.parquet")
    schema = spark.range(1).schema
    for name, n in (("t.parquet", 10), ("one.parquet", 2)):
        out, seen = live.drain(live.read_files(spark, f"{path}/{name}", schema), "files")
        assert out.count() == n == seen["input_rows"]


def test_stored_merge_survives_a_killed_write(spark, monkeypatch):
    """A failure before the pointer turns leaves the old version; the next merge works and clears what was left."""
    import os
    import tempfile

    from tidegauge.sources import sinks

    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/t"
    make = lambda rows: spark.createDataFrame(rows, "k int, v string")
    held = lambda: {tuple(r) for r in sinks.current(spark, root).collect()}
    assert sinks.current(spark, root) is None
    sinks.merge_version(root, make([(1, "a"), (2, "b")]), ["k"])
    reader = sinks.current(spark, root)

    def killed(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(sinks, "_turn", killed)
        with pytest.raises(RuntimeError, match="killed"):
            sinks.merge_version(root, make([(2, "lost")]), ["k"])
    broken = make([(3, "x")]).withColumn("v", F.raise_error(F.lit("lost executor")).cast("string"))
    with pytest.raises(Exception, match="lost executor"):
        sinks.merge_version(root, broken, ["k"])
    assert held() == {(1, "a"), (2, "b")}
    sinks.merge_version(root, make([(2, "c"), (3, "d")]), ["k"])
    assert held() == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in reader.collect()} == {(1, "a"), (2, "b")}  # who read the version before still can
    assert sum(name.startswith("v-") for name in os.listdir(root)) == 2


@pytest.mark.parametrize("rows", [1, 3, 4, 5, 30])
def test_content_tree_does_not_depend_on_chunks(spark, rows):
    import hashlib

    from tidegauge.operators.quality import content_tree
    from tidegauge.plans.series import Series

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    df = spark.createDataFrame([("a", i, i / 3) for i in range(rows)], "symbol string, s long, x double").withColumn("ts", F.timestamp_seconds("s"))
    level = [sha(f"{i * 1_000_000}:{i / 3:.8f}") for i in range(rows)]
    while len(level) > 1:
        level = [sha("".join(level[i : i + 4])) for i in range(0, len(level), 4)]
    got = {tuple(content_tree(df, Series(span=span), "x", fan=4).first()) for span in (1, 7, 10_000)}
    assert got == {("a", rows, level[0])}


def test_window_metrics_read_the_trades_once(spark):
    from tidegauge.operators import ledger

    read = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            read.add(len(f))
            yield f

    pdf = pd.DataFrame({"pair": ["a", "b"] * 20, "close_date": pd.date_range("2024-01-01", periods=40, freq="15h"), "stake_amount": 10.0})
    pdf["profit_ratio"] = [0.02, -0.01, 0.0, 0.03] * 10
    pdf["profit_abs"] = pdf.stake_amount * pdf.profit_ratio
    df = spark.createDataFrame(pdf)
    got = ledger.window_metrics(df.mapInPandas(count, df.schema), ["pair"], 100.0).toPandas().set_index("pair")
    assert read.value == len(pdf)
    for k, g in pdf.groupby("pair"):
        x, row = g.profit_abs, got.loc[k]
        assert (row.n, row.largest_win, row.largest_loss) == (20, x.max(), x.min())
        assert [row.net, row.win_rate, row.mean_ratio, row.volume] == pytest.approx([x.sum(), (x > 0).mean(), g.profit_ratio.mean(), 200.0])


@pytest.mark.parametrize("name", ["daily_sharpe_sortino", "strict_sharpe_sortino_by_year"])
def test_losing_days_do_not_depend_on_the_plan(spark, tmp_path, name):
    """Days that cancel out are noise of the order of adding: that of the table, in several files and after a join by key."""
    sf = "/root/testdata/sf0.01"
    (tmp_path / "lineitem.parquet").mkdir()
    os.symlink(f"{sf}/orders.parquet", tmp_path / "orders.parquet")
    rows = pq.read_table(f"{sf}/lineitem.parquet")
    for i, at in enumerate((40_000, 20_000, 0)):
        pq.write_table(rows.slice(at, 20_000), tmp_path / "lineitem.parquet" / f"part-{i}.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{sf}/orders.parquet'")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        got = load()[name].run(spark, str(tmp_path)).toPandas()
    finally:
        spark.conf.set(key, before)
    assert rows.num_rows == 60_000 and diff(got, oracle(con, load()[name].sql)) is None
