"""Ordered work on keyed series without a task per key.

A window partitioned by symbol puts a whole symbol into one task.  Every helper
here partitions by (key, bounded piece of the key) instead:

* ``number_rows``  exact 0-based position inside each key, from per-chunk counts
* ``running``      unbounded running aggregates, chunk summary + prefix + local
* ``framed``       bounded frames (lag, lead, N-row windows) on row blocks that
                   carry a replicated halo, trimmed afterwards
* ``blocked``      the same blocks as Arrow tables
* ``averaged``     recursive averages of any memory, as an affine scan over blocks
* ``ewm``/``rma``  recursive averages as weighted running sums on those blocks

A chunk is a fixed span of time, a block a fixed number of positions.  The only
window ordered over a whole key runs on the chunk summary (one row per key and
chunk), never on data rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = "__chunk"
BLOCK = "__block"
POS = "pos"

DOUBLE_BITS = 60  # history weights below 2^-60 cannot change a double


@dataclass(frozen=True)
class Series:
    """Key columns, time column, tie-break columns and chunk span in seconds."""

    keys: tuple[str, ...] = ("symbol",)
    ts: str = "ts"
    ties: tuple[str, ...] = ()
    span: int = 86_400
    reverse: bool = False

    def chunk(self) -> Column:
        sec = F.unix_seconds(F.col(self.ts).cast("timestamp"))
        piece = F.floor(sec / F.lit(self.span)).cast("long")
        return -piece if self.reverse else piece

    def order(self) -> list[Column]:
        first = F.col(self.ts).desc() if self.reverse else F.col(self.ts).asc()
        return [first, *[F.col(c).asc() for c in self.ties]]

    def local(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, CHUNK).orderBy(*self.order())

    def across(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(CHUNK)

    def backwards(self) -> "Series":
        return replace(self, reverse=not self.reverse)


def _chunked(df: DataFrame, s: Series) -> DataFrame:
    """Rows with their chunk.  A row without a key or a time has no place in a series: it stops the job.

    The check is a filter, so no plan can prune it.
    """
    missing = F.col(s.ts).isNull()
    for k in s.keys:
        missing = missing | F.col(k).isNull()
    said = F.raise_error(F.lit(f"a row without {', '.join(s.keys)} or {s.ts} has no place in a series; filter such rows first")).cast("boolean")
    return df.filter(F.when(missing, said).otherwise(True)).withColumn(CHUNK, s.chunk())


def _match(left: DataFrame, right: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """Left join on keys that are never null here; Spark sizes the small side at run time."""
    return left.join(right, list(cols), "left")


# --------------------------------------------------------------------------- positions


def number_rows(df: DataFrame, s: Series, out: str = POS, total: str | None = None) -> DataFrame:
    """Exact 0-based position of every row within its key."""
    if out in df.columns:
        raise ValueError(f"column {out} is taken; rename it before numbering rows")
    chunked = _chunked(df, s)
    counts = chunked.groupBy(*s.keys, CHUNK).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(s.across().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cols = [before.alias("__before")]
    if total:
        cols.append(F.sum("__n").over(Window.partitionBy(*s.keys)).alias(total))
    offsets = counts.select(*s.keys, CHUNK, *cols)
    pos = (F.row_number().over(s.local()) - 1 + F.col("__before")).cast("long")
    return _match(chunked, offsets, (*s.keys, CHUNK)).withColumn(out, pos).drop(CHUNK, "__before")


# --------------------------------------------------------------------------- running aggregates

_PLAIN: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "count": F.count,
    "max": F.max,
    "min": F.min,
}


def _combine(kind: str, carry: Column, here: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(carry.isNull(), here).when(here.isNull(), carry).otherwise(carry + here)
    if kind == "max":
        return F.greatest(carry, here)
    if kind == "min":
        return F.least(carry, here)
    return F.coalesce(here, carry)


def running(
    df: DataFrame,
    s: Series,
    parts: Mapping[str, tuple[str, ...]],
    inclusive: bool = True,
) -> DataFrame:
    """Running aggregates ``{out: (kind, column[, "before"])}`` from the start of each key.

    kind: sum, count, max, min, or last (latest non-null value).  "before", or
    ``inclusive=False`` for all, leaves the current row out.  All parts share
    one summary and one local pass, so ask for them together.
    """
    chunked = _chunked(df, s)
    wanted = list(dict.fromkeys((p[0], p[1]) for p in parts.values()))
    aggs = []
    for i, (kind, col) in enumerate(wanted):
        if kind == "last":
            rank = F.when(F.col(col).isNotNull(), F.struct(*_sortable(s), F.col(col).alias("v")))
            aggs.append(F.max(rank)["v"].alias(f"__p{i}"))
        else:
            aggs.append(_PLAIN[kind](col).alias(f"__p{i}"))
    summary = chunked.groupBy(*s.keys, CHUNK).agg(*aggs)
    prior = s.across().rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *s.keys,
        CHUNK,
        *[
            (F.last(f"__p{i}", True) if kind == "last" else (F.sum if kind == "count" else _PLAIN[kind])(f"__p{i}"))
            .over(prior)
            .alias(f"__q{i}")
            for i, (kind, _) in enumerate(wanted)
        ],
    )
    joined = _match(chunked, carried, (*s.keys, CHUNK))
    outs = {}
    for name, part in parts.items():
        kind, col = part[0], part[1]
        upto = -1 if (not inclusive or len(part) > 2) else 0
        frame = s.local().rowsBetween(Window.unboundedPreceding, upto)
        here = (F.last(col, True) if kind == "last" else _PLAIN[kind](col)).over(frame)
        outs[name] = _combine(kind, F.col(f"__q{wanted.index((kind, col))}"), here)
    return joined.withColumns(outs).drop(CHUNK, *[f"__q{i}" for i in range(len(wanted))])


def running_equity(df: DataFrame, s: Series, pnl: str, start: float | None = None) -> DataFrame:
    """Cumulative ``equity`` and its running ``peak`` in one chunked pass.

    Without ``start`` the curve begins at its first value; with it the peak is
    at least ``start``.
    """
    base = 0.0 if start is None else start
    local = _chunked(df, s).withColumn("__e", F.sum(F.coalesce(pnl, F.lit(0.0))).over(_upto(s)))
    summary = local.groupBy(*s.keys, CHUNK).agg(F.sum(F.coalesce(pnl, F.lit(0.0))).alias("__s"), F.max("__e").alias("__m"))
    prior = s.across().rowsBetween(Window.unboundedPreceding, -1)
    lifted = summary.withColumn("__b", F.coalesce(F.sum("__s").over(prior), F.lit(0.0)))
    carried = lifted.select(*s.keys, CHUNK, "__b", F.max(F.col("__b") + F.col("__m")).over(prior).alias("__t"))
    joined = _match(local, carried, (*s.keys, CHUNK))
    here = F.max("__e").over(_upto(s)) + F.col("__b")
    peak = F.greatest(F.col("__t"), here, *([F.lit(0.0)] if start is not None else []))
    return joined.withColumns({"equity": F.col("__b") + F.col("__e") + base, "peak": peak + base}).drop(
        CHUNK, "__e", "__b", "__t"
    )


def _upto(s: Series) -> WindowSpec:
    return s.local().rowsBetween(Window.unboundedPreceding, 0)


def _sortable(s: Series) -> list[Column]:
    """Order columns as ascending numbers, for max(struct) picks of the latest row."""
    micros = F.unix_micros(F.col(s.ts).cast("timestamp"))
    return [(-micros if s.reverse else micros).alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(s.ties)]]


# --------------------------------------------------------------------------- bounded frames


@dataclass(frozen=True)
class Blocks:
    """Window specs on haloed row blocks.

    ``w`` is ordered by position, ``rows(n)`` is the N-row trailing frame,
    ``run`` the running frame from the block's first (halo) row.
    """

    keys: tuple[str, ...]
    size: int

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, BLOCK).orderBy(POS)

    def rows(self, n: int) -> WindowSpec:
        return self.w.rowsBetween(-(n - 1), 0)

    def ahead(self, n: int) -> WindowSpec:
        return self.w.rowsBetween(1, n)

    @property
    def run(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    def step(self) -> Column:
        """Position relative to the block start; negative in the leading halo."""
        return F.col(POS) - F.col(BLOCK) * F.lit(self.size)


def framed(
    df: DataFrame,
    s: Series,
    build: Callable[[DataFrame, Blocks], DataFrame],
    back: int = 0,
    ahead: int = 0,
    size: int | None = None,
    numbered: bool = False,
) -> DataFrame:
    """Run ``build`` on blocks of rows holding ``back``/``ahead`` halo rows.

    ``build`` may add columns from windows that look at most that far.  Rows are
    shuffled once on (key, block); halo copies are dropped at the end.
    """
    size = size or max(4096, 4 * (back + ahead))
    base = df if numbered else number_rows(df, s)
    home = F.floor(F.col(POS) / F.lit(size)).cast("long")
    first = F.greatest(F.floor((F.col(POS) - ahead) / F.lit(size)), F.lit(0)).cast("long")
    last = F.floor((F.col(POS) + back) / F.lit(size)).cast("long")
    haloed = base.withColumn(BLOCK, F.explode(F.sequence(first, last)))
    built = build(haloed, Blocks(s.keys, size))
    out = built.filter(F.col(BLOCK) == home).drop(BLOCK)
    return out if numbered else out.drop(POS)


def blocked(
    df: DataFrame,
    s: Series,
    columns: Mapping[str, str],
    compute: Callable[[pa.Table], Mapping[str, pa.Array]],
    back: int = 0,
    ahead: int = 0,
    size: int | None = None,
    numbered: bool = False,
) -> DataFrame:
    """``framed`` for what no window expression says: ``compute`` gets a block with its halo, in order, as an Arrow
    table and gives the new ``columns`` (name: type) for all its rows; those of the halo are dropped."""
    size = size or max(8192, 4 * (back + ahead))
    base = df if numbered else number_rows(df, s)
    first = F.greatest(F.floor((F.col(POS) - ahead) / F.lit(size)), F.lit(0)).cast("long")
    last = F.floor((F.col(POS) + back) / F.lit(size)).cast("long")
    haloed = base.withColumn(BLOCK, F.explode(F.sequence(first, last)))
    schema = T.StructType([*base.schema.fields, *[T.StructField(n, T._parse_datatype_string(t)) for n, t in columns.items()]])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(POS)
        new = compute(table)
        for name in columns:
            table = table.append_column(name, new[name])
        own = pc.equal(pc.divide(table.column(POS), size), table.column(BLOCK))
        return table.filter(own).select(schema.names)

    out = haloed.groupBy(*s.keys, BLOCK).applyInArrow(run, schema)
    return out if numbered else out.drop(POS)


# --------------------------------------------------------------------------- recursive averages


def memory(decay: float) -> int:
    """Rows after which an old value's weight is below double resolution."""
    return math.ceil(DOUBLE_BITS * math.log(2) / -math.log(decay))


def block_size(decays: list[float], back: int) -> int:
    """Largest safe block so that decay^-(rows in block) stays inside a double."""
    widest = min(int(280 / -math.log10(d)) for d in decays)
    size = min(8192, widest - back)
    if size < back // 8 + 1:
        raise ValueError("history too long for this decay; split the recursion into stages")
    return size


def _decayed(b: Blocks, decay: float, weighted: Column) -> Column:
    """sum of weighted_i * decay^(t-i), as one running sum per block."""
    grow = F.pow(F.lit(1.0 / decay), b.step())
    return F.sum(weighted * grow).over(b.run) / grow


def ewm(b: Blocks, x: Column, decay: float, first: int = 0, min_rows: int = 1) -> Column:
    """y_t = decay*y_{t-1} + (1-decay)*x_t, started at y_first = x_first.

    ``first`` is the position of the first valid value; nulls may only precede it.
    """
    pos = F.col(POS)
    part = F.when(pos == first, x).when(pos > first, x * F.lit(1.0 - decay))
    return F.when(pos >= first + min_rows - 1, _decayed(b, decay, part))


def rma(b: Blocks, x: Column, period: int, first: int = 0) -> Column:
    """Wilder average seeded with the mean of the first ``period`` valid values."""
    pos, seed = F.col(POS), first + period - 1
    start = F.avg(x).over(b.rows(period))
    part = F.when(pos == seed, start).when(pos > seed, x / F.lit(float(period)))
    return F.when((pos >= seed) & x.isNotNull(), _decayed(b, 1.0 - 1.0 / period, part))


# --------------------------------------------------------------------------- affine scans

FAN = 1024  # blocks folded into one, on the way to a whole key


def averaged(df: DataFrame, s: Series, parts: Mapping[str, tuple[str, float]], size: int | None = None, fan: int = FAN) -> DataFrame:
    """Exponential averages ``{out: (column, decay)}`` of numbered rows, with any memory and no halo.

    y = x at a key's first non-null x, wherever it stands; then y = decay * y + (1 - decay) * x, where a null x only
    decays.  Null before the first x; with a decay of zero y is x itself.  Every block of positions is an affine step of what came before it: it scales
    the average by decay^size and adds its own weighted sum, and if nothing came before it, its first x weighs 1.
    Steps of ``fan`` blocks are composed into one, those of a key into prefixes, and the value before each block is
    joined back to its rows.  Rows are ordered inside their block only.
    """
    parts, plain = {n: p for n, p in parts.items() if p[1] > 0}, {n: F.col(p[0]) for n, p in parts.items() if p[1] <= 0}
    if not parts:
        return df.withColumns(plain)
    size = size or min([8192, *[int(280 / -math.log10(d)) for _, d in parts.values()]])
    names, state = list(parts), "struct<b:double,h:boolean,c:double>"
    rows = df.withColumn(BLOCK, F.expr(f"{POS} div {size}"))
    left = F.lit(float(size - 1)) - (F.col(POS) - F.col(BLOCK) * size)  # rows to the nominal end of the block
    aggs = []
    for name, (x, d) in parts.items():
        v = F.col(x).cast("double")
        first = F.min(F.when(v.isNotNull(), F.struct(F.col(POS).alias("p"), (v * d * F.pow(F.lit(d), left)).alias("c"))))
        total = F.coalesce(F.sum(v * (1 - d) * F.pow(F.lit(d), left)), F.lit(0.0))
        aggs.append(F.struct(total.alias("b"), first.isNotNull().alias("h"), F.coalesce(first["c"], F.lit(0.0)).alias("c")).alias(f"__{name}"))
    blocks = rows.groupBy(*s.keys, BLOCK).agg(*aggs)

    def folded(items: DataFrame, by: list[str], place: str, width: int) -> DataFrame:
        """Items of a group in order: totals, and for each the state of those before it."""
        g = items.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(place, *[f"__{n}" for n in names]))).alias("__all"))
        folds = {}
        for n in names:
            a = f"{parts[n][1] ** width!r}D"
            start = f"named_struct('b', 0D, 'h', false, 'c', 0D, 'out', CAST(array() AS array<{state}>))"
            step = f"named_struct('b', s.b * {a} + x.__{n}.b, 'h', s.h OR x.__{n}.h, 'c', if(s.h, s.c * {a}, x.__{n}.c), 'out', array_append(s.out, named_struct('b', s.b, 'h', s.h, 'c', s.c)))"
            folds[f"__t_{n}"] = F.expr(f"aggregate(__all, {start}, (s, x) -> {step})")
        return g.withColumns(folds)

    def prefixes(g: DataFrame, by: list[str], place: str, prefix: str) -> DataFrame:
        """One row per item again, with the state before it."""
        at = F.posexplode(f"__all.{place}").alias("__i", place)
        out = g.select(*by, at, *[F.col(f"__t_{n}.out").alias(f"__o_{n}") for n in names])
        return out.select(*by, place, *[F.col(f"__o_{n}")[F.col("__i")].alias(f"{prefix}{n}") for n in names])

    keys = list(s.keys)
    low = folded(blocks.withColumn("__group", F.expr(f"{BLOCK} div {fan}")), [*keys, "__group"], BLOCK, size)
    totals = low.select(*keys, "__group", *[F.struct(*[F.col(f"__t_{n}.{c}").alias(c) for c in "bhc"]).alias(f"__{n}") for n in names])
    high = prefixes(folded(totals, keys, "__group", size * fan), keys, "__group", "__u_")
    carry = _match(prefixes(low, [*keys, "__group"], BLOCK, "__p_"), high, (*keys, "__group"))
    before = {}
    for n in names:
        d, up, own = parts[n][1], F.col(f"__u_{n}"), F.col(f"__p_{n}")
        scale = F.pow(F.lit(d), (F.col(BLOCK) - F.col("__group") * fan).cast("double") * size)
        before[f"__y_{n}"] = scale * (up["b"] + up["c"]) + own["b"] + F.when(up["h"], 0.0).otherwise(own["c"])
        before[f"__seen_{n}"] = up["h"] | own["h"]
    carry = carry.withColumns(before).select(*keys, BLOCK, *before)

    b = Blocks(s.keys, size)
    joined = _match(rows, carry, (*keys, BLOCK))
    outs, step = {}, b.step().cast("double")
    for n, (x, d) in parts.items():
        v = F.col(x).cast("double")
        grow = F.pow(F.lit(1.0 / d), step)
        local = F.coalesce(F.sum(v * (1 - d) * grow).over(b.run) / grow, F.lit(0.0))
        first = F.first(F.when(v.isNotNull(), F.struct(F.col(POS).alias("p"), v.alias("x"))), True).over(b.run)
        seed = F.when(F.col(f"__seen_{n}"), 0.0).otherwise(d * first["x"] * F.pow(F.lit(d), (F.col(POS) - first["p"]).cast("double")))
        outs[n] = F.when(F.col(f"__seen_{n}") | first.isNotNull(), local + F.pow(F.lit(d), step + 1) * F.col(f"__y_{n}") + seed)
    return joined.withColumns(outs | plain).drop(BLOCK, *before)
