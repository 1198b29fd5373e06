"""Short codes for vectors, with nearest entries found in a GNAT (operator 13).

A vector of integers is cut into equal parts, and each part is told by the number of its nearest entry in the
codebook of its place.  Codebooks start as the parts of the vectors with the smallest ids and are moved to the mean
of their parts in a fixed number of rounds, each one pass over all rows: tasks add up sums per entry, and one row
for each entry comes to the driver (256 a part, whatever the number of vectors).

The nearest entry is found in a geometric near-neighbour access tree over the entries (``Gnat``).  A node holds a few
split points far from each other; every other entry belongs to the nearest split point, and the node keeps, for each
split point and each child, the least and the greatest distance from the point to the entries of the child.  A query
measures its distance to the split points; a child is left out if the triangle inequality puts all its entries
strictly beyond the nearest entry so far.  Distances are square roots in floating point, so this comparison keeps a
margin above their rounding; what it does not leave out is compared by exact integer squares, ties to the lower
number.  So codes are those of a full search.

Rows whose vector is null or holds null, NaN or infinite components are dropped.  Null ids come last when the first
codebooks are chosen, rows of one id by their vectors; they and repeated rows are rows like others.  Null labels are
one label.  With fewer vectors than entries the codebooks are as short.  An empty table gives an empty table.  Vectors
of any length will do, but all must have one length, divisible by the number of parts, and squares must fit 63 bits;
else the job stops with an error that says so.  Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import Stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024  # fixed values of the contract
FAN = 16  # split points of a node; a node of no more entries is a leaf
MARGIN = 2.0**-48
ROWS = 4096
HOT = 1000


def squares(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact squared distances between integer rows, by a product of doubles where all terms stay below 2^53."""
    top = float(max(np.abs(q).max(initial=0), np.abs(p).max(initial=0)))
    if 4 * top * top * q.shape[1] < 2.0**53:
        a, b = q.astype(np.float64), p.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)).astype(np.int64)
    return np.stack([((q - row) ** 2).sum(1) for row in p], axis=1)


class Gnat:
    """The tree over one codebook (rows of integers)."""

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.int64)
        self.measured = 0  # distances to entries measured so far
        self.root = self._build(np.arange(len(points)))

    def _build(self, ids: np.ndarray) -> dict | None:
        if not len(ids):
            return None
        if len(ids) <= FAN:
            return {"ids": ids}
        own = self.points[ids]
        chosen = [0]
        far = squares(own, own[:1])[:, 0]
        for _ in range(FAN - 1):  # the entry farthest from all chosen ones comes next; equal entries fall to one
            far[chosen] = -1
            chosen.append(int(far.argmax()))
            far = np.minimum(far, squares(own, own[chosen[-1:]])[:, 0])
        chosen.sort()
        split = ids[chosen]
        rest = np.delete(np.arange(len(ids)), chosen)
        to = squares(own[rest], self.points[split])
        belongs = to.argmin(1)
        low, high = np.full((FAN, FAN), np.inf), np.full((FAN, FAN), -np.inf)
        children = []
        for j in range(FAN):
            of = belongs == j
            if of.any():
                d = np.sqrt(to[of].astype(np.float64))
                low[:, j], high[:, j] = d.min(0), d.max(0)
            children.append(self._build(ids[rest[of]]))
        return {"ids": split, "children": children, "low": low, "high": high}

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry and its squared distance, for each row."""
        at = np.full(len(q), len(self.points), np.int64)
        best = np.full(len(q), np.iinfo(np.int64).max, np.int64)
        if len(q):
            self._visit(self.root, q, np.arange(len(q)), at, best)
        return at, best

    def _visit(self, node: dict, q: np.ndarray, rows: np.ndarray, at: np.ndarray, best: np.ndarray) -> None:
        d2 = squares(q[rows], self.points[node["ids"]])
        self.measured += d2.size
        first = d2.argmin(1)  # ids ascend, so a tie falls to the lower one
        least, ids = d2[np.arange(len(rows)), first], node["ids"][first]
        better = (least < best[rows]) | ((least == best[rows]) & (ids < at[rows]))
        best[rows[better]], at[rows[better]] = least[better], ids[better]
        if "children" not in node:
            return
        d = np.sqrt(d2.astype(np.float64))
        for near in (True, False):  # the child of the nearest split point first: it makes the others easier to leave out
            for j, child in enumerate(node["children"]):
                if child is None:
                    continue
                mine = np.flatnonzero((first == j) == near)
                if not near and len(mine):
                    mine = mine[~self._beyond(d[mine], np.sqrt(best[rows[mine]].astype(np.float64)), node["low"][:, j], node["high"][:, j])]
                if len(mine):
                    self._visit(child, q, rows[mine], at, best)

    @staticmethod
    def _beyond(d: np.ndarray, radius: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Rows for which some split point proves all entries of a child strictly farther than the radius."""
        r = radius[:, None]
        slack = (d + r + np.maximum(low, high)) * MARGIN
        return ((low - d - r > slack) | (d - high - r > slack)).any(1)


def integers(column: pa.ListArray, parts: int) -> np.ndarray:
    """Rows x parts x width of scaled, floored components."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False) * SCALE).astype(np.int64)
    return x.reshape(len(column), parts, -1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def adder(books: np.ndarray) -> Callable:
    """Task that adds up its rows per (part, entry)."""
    parts, entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in books]
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in _slices(batches):
            x = integers(batch.column(0), parts)
            for p in range(parts):
                at, _ = trees[p].nearest(x[:, p])
                order = np.argsort(at, kind="stable")
                ids, begin = np.unique(at[order], return_index=True)
                total[p, ids] += np.add.reduceat(x[order, p], begin, axis=0)
                count[p] += np.bincount(at, minlength=entries)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))],
            ["part", "entry", "count", "total"],
        )

    return add


def coder(books: np.ndarray) -> Callable:
    """Task that gives each row its code and error; the columns behind the vector stay."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in books]
        for batch in _slices(batches):
            x = integers(batch.column(0), len(books))
            found = [t.nearest(x[:, p]) for p, t in enumerate(trees)]
            text = ["".join(f"{e:02x}" for e in row) for row in np.stack([at for at, _ in found], 1).tolist()]
            error = np.sum([d for _, d in found], 0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(text, pa.string()), pa.array(error, pa.int64())], [*batch.schema.names[1:], "code", "error"])

    return code


def fit(rows: DataFrame, dim: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks (parts x entries x width) from rows with the columns vector and key."""
    start = rows.orderBy(F.col("key").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    x = np.floor(np.array([r[0] for r in start], np.float64) * SCALE).astype(np.int64).reshape(len(start), parts, dim // parts)
    books = x.transpose(1, 0, 2).copy()
    for _ in range(rounds):
        partial = rows.select("vector").mapInArrow(adder(books), "part int, entry int, count bigint, total array<bigint>")
        sums = partial.groupBy("part", "entry").agg(F.sum("count").alias("n"), *[F.sum(F.col("total")[i]) for i in range(dim // parts)])
        for r in sums.collect():
            books[r["part"], r["entry"]] = [s // r["n"] for s in r[3:]]
    return books


def told(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """One row per sound vector: vec_id, label, code, error, label_error, codebooks_sha256."""
    stored = Stored(vectors, "codes")
    v = F.col("vector")
    rows = vectors.select(F.col(vector).cast("array<double>").alias("vector"), F.col(key).alias("key"), F.col(label).alias("label"))
    rows = rows.filter(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    largest = F.aggregate(v, F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    count, short, dim, top = rows.agg(F.count("*"), F.min(F.size(v)), F.max(F.size(v)), F.max(largest)).first()
    fields = [T.StructField(n, rows.schema[n].dataType) for n in ("key", "label")]
    if count and (short != dim or dim % parts):
        raise ValueError(f"vectors have {short} to {dim} components; one number for all is needed, divisible by {parts}")
    if count and 4 * (top * SCALE + 1) ** 2 * dim >= 2.0**63:
        raise ValueError("squared distances would not fit 63 bits")
    if not entries <= 256:
        raise ValueError("two hex digits tell at most 256 entries")
    books = fit(rows, dim, parts, entries, rounds) if count else np.zeros((parts, 0, 0), np.int64)
    coded = rows.select("vector", "key", "label").mapInArrow(coder(books), T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))
    coded = stored.put(coded)
    by = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    common = F.col("n") >= max(1, count // HOT)  # so at most about a thousand labels are sent to all tasks
    same = F.col("label").eqNullSafe(F.col("of"))
    sent = F.broadcast(by.filter(common).drop("n"))
    rest = coded.join(sent, same, "left_anti").join(by.filter(~common).drop("n").hint("merge"), same)
    every = coded.join(sent, same).union(rest)
    return every.select(F.col("key").alias(key), F.col("label").alias(label), "code", "error", "label_error", F.lit(told(books)).alias("codebooks_sha256"))


def _sql() -> str:
    parts = [
        f"k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // {PARTS} + 1:(p + 1) * len(v) // {PARTS}] AS v FROM k CROSS JOIN range(0, {PARTS}) r(p))",
        f"b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM x QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {ENTRIES})",
    ]
    for i in range(ROUNDS + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (SELECT vec_id, p, min((s, e)) AS best FROM (SELECT x.vec_id, x.p, b.e,
        CAST(list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS s FROM x JOIN b{i} b ON b.p = x.p) GROUP BY 1, 2)"""
        )
        if i < ROUNDS:
            parts.append(
                f"""m{i} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY c) AS v FROM (SELECT p, e, c, sum(y)::BIGINT AS s, count(*) AS n
        FROM (SELECT x.p, a.best[2] AS e, unnest(range(len(x.v))) AS c, unnest(x.v) AS y FROM x JOIN a{i} a ON a.vec_id = x.vec_id AND a.p = x.p) GROUP BY 1, 2, 3) GROUP BY 1, 2),
        b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN m{i} m ON m.p = b.p AND m.e = b.e)"""
            )
    return f"""WITH {", ".join(parts)},
o AS (SELECT vec_id, string_agg(format('{{:02x}}', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY 1)
SELECT o.vec_id, k.label, code, error, CAST(sum(error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b{ROUNDS}) AS codebooks_sha256 FROM o JOIN k USING (vec_id)"""


SQL = _sql()
