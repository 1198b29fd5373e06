"""Exact top-k by inner product with sorted lists and no random access (operator 3).

Candidates are dealt to shards and queries to groups; a cell, one shard with one group, is a task of bounded
size.  A shard keeps, for each component, a list of its vectors sorted by that component.  A query reads the lists
in order of their weight: the heavy ones to their end, the others' heads from the query's better side.  What it has read of a vector gives a
lower and an upper bound of its score: for the parts not read, by the length that the vector has left against that of the query, and
above also by the frontiers of the heads.  It reads on, list after list, until the k-th best lower bound leaves
few vectors with a higher upper bound, so that no other can qualify, and resolves the final scores of those.
The k best of each shard meet, per query, in a last ranking.

Components are floor(256 * x) as integers.  Vectors that are null, or hold null or non-finite components, take
no part; shorter vectors read 0 for missing components; empty vectors score 0.  Rows that share a vec_id are one
candidate with its best score, a query never finds its own id, and queries that share an id are one query with
the best scores of each.  Rows with a null id take no part.  Ties go to the smaller id.  An empty table gives an
empty table; other columns of the input are ignored.  Scores are exact while they fit 53 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidegauge.session import prepare

SHARD_ROWS, GROUP_ROWS = 8192, 2048
#: Shares of a query's squared length that the lists not read to their end may hold when bounds are compared, and the part of such lists that is read.
UNREAD, HEAD = (0.1, 0.04, 0.015, 0.005), 0.125
FEW = 0.02


def components(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and v, the integer components of the vectors that take part."""
    x = F.transform(vector, lambda c: c.cast("double"))
    sound = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(sound).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * 256)).alias("v"))


class Shard:
    """Candidates of a cell with a sorted list for each component."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.lists = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T)
        self.parts = np.ascontiguousarray(x.T.astype(np.float64))  # component by component, to read a list to its end
        self.values = np.take_along_axis(self.parts, self.lists, 1)
        self.squares = self.parts**2
        self.length = self.squares.sum(0)
        self.head = max(1, int(HEAD * len(ids)))

    def best(self, key: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best vectors of other ids, best first, equal scores by id."""
        n, weight = len(self.ids), q.astype(np.float64)
        want = min(k + int((self.ids == key).sum()), n)  # the query's own rows may be among the best
        order = np.argsort(-np.abs(weight), kind="stable")
        behind = np.append(np.cumsum((weight[order] ** 2)[::-1])[::-1], 0)  # squared length of the weights from each list on
        known, left, read = np.zeros(n), self.length.copy(), 0
        alive = np.arange(n)
        for share in UNREAD if len(order) else ():
            while behind[read] > share * behind[0]:
                d = order[read]
                known += weight[d] * self.parts[d]
                left -= self.squares[d]
                read += 1
            turned = np.sqrt(np.maximum(left, 0) * behind[read])
            upper = known + np.minimum(turned, self._heads(order[read:], weight))
            floor = np.partition(known - turned, n - want)[n - want]
            alive = np.flatnonzero(upper >= floor - 1e-9 * (abs(floor) + 1))
            if len(alive) <= max(FEW * n, 4 * want):
                break
        score = self.x[alive] @ q
        order = np.lexsort((self.ids[alive], -score))
        out: dict[int, int] = {}
        for at in order:
            i = int(self.ids[alive[at]])
            if i != key and i not in out:
                out[i] = int(score[at])
                if len(out) == k:
                    break
        if len(out) < k and len(alive) < n and len(np.unique(self.ids)) < n:  # ids repeat: fewer vectors than rows were found
            return self._all(key, q, k)
        return [(s, i) for i, s in out.items()]

    def _all(self, key: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        score = self.x @ q
        out: dict[int, int] = {}
        for at in np.lexsort((self.ids, -score)):
            out.setdefault(int(self.ids[at]), int(score[at]))
        out.pop(key, None)
        return [(s, i) for i, s in list(out.items())[:k]]

    def _heads(self, lists: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What these lists can add at most: what their heads show, and their frontiers for vectors not in the heads."""
        n, t = len(self.ids), self.head
        up, down = lists[weight[lists] > 0], lists[weight[lists] < 0]
        values = np.concatenate([self.values[up, n - t :] * weight[up, None], self.values[down, :t] * weight[down, None]])
        if not len(values):
            return np.zeros(n)
        frontier = values.min(1, keepdims=True)
        at = np.concatenate([self.lists[up, n - t :], self.lists[down, :t]])
        return frontier.sum() + np.bincount(at.ravel(), (values - frontier).ravel(), n)


def _matrix(column: pa.ChunkedArray, wide: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = flat.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(flat), wide), np.int64)
    out[np.arange(wide) < sizes[:, None]] = flat.flatten().to_numpy(zero_copy_only=False)
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Best ``k`` others of every query row against all rows: query_id, rank (from 1), vec_id, score.

    ``is_query`` is a condition on the key column.  Rows are dealt to cells evenly, whatever their ids.
    """
    prepare(vectors.sparkSession)
    rows = components(vectors, key, vector)
    asked = components(vectors.filter(is_query), key, vector)
    n = rows.count()
    shards, groups = max(1, -(-n // shard_rows)), max(1, -(-asked.count() // group_rows))
    spread = lambda m: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(m))
    rows = rows.withColumn("shard", spread(shards)).select("id", "v", F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.col("shard") * groups + g)).alias("cell"))
    asked = asked.withColumn("group", spread(groups)).select("id", "v", F.explode(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s * groups + F.col("group"))).alias("cell"))

    def cell(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if queries.num_rows and candidates.num_rows:
            wide = max(max(t.column("v").combine_chunks().value_lengths().to_pylist()) for t in (queries, candidates))
            shard = Shard(candidates.column("id").to_numpy(), _matrix(candidates.column("v"), wide))
            for i, q in zip(queries.column("id").to_pylist(), _matrix(queries.column("v"), wide)):
                found += [(i, v, s) for s, v in shard.best(i, q, k)]
        return pa.table([pa.array(x, pa.int64()) for x in zip(*found)] or [pa.array([], pa.int64())] * 3, names=["query_id", "vec_id", "score"])

    met = asked.groupBy("cell").cogroup(rows.groupBy("cell")).applyInArrow(cell, "query_id long, vec_id long, score long")
    met = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.id AS query_id, c.id AS vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""
