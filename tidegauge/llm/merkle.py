"""Merkle manifest of a dataset with a proof for every document, by pointer jumping (operator 11).

Leaves are digests of whole rows.  Those of a source stand in the order of their ids and form a tree of runs of
three; the tops of all sources, in the order of the sources, form one more tree.

1. Order: rows are dealt by ranges of (source, id, leaf) and sorted, so a hot source spreads over tasks.  Positions
   come from the row number in the task and from counts per (task, source).
2. Trees: one shuffle deals 3^5 neighbours together and builds five levels from them; nodes are told by
   (tree, level, place), and each knows the range of leaves under it.
3. Proofs: every node starts with its siblings and a pointer to its parent.  Each round joins the table to itself
   on the pointer: the segment of the node pointed at is put behind the own one, its pointer is taken over, and so
   the distance doubles until all leaves point beyond the root.  A node that many point at is repeated once for
   each 20 000 leaves under it, and those below join the copy of their own block of leaves, so no join key has more
   rows than that.  Every round is a stored table.

``manifest`` then folds each leaf, or the leaf of a tampered row, with its proof and compares the end with the root.

Null fields are part of the leaf as ``-`` (so null and empty differ); null sources are one source, the first; rows
with null ids come first in their source and are never tampered.  Rows of one id stand in the order of their leaves;
equal rows have equal leaves and differ in their place only.  A text of any length is hashed inside its row.  An
empty table gives an empty table.  Other columns of the input are ignored, whatever their names.

Driver: one digest, four counts, and the number of rounds, which follows the depth.  The one window without a
partition is over one row per sorted task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import Stored

RUN = 3  # fixed values of the contract: nodes of a run and fields of a leaf
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 5
BLOCK = 20_000
TOP = -1  # the tree over the sources; trees of sources are numbered from 0
POWERS = [RUN**k for k in range(40)]
ROW_BITS = 33  # Spark's running row number holds the task above these bits
NODE = "struct<left:binary,right:binary>"


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """Digest of a row, as 32 bytes; ``text`` stands in for the row's own."""
    parts = [_field(text if text is not None and c == "text" else F.col(c)) for c in FIELDS]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def tampered(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 2 == 0, F.lit(False))


def _hexed(b: Column) -> Column:
    return F.lower(F.hex(b))


def _joined(digests: str) -> str:
    """SQL for the bytes of consecutive digests' hex text."""
    return f"array_join(transform({digests}, x -> lower(hex(x))), '')"


def depth(n: str) -> Column:
    """Levels above the leaves of a tree with n leaves."""
    return F.expr(f"size(filter(array({', '.join(f'{p}L' for p in POWERS)}), p -> p < {n}))")


def depth_of(n: int) -> int:
    return sum(p < n for p in POWERS)


def ordered(docs: DataFrame, stored: Stored) -> DataFrame:
    """Leaves with their place: tree (number of the source), pos in it, deep (levels above it), g (place among all leaves)."""
    cut = F.when(tampered(), leaf(F.translate("text", "\n", "")))
    rows = docs.select("doc_id", "source", leaf().alias("leaf"), cut.alias("changed"))
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = stored.put(rows).withColumns({"task": F.shiftright("at", ROW_BITS), "row": F.col("at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))})
    rows = rows.withColumns({"named": F.col("source").isNotNull(), "name": F.coalesce("source", F.lit(""))}).drop("at", "source")

    source = ["named", "name"]
    parts = rows.groupBy("task", *source).agg(F.count("*").alias("rows"), F.min("row").alias("first"))
    before = Window.partitionBy(*source).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"done": F.coalesce(F.sum("rows").over(before), F.lit(0)), "n": F.sum("rows").over(Window.partitionBy(*source))})
    starts = (F.col("done") == 0).cast("long")
    prior = Window.partitionBy("task").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("started", F.coalesce(F.sum(starts).over(prior), F.lit(0)))
    across = Window.partitionBy(F.lit(0)).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = parts.groupBy("task").agg(F.sum("rows").alias("r"), F.sum(starts).alias("s"))
    tasks = tasks.select("task", *[F.coalesce(F.sum(c).over(across), F.lit(0)).alias(f"{c}_before") for c in "rs"])
    parts = parts.join(tasks, "task")
    number = F.max(F.when(F.col("done") == 0, F.col("s_before") + F.col("started"))).over(Window.partitionBy(*source))
    parts = parts.select("task", *source, depth("n").alias("deep"), number.alias("tree"), (F.col("done") - F.col("first")).alias("shift"), "r_before")
    return rows.join(parts, ["task", *source]).select(
        "tree", (F.col("row") + F.col("shift")).alias("pos"), "deep", (F.col("r_before") + F.col("row")).alias("g"), "doc_id", "leaf", "changed"
    )


def climb(front: DataFrame, deepest: int, stored: Stored) -> tuple[list[DataFrame], DataFrame | None]:
    """Build trees from their leaves (tree, deep, pos, digest, a, b, pay).

    Gives tables of all nodes below the tops, each with its siblings' digests on the left and on the right and the
    range [a, b) of leaves under it, and a table of the tops.
    """
    nodes, tops, level, pay = [], None, 0, front.schema["pay"].dataType
    while level < deepest:
        c = min(LEVELS, deepest - level)
        g = front.filter(F.col("deep") > level).groupBy("tree", "deep", F.expr(f"pos div {RUN**c}").alias("base"))
        g = g.agg(F.expr("array_sort(collect_list(struct(pos, a, b, digest, pay)))").alias("all"))
        g = g.selectExpr("tree", "deep", "base", "all.digest AS h0", "all.a AS a0", "all.b AS b0", "all.pay AS pay")
        for k in range(c):
            runs = f"transform(sequence(0, int((size(h{k}) - 1) div {RUN})), i -> %s)"
            up = {
                f"h{k + 1}": f"unhex(sha2({_joined(f'slice(h{k}, i * {RUN} + 1, {RUN})')}, 256))",
                f"a{k + 1}": f"a{k}[i * {RUN}]",
                f"b{k + 1}": f"b{k}[least(i * {RUN} + {RUN}, size(b{k})) - 1]",
            }
            g = g.withColumns({name: F.expr(runs % one) for name, one in up.items()})
        g = stored.put(g)
        nodes.append(_nodes(g, level, c, pay))
        for k in range(1, c + 1):  # trees of this depth end here
            ended = g.filter(F.col("deep") == level + k).selectExpr("tree", f"h{k}[0] AS digest", f"a{k}[0] AS a", f"b{k}[0] AS b")
            tops = ended if tops is None else tops.union(ended)
        front = g.selectExpr("tree", "deep", "base AS pos", f"h{c}[0] AS digest", f"a{c}[0] AS a", f"b{c}[0] AS b").withColumn("pay", F.lit(None).cast(pay))
        level += c
    return nodes, tops


def _nodes(g: DataFrame, level: int, c: int, pay) -> DataFrame:
    tiers = []
    for k in range(c):
        own = "pay[j]" if level + k == 0 else f"CAST(NULL AS {pay.simpleString()})"
        left = f"unhex({_joined(f'slice(h{k}, j - j % {RUN} + 1, j % {RUN})')})"
        right = f"unhex({_joined(f'slice(h{k}, j + 2, {RUN - 1} - j % {RUN})')})"
        node = f"{level + k} AS level, base * {RUN ** (c - k)}L + j AS pos, a{k}[j] AS a, b{k}[j] AS b, array(struct({left} AS left, {right} AS right)) AS seg, {own} AS pay"
        tiers.append(f"transform(sequence(0, size(h{k}) - 1), j -> struct({node}))")
    every = g.select("tree", "deep", F.explode(F.expr(f"flatten(array({', '.join(tiers)}))")).alias("x"))
    return every.select("tree", "deep", "x.*").filter("level < deep")


def _pointed(nodes: DataFrame, top_depth: int) -> DataFrame:
    """The parent of each node as (tt, tl, tp); null where it is the root."""
    inner = F.col("level") + 1 < F.col("deep")
    up = {
        "tt": F.when(inner, F.col("tree")).otherwise(F.lit(TOP).cast("long")),
        "tl": F.when(inner, F.col("level") + 1).otherwise(F.lit(0)),
        "tp": F.when(inner, F.expr(f"pos div {RUN}")).otherwise(F.col("tree")),
    }
    to_root = ~inner & ((F.col("tree") == TOP) | F.lit(top_depth == 0))
    return nodes.select("tree", "level", "pos", "a", "b", *[F.when(~to_root, x).alias(c) for c, x in up.items()], "seg", "pay")


def jump(table: DataFrame) -> DataFrame:
    """One round: distance doubled for all nodes that have not reached the root."""
    block = lambda c: F.expr(f"{c} div {BLOCK}")
    to = table.select(
        F.col("tree").alias("tt"), F.col("level").alias("tl"), F.col("pos").alias("tp"), F.col("tt").alias("nt"), F.col("tl").alias("nl"), F.col("tp").alias("np"),
        F.col("seg").alias("more"), F.explode(F.sequence(block("a"), block("(b - 1)"))).alias("block"),
    )
    going = table.filter("tt IS NOT NULL").withColumn("block", block("a")).join(to, ["tt", "tl", "tp", "block"])
    going = going.select("tree", "level", "pos", "a", "b", F.col("nt").alias("tt"), F.col("nl").alias("tl"), F.col("np").alias("tp"), F.concat("seg", "more").alias("seg"), "pay")
    return going.union(table.filter("tt IS NULL"))


def prove(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, changed (leaf of the tampered row, where there is one), seg (the siblings of
    each level from below, bytes of the digests on the left and on the right), depth (levels up to the subroot), root."""
    stored = Stored(docs, "merkle")
    rows = ordered(docs, stored)
    pay = F.struct("doc_id", "leaf", "changed", F.col("deep").alias("depth")).alias("pay")
    rows = rows.select("tree", "deep", "pos", F.col("leaf").alias("digest"), F.col("g").alias("a"), (F.col("g") + 1).alias("b"), pay)
    total, sources, deepest = rows.agg(F.count("*"), F.max("tree") + 1, F.max("deep")).first()
    if total <= 1:
        one = rows.select("pay.*", F.array().cast(f"array<{NODE}>").alias("seg"))
        return one.withColumn("root", _hexed(F.col("leaf")))
    over = depth_of(sources)
    nodes, tops = climb(rows, deepest, stored)
    lone = rows.filter("deep = 0").select("tree", "digest", "a", "b", "pay")
    tops = lone if tops is None else lone.union(tops.withColumn("pay", F.lit(None).cast(rows.schema["pay"].dataType)))
    if over:
        above = tops.select(F.lit(TOP).cast("long").alias("tree"), F.lit(over).alias("deep"), F.col("tree").alias("pos"), "digest", "a", "b", "pay")
        more, tops = climb(above, over, stored)
        nodes += more
    root = tops.select(_hexed(F.col("digest"))).first()[0]

    table = _pointed(nodes[0], over)
    for t in nodes[1:]:
        table = table.union(_pointed(t, over))
    reach, put = 1, 0
    while reach < deepest + over:
        table, reach = jump(table), 2 * reach
        if reach < deepest + over:  # from now on only nodes at this distance from leaves are pointed at
            table = table.filter((F.col("tree") == TOP) | (F.col("level") % reach == 0))
            table, put = stored.put(table, replaces=min(put, 1)), put + 1
    return table.filter("pay IS NOT NULL").select("pay.*", "seg").withColumn("root", F.lit(root))


def fold(start: Column, seg: Column) -> Column:
    """Hex digest reached from a leaf (bytes) through its siblings."""
    return F.aggregate(seg, _hexed(start), lambda h, s: F.sha2(F.concat(_hexed(s["left"]), h, _hexed(s["right"])), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    p = prove(docs)
    siblings = F.array_join(F.transform("seg", lambda s: F.concat(_hexed(s["left"]), _hexed(s["right"]))), "")
    p = p.select(
        "doc_id", _hexed(F.col("leaf")).alias("leaf"),
        fold(F.col("leaf"), F.slice("seg", 1, F.col("depth"))).alias("subroot"),
        "root", F.sha2(siblings, 256).alias("proof_sha256"),
        fold(F.coalesce("changed", "leaf"), F.col("seg")).alias("folded_root"),
    )
    return p.withColumn("verified", F.col("folded_root") == F.col("root"))


_LEAF = " || ".join(f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in FIELDS)
SQL = f"""
WITH RECURSIVE d AS (SELECT *, coalesce(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
      lambda i: list_transform(range(0, 8), lambda b: CAST((ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) >> b) & 1 AS BIGINT))))),
    lambda s, b: xor(s >> 1, 3988292384::BIGINT * (xor(s, b) & 1))) % 2 = 1, false) AS cut FROM documents),
l AS (SELECT doc_id, source, sha256({_LEAF}) AS leaf,
    CASE WHEN cut THEN sha256({_LEAF.replace("(text AS", "(replace(text, chr(10), '') AS")}) END AS changed FROM d),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
    dense_rank() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS tree FROM l),
up AS (SELECT tree, n, 0 AS level, pos, leaf AS h FROM o
  UNION ALL SELECT tree, (n + 2) // 3, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, n, level, pos // 3),
subs AS MATERIALIZED (SELECT tree, h, count(*) OVER () AS n FROM up WHERE n = 1),
over AS (SELECT n, 0 AS level, tree AS pos, h FROM subs
  UNION ALL SELECT (n + 2) // 3, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM over WHERE n > 1 GROUP BY n, level, pos // 3),
root AS (SELECT h AS root FROM over WHERE n = 1),
every AS (SELECT tree, level, pos, n, h FROM up UNION ALL SELECT -1, level, pos, n, h FROM over),
sib AS MATERIALIZED (SELECT tree, level, pos, n,
    coalesce(string_agg(h, '') OVER (PARTITION BY tree, level, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
    coalesce(string_agg(h, '') OVER (PARTITION BY tree, level, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM every),
walk AS (SELECT row_number() OVER () AS id, doc_id, leaf, tree AS src, tree, 0 AS level, pos, '' AS proof, coalesce(changed, leaf) AS h FROM o
  UNION ALL SELECT w.id, w.doc_id, w.leaf, w.src, CASE WHEN s.n > 1 THEN w.tree ELSE -1 END, CASE WHEN s.n > 1 THEN w.level + 1 ELSE 0 END,
    CASE WHEN s.n > 1 THEN w.pos // 3 ELSE w.tree END, CASE WHEN s.n > 1 THEN w.proof || s.lft || s.rgt ELSE w.proof END,
    CASE WHEN s.n > 1 THEN sha256(s.lft || w.h || s.rgt) ELSE w.h END
    FROM walk w JOIN sib s ON s.tree = w.tree AND s.level = w.level AND s.pos = w.pos WHERE s.n > 1 OR w.tree >= 0)
SELECT doc_id, leaf, subs.h AS subroot, root, sha256(proof) AS proof_sha256, walk.h AS folded_root, walk.h = root AS verified
FROM walk JOIN sib s ON s.tree = walk.tree AND s.level = walk.level AND s.pos = walk.pos JOIN subs ON subs.tree = walk.src CROSS JOIN root WHERE walk.tree = -1 AND s.n = 1
"""
