"""Mixing sources to target weights with a splitting tree (operator 7), in DataFrame operations only.

Documents of a source are dealt by hash to blocks of about equal words, and the blocks take a permuted order.
A source's target is so many whole passes over its blocks and then the first blocks of one more; the block at
the border gives its first documents, the last of them in part, so the words taken meet the target exactly.
The block draws of all sources are split among output shards by a tree: each node deals half of its draws to
either side, with the numbers per source drawn from the multivariate hypergeometric distribution (one source
after the other, by inversion from the mode).  Quotas stay exact, and each shard gets a run of the permuted
order of its own, so shards share no draw.  Inside a shard rows are ordered by hash.

Only sizes are read from texts, once, into a stored table.  A source of any share of the rows is spread over
its blocks; only sums per block and per source pass a window.  Reruns give the same rows.

Null texts and texts without words have size 0 and are taken 0 times; null sources form one source, the last;
repeated rows count each; ids may be null or repeat; an empty table gives an empty table; other columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidegauge.llm.common import BLANK, Stored, whole

WEIGHTS = (3, 1, 2)
SHARE, CEILING = 1.5, 2
BLOCK_WORDS, MOST_BLOCKS = 65_536, 1 << 20


def words(column: str = "text") -> Column:
    """Number of runs of characters that are not white space.  Each run, with the space around it, becomes one character."""
    text = whole(column)
    counted = F.length(F.regexp_replace(text, f"[{BLANK}]*+[^{BLANK}]++[{BLANK}]*+", "x"))
    return F.when(F.length(F.regexp_replace(F.substring(text, 1, 64), f"[{BLANK}]+", "")) > 0, counted).when(text.rlike(f"[^{BLANK}]"), counted).otherwise(0).cast("long")


def hashed(*of: Column | str) -> Column:
    """60 bits of the MD5 of the parts, joined by '/'; null parts read '~'."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("~")) for c in of]
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """One row per source: source, src (place from 0), source_size, target.

    Sources stand by code point, null last, and the weights repeat along them.  A source's target is its weight
    times a common level, but ``ceiling`` times its size at most; the level is found where the capped sources
    are those that reach their ceiling first.
    """
    order = F.col("source").asc_nulls_last()
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("src", F.row_number().over(W.orderBy(order)) - 1)
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("src") % len(weights) + 1))
    by = by.withColumn("cap", F.col("source_size") * float(ceiling)).withColumn("reach", F.col("cap") / F.col("weight"))
    every = W.partitionBy()
    by_reach = W.orderBy("reach", "src")
    by = by.withColumns({
        "all_words": F.sum("source_size").over(every) * float(share),
        "capped": F.coalesce(F.sum("cap").over(by_reach.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("weight").over(by_reach.rowsBetween(0, W.unboundedFollowing)),
    })
    by = by.withColumn("level", (F.col("all_words") - F.col("capped")) / F.col("open"))
    by = by.withColumn("level", F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", "src", "level"))).over(every)["level"])
    return by.select("source", "src", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(population: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Number of marked among those drawn without replacement, by inversion of ``u`` in [0, 1).

    Probabilities are relative to the mode's and follow from each other by ratios.  Values are tried from the
    mode upwards and then downwards, over twelve deviations: what lies beyond cannot be told from 0.
    """
    n, k, d = population.cast("double"), marked.cast("double"), drawn.cast("double")
    low, high = F.greatest(F.lit(0.0), d - (n - k)), F.least(d, k)
    mode = F.least(high, F.greatest(low, F.floor((d + 1) * (k + 1) / (n + 2)).cast("double")))
    width = F.ceil(12 * F.sqrt(d * k * (n - k) * (n - d) / F.greatest(n * n * (n - 1), F.lit(1.0)))) + 12
    start = F.struct(n.alias("n"), k.alias("k"), d.alias("d"), mode.alias("mode"), F.greatest(low, mode - width).alias("low"), F.least(high, mode + width).alias("high"))

    def ratio(s, x):  # probability of x + 1 over that of x
        return (s["k"] - x) * (s["d"] - x) / ((x + 1) * (s["n"] - s["k"] - s["d"] + x + 1))

    def walk(s, goal):
        """Over the values: probability of the next, sum so far, and the first value whose sum passes the goal."""
        none = F.lit(None).cast("double")

        def up(a, i):
            x = s["mode"] + i
            total = a["sum"] + a["p"]
            return F.struct((a["p"] * ratio(s, x)).alias("p"), total.alias("sum"), F.coalesce(a["found"], F.when(total > goal, x)).alias("found"))

        def down(a, i):
            x = s["mode"] - i
            p = a["p"] / ratio(s, x)
            total = a["sum"] + p
            return F.struct(p.alias("p"), total.alias("sum"), F.coalesce(a["found"], F.when(total > goal, x)).alias("found"))

        first = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"), none.alias("found"))
        steps_up = F.sequence(F.lit(0), (s["high"] - s["mode"]).cast("int"))
        steps_down = F.when(s["mode"] > s["low"], F.sequence(F.lit(1), (s["mode"] - s["low"]).cast("int"))).otherwise(F.array().cast("array<int>"))
        return _let(F.aggregate(steps_up, first, up), lambda a: F.aggregate(steps_down, F.struct(F.lit(1.0).alias("p"), a["sum"].alias("sum"), a["found"].alias("found")), down))

    return _let(start, lambda s: _let(walk(s, F.lit(float("inf")))["sum"], lambda total: F.coalesce(walk(s, u * total)["found"], s["mode"]))).cast("long")


def shard_runs(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """The splitting tree: from (src, draws) to (src, ends), the end of each shard's run of the source's draws.

    A node is a row with the draws of each source; the tree holds one number for each source and shard.
    """
    levels = max(0, (shards - 1).bit_length())
    nodes = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("src", "draws"))), lambda x: x["draws"]).alias("counts")).withColumn("node", F.lit(0).cast("long"))
    for level in range(levels):
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
        first = F.struct(total.alias("left"), F.floor((total + F.pmod(F.col("node"), F.lit(2))) / 2).cast("long").alias("draw"), F.array().cast("array<long>").alias("out"))

        salt = F.lit(f"{seed}/{level}")

        def deal(a, k):
            u = hashed(salt, F.col("node"), F.size(a["out"])) / F.lit(float(2**60))  # noqa: B023
            return _let(hypergeometric(a["left"], k, a["draw"], u), lambda h: F.struct((a["left"] - k).alias("left"), (a["draw"] - h).alias("draw"), F.concat(a["out"], F.array(h)).alias("out")))

        nodes = nodes.withColumn("one", F.aggregate("counts", first, deal)["out"])
        nodes = nodes.select(F.posexplode(F.array("one", F.zip_with("counts", "one", lambda x, y: x - y))).alias("side", "counts"), "node")
        nodes = nodes.select("counts", (F.col("node") * 2 + F.col("side")).alias("node"))
    runs = nodes.select("node", F.posexplode("counts").alias("place", "draws"))
    runs = runs.withColumn("end", F.sum("draws").over(W.partitionBy("place").orderBy("node")))
    ends = runs.groupBy("place").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "end"))), lambda x: x["end"]).alias("ends"))
    order = quotas.withColumn("place", F.row_number().over(W.orderBy("src")) - 1)
    return order.join(ends, "place").select("src", "ends")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING, shards: int = 16, block_words: int = BLOCK_WORDS, seed: int = 0, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, draws.

    ``draws`` is an array of (epoch, shard, place, words): where each of its draws goes, and where it stands there.
    The number of shards is rounded up to a power of two.  Blocks hold ``block_words`` words or, beyond 2^20
    blocks in all, evenly more.
    """
    stored = Stored(docs, "mixing")
    slim = stored.put(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), words(text).alias("size")))
    by = targets(slim, weights, share, ceiling)
    block = F.greatest(F.lit(float(block_words)), F.sum("source_size").over(W.partitionBy()) / MOST_BLOCKS)
    by = by.withColumns({
        "blocks": F.greatest(F.lit(1), F.ceil(F.col("source_size") / block)).cast("long"),
        "passes": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"),
    })
    by = stored.put(by.withColumn("rest", F.floor(F.col("target")).cast("long") - F.col("passes") * F.col("source_size")))
    rows = slim.join(by, slim["source"].eqNullSafe(by["source"])).select("doc_id", slim["source"], "size", "src", "source_size", "target", "blocks", "passes", "rest")
    rows = rows.withColumn("block", F.pmod(hashed(F.lit(seed), "doc_id"), F.col("blocks")))
    own = rows.groupBy("src", "block").agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    permuted = W.partitionBy("src").orderBy(hashed(F.lit(seed), F.lit("block"), "block"), "block")
    own = own.withColumn("at", F.row_number().over(permuted) - 1).withColumn("before", F.sum("words").over(permuted.rowsBetween(W.unboundedPreceding, 0)) - F.col("words"))
    own = stored.put(own.withColumn("left", F.greatest(F.lit(0), F.col("rest") - F.col("before"))).select("src", "block", "at", "left", "passes"))
    quotas = own.groupBy("src").agg((F.count("*") * F.max("passes") + F.count_if(F.col("left") > 0)).alias("draws"), F.count("*").alias("filled"))
    runs = stored.put(shard_runs(quotas, shards, seed).join(quotas.select("src", "filled"), "src"))
    rows = rows.join(own.drop("passes"), ["src", "block"])
    inside = W.partitionBy("src", "block").orderBy(hashed(F.lit(seed), F.lit("row"), "doc_id"), "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("left") - (F.sum("size").over(inside) - F.col("size"))))
    rows = rows.withColumn("part", part).join(runs, "src")

    def draw(epoch):
        index = epoch * F.col("filled") + F.col("at")
        taken = F.when(epoch < F.col("passes"), F.col("size")).otherwise(F.col("part"))
        shard = F.size(F.filter("ends", lambda e: e <= index))
        return F.struct(epoch.alias("epoch"), shard.alias("shard"), hashed(F.lit(seed), shard, epoch, "doc_id").alias("place"), taken.alias("words"))

    draws = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes")), draw), lambda d: d["words"] > 0)
    rows = rows.withColumn("draws", draws).withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]))
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", "draws")


def shuffled(mixed: DataFrame) -> DataFrame:
    """The mix itself: one row per draw (shard, place, doc_id, epoch, words), in order within each shard; large shards take several tasks."""
    rows = mixed.select("doc_id", F.explode("draws").alias("d")).select("d.shard", "d.place", "doc_id", "d.epoch", "d.words")
    return rows.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place", "doc_id", "epoch")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
by0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
by1 AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS src FROM by0),
by2 AS (SELECT *, CASE src % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM by1),
by3 AS (SELECT *, cap / weight AS reach FROM by2),
by4 AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY reach, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY reach, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM by3),
lev AS (SELECT arg_min(level, (reach, src)) AS level FROM by4 WHERE level <= reach),
tgt AS (SELECT source, src, source_size, coalesce(least(cap, lev.level * weight), cap) AS target,
          CAST(greatest(1, ceil(source_size / greatest(65536.0::DOUBLE, sum(source_size) OVER () / 1048576.0::DOUBLE))) AS BIGINT) AS blocks
        FROM by4, lev),
par AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM tgt),
d AS (SELECT s.doc_id, s.size, p.*, CAST(floor(target) AS BIGINT) - passes * source_size AS rest,
        CAST('0x' || substr(md5('0/' || coalesce(CAST(doc_id AS VARCHAR), '~')), 1, 15) AS BIGINT) % blocks AS block
      FROM sized s JOIN par p ON s.source IS NOT DISTINCT FROM p.source),
b AS (SELECT src, block, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY ALL),
bb AS (SELECT *, sum(words) OVER (PARTITION BY src ORDER BY substr(md5('0/block/' || block), 1, 15), block ROWS UNBOUNDED PRECEDING) - words AS before FROM b),
c AS (SELECT d.*, greatest(0, rest - before) AS lft,
        sum(size) OVER (PARTITION BY d.src, d.block ORDER BY substr(md5('0/row/' || coalesce(CAST(doc_id AS VARCHAR), '~')), 1, 15), doc_id NULLS FIRST, size
                        ROWS UNBOUNDED PRECEDING) - size AS own
      FROM d JOIN bb ON d.src = bb.src AND d.block = bb.block)
SELECT doc_id, size, source_size, target, CAST(passes * size + least(size, greatest(0, lft - own)) AS BIGINT) AS taken FROM c
"""
