"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Keys and virtual nodes are hashed to ``POINTS`` points of a ring. A key belongs to the next virtual node clockwise; each
virtual node takes its part of its shard's bound, and what it cannot take goes on clockwise, first come first served in
ring order. That is a queue along the ring, so where the overflow goes follows from running sums of arrivals less bounds
per virtual node: with the ring cut where the running sum is least, nothing flows over the cut, the overflow behind a node
is the running sum less its minimum so far, and every node serves one interval of the keys in ring order.

Only tables of fixed size (cells, virtual nodes) are brought into one order; a row's place
is its cell's offset plus its number within the cell. Rows that are alike are counted before they are shuffled, and written out again
``COPIES`` at a time. A point's rows are dealt over slices by all their values, as many slices as the point has shares of
1 / ``POINTS`` of all rows, so a key that holds a third of all rows is a third of all cells. There are at most 2 x ``POINTS`` cells; the tables
of points and cells are broadcast, as their size is fixed by the parameters.

``slack`` 0 fills all shards exactly: row counts differ by one at most. With more slack a shard holds at most
(1 + slack) times its share and a change of the number of shards moves fewer rows.

Defined cases: a null key has a point like any other; ties are ordered by all given columns, and rows that agree in
all of them are interchangeable; an empty table gives an empty result. Extra columns are passed over.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifeframe.session import materialize

POINTS = 1 << 12
COPIES = 10_000  # equal rows that are written out together
NODES = 32  # virtual nodes of a shard


def _before(*order: str | Column) -> Window:
    return Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def nodes(spark, shards: int, total: int, slack: float) -> DataFrame:
    """(shard, node, pos, cap): the virtual nodes; the caps of a shard's nodes add up to the shard's bound."""
    share = F.expr(f"{total} div {shards}") + (F.col("shard") < total % shards).cast("long")
    bound = share if not slack else F.ceil(F.lit(math.ceil(total / shards)) * (1 + slack)).cast("long")
    part = lambda v: F.floor(F.col("bound") * v / NODES).cast("long")
    return (
        spark.range(shards * NODES)
        .selectExpr(f"cast(id % {shards} as int) as shard", f"cast(id div {shards} as int) as node")
        .withColumn("pos", F.pmod(F.xxhash64(F.lit("node"), "shard", "node"), F.lit(POINTS)))
        .withColumn("bound", bound)
        .withColumn("cap", part(F.col("node") + 1) - part(F.col("node")))
        .drop("bound")
    )


def pieces(cells: DataFrame, shards: int, slack: float) -> DataFrame:
    """(point, slice, first, low, high, shard, base): which part of a cell's rows goes where.

    A row numbered ``i`` in its cell stands at ``q = first + i`` in ring order; for low <= q < high it goes to ``shard``, at slot
    q + base.
    """
    spark = cells.sparkSession
    total = cells.agg(F.sum("n")).first()[0] or 0
    ring = materialize(nodes(spark, shards, total, slack), "ring-nodes")
    rank = F.row_number().over(Window.orderBy("pos", "shard", "node"))
    ranked = ring.withColumn("rank", rank)
    # Each point's rows arrive at the next node clockwise; behind the last node that is the first one.
    arriving = cells.groupBy("point").agg(F.sum("n").alias("n")).selectExpr("point as pos", "n", "cast(null as int) as rank", "0 as kind")
    both = arriving.unionByName(ranked.selectExpr("pos", "0L as n", "rank", "1 as kind"))
    ahead = Window.orderBy("pos", "kind", "rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    arrivals = both.select("n", F.coalesce(F.first("rank", ignorenulls=True).over(ahead), F.lit(1)).alias("rank")).groupBy("rank").agg(F.sum("n").alias("came"))
    loaded = ranked.join(arrivals, "rank").withColumn("sum", F.sum(F.col("came") - F.col("cap")).over(Window.orderBy("rank")))
    # The cut: behind the node where the running sum is least.
    cut = loaded.select(F.min_by(F.struct("rank", "pos"), F.struct("sum", "rank")).alias("c")).select("c.*").first()
    start, edge = (cut["rank"], cut["pos"]) if cut and cut["rank"] is not None else (0, 0)
    turned = loaded.withColumn("turn", F.pmod(F.col("rank") - start - 1, F.lit(shards * NODES)))
    in_turn = Window.orderBy("turn")
    level = F.sum(F.col("came") - F.col("cap")).over(in_turn)
    over = turned.withColumn("level", level).withColumn("over", F.col("level") - F.least(F.lit(0), F.min("level").over(in_turn)))
    served = over.withColumn("served", F.coalesce(F.lag("over").over(in_turn), F.lit(0)) + F.col("came") - F.col("over"))
    placed = (
        served.filter("served > 0")
        .withColumn("low", F.coalesce(F.sum("served").over(_before("turn")), F.lit(0)))
        .withColumn("slot", F.coalesce(F.sum("served").over(Window.partitionBy("shard").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("low", "shard", (F.col("slot") - F.col("low")).alias("base"))
    )
    along = F.pmod(F.col("point") - edge - 1, F.lit(POINTS))
    ordered = cells.withColumn("first", F.coalesce(F.sum("n").over(_before(along, "slice")), F.lit(0)))
    none = {"point": "bigint", "slice": "int", "first": "bigint"}
    marks = ordered.selectExpr("first as low", "point", "slice", "first", "cast(null as int) as shard", "cast(null as bigint) as base").unionByName(
        placed.select("low", *(F.lit(None).cast(t).alias(c) for c, t in none.items()), "shard", "base")
    )
    # Between two neighbouring marks lies one cell and one node.
    here = Window.orderBy("low").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = {c: F.last(c, ignorenulls=True).over(here) for c in ("point", "slice", "first", "shard", "base")}
    known = marks.select("low", *(c.alias(n) for n, c in last.items())).distinct()
    return known.withColumn("high", F.lead("low", 1, total).over(Window.orderBy("low")))


def assign(df: DataFrame, key: str, ties: list[str], shards: int, slack: float = 0.0) -> DataFrame:
    """``key`` and ``ties`` of every row with its ``shard`` and its ``slot``, gapless from 0 within the shard."""
    columns = [key, *ties]
    point = F.pmod(F.xxhash64(key), F.lit(POINTS))
    alike = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_m"))
    held = materialize(alike.withColumn("_point", point), "ring-rows")
    # As many slices as the point has shares of the rows: cells of about one size.
    points = materialize(held.groupBy("_point").agg(F.sum("_m").alias("_n")), "ring-points")
    total = points.agg(F.sum("_n")).first()[0] or 1
    shares = points.select(F.col("_point").alias("_of"), F.ceil(F.col("_n") * POINTS / total).cast("long").alias("_slices"))
    dealt = held.join(F.broadcast(shares), F.col("_point") == F.col("_of")).withColumn("_slice", F.pmod(F.xxhash64(*columns), F.col("_slices")).cast("int"))
    dealt = dealt.drop("_of", "_slices")
    cells = materialize(dealt.groupBy(F.col("_point").alias("point"), F.col("_slice").alias("slice")).agg(F.sum("_m").alias("n")), "ring-cells")
    placed = materialize(pieces(cells, shards, slack), "ring-pieces")
    within = Window.partitionBy("_point", "_slice").orderBy(F.xxhash64(key), *columns).rowsBetween(Window.unboundedPreceding, -1)
    numbered = dealt.withColumn("_i", F.coalesce(F.sum("_m").over(within), F.lit(0)))
    each = F.explode(F.sequence(F.col("_i"), F.col("_i") + F.col("_m") - 1)).alias("_i")
    kept = [*columns, "_point", "_slice"]
    few = numbered.filter(f"_m <= {COPIES}").select(*kept, each)
    chunks = numbered.filter(f"_m > {COPIES}").withColumn("_chunk", F.explode(F.expr(f"sequence(0L, (_m - 1) div {COPIES})"))).repartition("_point", "_slice", "_i", "_chunk")
    many = chunks.withColumns({"_i": F.expr(f"_i + _chunk * {COPIES}"), "_m": F.expr(f"least({COPIES}, _m - _chunk * {COPIES})")}).select(*kept, each)
    rows = few.unionByName(many)
    q = F.col("first") + F.col("_i")
    joined = rows.join(F.broadcast(placed), (F.col("_point") == F.col("point")) & (F.col("_slice") == F.col("slice")) & (q >= F.col("low")) & (q < F.col("high")))
    return joined.select(*columns, "shard", (q + F.col("base")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text: str = "text", slack: float = 0.0) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): ``size`` is the text's UTF-8 bytes (null: none) and 16 for the row."""
    string = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(string) + F.lit(16)).cast("long").alias("size"), F.crc32(string).alias("text_crc32"))
    return assign(rows, "doc_id", ["size", "text_crc32"], shards, slack)
