"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

Law ``rows``: with n rows and s shards, shard i may hold n // s rows, one more where i < n % s. Capacities
sum to n, so every shard is exactly full and counts differ by one at most.

The ring has ``CELLS`` cells. A virtual node owns the cells before it (an arc); a row lies in the cell of its
hash. Rows of an arc go to the arc's shard while it has room, arcs clockwise; what overflows continues
clockwise to the next shards with room. Both steps need only how many rows an arc has, so the plan is
made from one row for each arc, and rows find their place by their rank within the arc.

A cell that holds far more than its share (a row repeated very often) is cut into parts by a number each row
drew when it was written, so ranks are taken within parts of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwright.llm.common import saved

#: Cells of the ring and virtual nodes of a shard. Fixed: tables of cells and arcs don't grow with the data.
CELLS, NODES = 16_384, 64
#: A cell is cut into parts where it holds more than so many times a cell's share of the rows.
CROWDED = 8


def _ring(spark, shards: int) -> DataFrame:
    """(cell, arc, own, order): the arc of each cell, the arc's shard, and all shards clockwise from it."""
    node = spark.range(shards * NODES).select(F.expr(f"id div {NODES}").cast("int").alias("shard"), F.pmod(F.xxhash64(F.lit("node"), "id"), F.lit(CELLS)).alias("cell"))
    node = node.groupBy("cell").agg(F.min("shard").alias("shard"))  # where two meet, the smaller shard stays
    arcs = node.agg(F.array_sort(F.collect_list(F.struct("cell", "shard"))).alias("ring")).select(F.posexplode("ring").alias("arc", "node"), "ring")
    turned = F.concat(F.slice("ring", F.col("arc") + 1, F.size("ring")), F.slice("ring", F.lit(1), F.col("arc")))
    # A shard that lost all its nodes to others comes last, so that every shard can be reached.
    order = F.array_distinct(F.concat(F.transform(turned, lambda x: x["shard"]), F.sequence(F.lit(0), F.lit(shards - 1))))
    before = F.when(F.col("arc") == 0, -1).otherwise(F.expr("ring[arc - 1].cell"))
    arcs = arcs.select("arc", F.col("node.shard").alias("own"), order.alias("order"), F.sequence(before + 1, F.col("node.cell")).alias("cells"), (F.col("arc") == 0).alias("first"), F.expr("ring[size(ring) - 1].cell").alias("last"))
    rest = F.when(F.col("first") & (F.col("last") < CELLS - 1), F.sequence(F.col("last") + 1, F.lit(CELLS - 1))).otherwise(F.array().cast("array<bigint>"))
    return arcs.select(F.explode(F.concat(rest, "cells")).alias("cell"), "arc", "own", "order")


def _plan(arcs: DataFrame, shards: int) -> DataFrame:
    """(arc, cuts): for each arc the runs of its ranks (from, to, shard, slot of the first)."""
    total = F.aggregate("arcs", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    room = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.floor(F.col("total") / shards) + F.when(i < F.col("total") % shards, 1).otherwise(0))
    state = "struct<room:array<bigint>,cuts:array<struct<arc:int,shard:int,n:bigint>>>"

    def put(s: Column, arc: Column, shard: Column, n: Column) -> Column:
        """Give ``n`` rows, or what there is room for, of ``arc`` to ``shard``."""
        got = F.least(n, F.element_at(s["room"], shard + 1))
        room = F.transform(s["room"], lambda r, i: F.when(i == shard, r - got).otherwise(r))
        return F.when(got > 0, F.struct(room.alias("room"), F.concat(s["cuts"], F.array(F.struct(arc.alias("arc"), shard.alias("shard"), got.alias("n")))).alias("cuts"))).otherwise(s)

    start = F.struct(F.col("room"), F.array().cast("array<struct<arc:int,shard:int,n:bigint>>").alias("cuts")).cast(state)
    own = F.aggregate("arcs", start, lambda s, x: put(s, x["arc"], x["own"], x["n"]).cast(state))
    one = arcs.agg(F.array_sort(F.collect_list(F.struct("arc", "own", "n", "order"))).alias("arcs"))
    one = one.withColumn("total", total).withColumn("room", room).withColumn("own", own)
    # What an arc has left after its own shard took its part; arcs come in the same order as their cuts.
    left = F.transform("arcs", lambda x: F.struct(x["arc"].alias("arc"), x["order"].alias("order"), (x["n"] - F.aggregate(F.filter(F.col("own.cuts"), lambda c: c["arc"] == x["arc"]), F.lit(0).cast("long"), lambda a, c: a + c["n"])).alias("n")))
    over = F.filter("left", lambda x: x["n"] > 0)

    def pour(s: Column, x: Column) -> Column:
        """Overflow of one arc to the shards clockwise."""
        begin = F.struct(s.alias("s"), x["n"].alias("n"))
        full = f"struct<s:{state},n:bigint>"

        def step(t: Column, shard: Column) -> Column:
            got = F.least(t["n"], F.element_at(t["s"]["room"], shard + 1))
            return F.struct(put(t["s"], x["arc"], shard, t["n"]).alias("s"), (t["n"] - got).alias("n")).cast(full)

        return F.aggregate(x["order"], begin.cast(full), step, lambda t: t["s"]).cast(state)

    done = one.withColumn("left", left).withColumn("done", F.aggregate(over, F.col("own"), pour))
    cuts = done.select(F.posexplode("done.cuts").alias("at", "cut")).select("at", "cut.*")
    ranks = Window.partitionBy("arc").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    slots = Window.partitionBy("shard").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.withColumn("begin", F.coalesce(F.sum("n").over(ranks), F.lit(0))).withColumn("slot", F.coalesce(F.sum("n").over(slots), F.lit(0)))
    return cuts.groupBy("arc").agg(F.collect_list(F.struct("begin", (F.col("begin") + F.col("n")).alias("end"), "shard", "slot")).alias("cuts"))


def shard(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Deal every row of ``docs`` to a shard from 0 to ``shards - 1``.

    Columns: doc_id, size (UTF-8 bytes of the text, plus 1), text_crc32, law (``rows``), shard, slot (gapless
    from 0 within the shard), grown_shard (null: this law moves few rows when shards are added, but not into
    the new one alone).

    A null text has no bytes and the checksum of no bytes. A null doc_id hashes like a value of its own.
    Repeated rows and ties are ordered by doc_id, checksum and size; which of two equal rows gets which slot
    doesn't matter. Other columns are ignored, whatever their names. An empty table gives an empty result.
    Skew in sources or texts has no effect: the hash takes doc_id and the text's checksum. A row that is repeated
    so often that it crowds its cell is spread over parts; those few cells place rows in the order of writing.
    """
    spark = docs.sparkSession
    blob = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(blob) + 1).cast("long").alias("size"), F.crc32(blob).alias("text_crc32"))
    # Placing must not see a row twice: the narrow rows are written once.
    rows = rows.withColumn("hash", F.xxhash64("doc_id", "text_crc32")).withColumn("cell", F.pmod("hash", F.lit(CELLS)))
    rows = saved(rows.withColumn("drawn", F.xxhash64(F.monotonically_increasing_id())), "rows")
    ring = F.broadcast(_ring(spark, shards))  # CELLS rows
    counts = rows.groupBy("cell").agg(F.count("*").alias("n"))
    share = counts.agg(F.greatest(F.coalesce(F.sum("n"), F.lit(0)) / CELLS, F.lit(1.0)).alias("share"))  # one row
    counts = saved(counts.join(F.broadcast(share)).select("cell", "n", F.ceil(F.col("n") / (F.col("share") * CROWDED)).alias("parts")), "counts")
    cells = counts.select("cell", "n").join(ring, "cell")
    arcs = cells.groupBy("arc", "own").agg(F.sum("n").alias("n"), F.first("order").alias("order"))
    within = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("offset", F.coalesce(F.sum("n").over(within), F.lit(0))).select("cell", "arc", "offset")
    cells = saved(cells.join(F.broadcast(_plan(arcs, shards)), "arc"), "cells")
    # At most CELLS / CROWDED parts beyond one for each cell.
    dealt = rows.join(F.broadcast(counts.select("cell", "parts")), "cell").withColumn("part", F.pmod("drawn", F.col("parts")))
    crowded = dealt.where("parts > 1").groupBy("cell", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = crowded.select("cell", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    rank = F.row_number().over(Window.partitionBy("cell", "part").orderBy("hash", "doc_id", "text_crc32", "size")) - 1
    placed = dealt.withColumn("rank", rank.cast("long")).join(F.broadcast(ahead), ["cell", "part"], "left").join(F.broadcast(cells), "cell")
    placed = placed.withColumn("at", F.col("offset") + F.coalesce("ahead", F.lit(0)) + F.col("rank"))
    cut = F.filter("cuts", lambda c: (c["begin"] <= F.col("at")) & (F.col("at") < c["end"]))[0]
    placed = placed.withColumn("cut", cut)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("cut.shard").cast("int").alias("shard"),
        (F.col("cut.slot") + F.col("at") - F.col("cut.begin")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
