"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adloom.llm.common import bound, shared_table, text_of

#: Positions on the ring; virtual nodes and keys both fall on one of them. A constant, so tables keyed by it are bounded.
CELLS = 1 << 16


def ring(spark, shards: int, vnodes: int, seed: int) -> DataFrame:
    """One row per occupied cell: cell, shard. If two virtual nodes meet in a cell, the lower number has it.

    Nodes are numbered shard by shard, so those of the first shards lie where they lie whatever the number of shards.
    """
    return (
        spark.range(shards * vnodes, numPartitions=1)
        .select(F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(CELLS)).alias("cell"), F.col("id"))
        .groupBy("cell")
        .agg(F.min("id").alias("id"))
        .select("cell", F.floor(F.col("id") / vnodes).cast("int").alias("shard"))
    )


def fill(arcs: Column, shards: int, load: float) -> Column:
    """Segments (arc, lo, hi, shard, slot0) of the arcs' keys, keys taken in ring order.

    arcs: array<struct<arc, shard, n>> in clockwise order. Each arc's keys go to its shard up to the shard's capacity;
    what overflows continues clockwise to the next shard that has room. Only a shard that becomes full cuts an arc, so
    there are at most arcs + shards segments. The shards that follow an arc are only looked up where its own is full.
    """

    def capacities(total: Column) -> Column:
        each = F.floor(total * F.lit(load) / shards).cast("long") if load > 1 else (total - total % shards) / shards
        return F.transform(
            F.sequence(F.lit(0), F.lit(shards - 1)),
            lambda s: (each.cast("long") + F.when(s < total % shards, 1).otherwise(0 if load == 1 else 1)).cast("long"),
        )

    total = F.aggregate(arcs, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return bound(bound(total, capacities), lambda caps: _filled(arcs, caps))


def _filled(arcs: Column, caps: Column) -> Column:
    n_arcs = F.size(arcs)
    segment = "array<struct<arc:int,lo:bigint,hi:bigint,shard:int,slot0:bigint>>"

    def piece(state: Column, arc: Column, lo: Column, take: Column, shard: Column) -> list[Column]:
        """free and segs after `take` keys of an arc, from `lo` on, went to a shard."""
        used = F.get(caps, shard) - F.get(state["free"], shard)
        one = F.struct(arc.alias("arc"), lo.alias("lo"), (lo + take).alias("hi"), shard.alias("shard"), used.alias("slot0"))
        free = F.transform(state["free"], lambda c, i: F.when(i == shard, c - take).otherwise(c))
        return [free.alias("free"), F.concat(state["segs"], F.array(one)).cast(segment).alias("segs")]

    def overflow(state: Column, x: Column) -> Column:
        """An arc whose shard lacks room: shards take its keys in the order in which they come up clockwise."""
        names = F.transform(arcs, lambda y: y["shard"])
        clockwise = F.array_distinct(F.concat(F.slice(names, x["arc"] + 1, n_arcs), F.slice(names, F.lit(1), x["arc"])))

        def shard_step(s: Column, shard: Column) -> Column:
            take = F.least(s["left"], F.get(s["free"], shard))
            return F.when(take <= 0, s).otherwise(
                F.struct((s["left"] - take).alias("left"), *piece(s, x["arc"], x["n"] - s["left"], take, shard))
            )

        start = F.struct(x["n"].alias("left"), state["free"].alias("free"), state["segs"].alias("segs"))
        return F.aggregate(clockwise, start, shard_step, lambda done: F.struct(done["free"].alias("free"), done["segs"].alias("segs")))

    def arc_step(state: Column, x: Column) -> Column:
        fits = F.struct(*piece(state, x["arc"], F.lit(0).cast("long"), x["n"], x["shard"]))
        return F.when(x["n"] == 0, state).when(x["n"] <= F.get(state["free"], x["shard"]), fits).otherwise(overflow(state, x))

    return F.aggregate(
        arcs,
        F.struct(caps.alias("free"), F.array().cast(segment).alias("segs")),
        arc_step,
        lambda s: s["segs"],
    )


def bounded_ring(docs: DataFrame, shards: int = 16, vnodes: int = 64, load: float = 1.0, seed: int = 17) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A row's place on the ring is a hash of its doc_id. Shards take keys in ring order up to their capacity, `load`
    times the mean number of rows; keys that overflow a full shard continue clockwise. At load 1 the capacities are
    the mean rounded so that they add up to the table, and counts differ by one at most (law `rows`). One more shard
    takes arcs over from all others; beyond those, only keys that overflow, or no longer do, move.
    slot numbers a shard's rows from 0 without gaps. grown_shard is null under this law.

    Only counts by cell, a table of CELLS rows at most, are brought together; a row finds its arc, rank and segment by
    two broadcasts whose sizes are fixed by CELLS and shards * vnodes.

    Null text has no bytes. A null doc_id is placed by its text's checksum. Equal ids share a cell; repeated rows are
    ranked by size and checksum, and wholly equal rows are interchangeable. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = text_of()
    keyed = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    ).withColumn("h", F.xxhash64(F.lit(seed), F.coalesce("doc_id", "text_crc32")))
    rows = shared_table(keyed.withColumn("cell", F.pmod(F.shiftrightunsigned("h", 24), F.lit(CELLS))), "ring-rows")

    nodes = ring(spark, shards, vnodes, seed)
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        spark.range(CELLS, numPartitions=1).withColumnRenamed("id", "cell")
        .join(nodes, "cell", "left")
        .select("cell", "shard", F.count("shard").over(before).cast("int").alias("arc"))
    )
    n_arcs = nodes.count()  # fixed by the parameters
    counts = rows.groupBy("cell").agg(F.count("*").alias("n"))
    cells = (
        cells.join(counts, "cell", "left")
        .select(F.col("cell"), (F.col("arc") % n_arcs).alias("arc"), "shard", F.coalesce("n", F.lit(0)).alias("n"), (F.col("arc") == n_arcs).alias("wrapped"))
    )
    # cells past the last node wrap to the first arc and come first on it
    in_arc = Window.partitionBy("arc").orderBy(F.desc("wrapped"), "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = shared_table(cells.withColumn("offset", F.coalesce(F.sum("n").over(in_arc), F.lit(0))), "ring-cells")
    arcs = cells.groupBy("arc").agg(F.max("shard").alias("shard"), F.sum("n").alias("n"))
    segments = (
        arcs.agg(F.sort_array(F.collect_list(F.struct("arc", "shard", "n"))).alias("arcs"))
        .select(F.inline(fill(F.col("arcs"), shards, load)))
    )
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("h", "doc_id", "size", "text_crc32")).cast("long") - 1
    placed = (
        rows.withColumn("rank", rank)
        .join(F.broadcast(cells.select("cell", "arc", "offset")), "cell")
        .withColumn("at", F.col("offset") + F.col("rank"))
        .join(F.broadcast(segments), "arc")
        .where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
    )
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("slot0") + F.col("at") - F.col("lo")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
