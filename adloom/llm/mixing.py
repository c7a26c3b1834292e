"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adloom.llm.common import SPACE_CLASS, shared_table, text_of

WEIGHTS = (5.0, 2.0, 1.0)
#: Multipliers of the block permutation: primes, so that one of them is coprime to any number of blocks.
PRIMES = (1_000_003, 1_299_709, 1_500_007, 1_618_033, 2_000_003, 15_485_863)


def sainte_lague(parties: DataFrame, group: str, party: str) -> DataFrame:
    """Adds `won`: the seats of each party by highest quotients weight / (2k + 1) within its group.

    parties: group, party, weight double, seats long (of the group). Equal quotients go to the lower party. The
    starting point floor(weight * seats / total + 1/2) is off by less than the number of parties, so only quotients near
    it are ranked: a few rows per party, whatever the number of seats.
    """
    whole = Window.partitionBy(group)
    fair = F.when(F.col("total") > 0, F.col("weight") * F.col("seats") / F.col("total")).otherwise(0.0)
    start = (
        parties.withColumn("total", F.sum("weight").over(whole))
        .withColumn("members", F.count("*").over(whole))
        .withColumn("base", F.floor(fair + 0.5).cast("long"))
        .withColumn("missing", F.when(F.col("total") > 0, F.col("seats") - F.sum("base").over(whole)).otherwise(0).cast("long"))
        .withColumn(
            "reach",
            F.when(
                F.col("missing") != 0,
                F.ceil(F.col("weight") / F.col("total") * (F.abs("missing") + F.col("members"))) + 1,
            ).otherwise(0).cast("long"),
        )
    )
    k = F.when(
        F.col("missing") > 0, F.sequence(F.col("base"), F.col("base") + F.col("reach"))
    ).when(
        (F.col("missing") < 0) & (F.col("base") > 0),
        F.sequence(F.greatest(F.col("base") - F.col("reach"), F.lit(0)), F.col("base") - 1),
    )
    quotient = F.col("weight") / (2 * F.col("k") + 1)
    add = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("quotient"), party, "k"))
    drop = F.row_number().over(Window.partitionBy(group).orderBy("quotient", F.desc(party), F.desc("k")))
    change = (
        start.select(group, party, "weight", "missing", F.explode(k).alias("k"))
        .withColumn("quotient", quotient)
        .withColumn("step", F.when(F.col("missing") > 0, F.when(add <= F.col("missing"), 1)).otherwise(F.when(drop <= -F.col("missing"), -1)))
        .where("step is not null")
        .groupBy(group, party)
        .agg(F.sum("step").alias("step"))
    )
    return start.join(change, [group, party], "left").withColumn(
        "won", F.col("base") + F.coalesce(F.col("step"), F.lit(0))
    ).drop("total", "members", "base", "missing", "reach", "step")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: float = 3.0) -> DataFrame:
    """Adds `weight` and `target` to one row per source (skey, source, source_size).

    Weights repeat over the sources in code-point order, null last, and share out all words; a target stops at `limit`
    times its source's size and the rest is shared again by weight until none is above. Sorted by size to weight, the
    sources that stop are a prefix, so one running sum finds the level. The table has one row per source.
    """
    every = Window.partitionBy(F.lit(0))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy("ratio", F.asc_nulls_last("source"))
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    return (
        sources.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", limit * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("whole", F.sum("source_size").over(every).cast("double"))
        .withColumn(
            "level",
            (F.col("whole") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after),
        )
        .withColumn("at", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(every)["level"])
        .withColumn("target", F.least(F.col("cap"), F.col("weight") * F.col("at")))
        .drop("place", "cap", "ratio", "whole", "level", "at")
    )


def _chosen(j: Column, blocks: Column, quota: Column, shard: Column, seed: int) -> Column:
    """Whether block j of a shard is among the quota blocks that a seeded permutation puts first."""
    multiplier = F.element_at(F.filter(F.array(*map(F.lit, PRIMES)), lambda p: blocks % p.cast("long") != 0), 1)
    multiplier = F.when(blocks > 1, F.element_at(F.filter(F.array(*map(F.lit, PRIMES)), lambda p: p.cast("long") % blocks != 0), 1)).otherwise(multiplier)
    return (multiplier.cast("long") * j + F.lit(seed) * 7919 + shard * 104729) % blocks < quota


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    limit: int = 3,
    block: int = 16,
    shard_blocks: int = 16384,
    lane_digits: int = 3,
    seed: int = 42,
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words, repeats counted).

    A source's documents, in a seeded order, are one stream of words cut into blocks of `block` words; `shard_blocks`
    blocks are a shard. Sources win blocks by highest quotients over their targets; a source's blocks are whole
    passes (at most `limit`) plus a rest, which its shards share by highest quotients over their blocks. Within a shard
    a seeded permutation of block numbers picks the quota, so no list of blocks is ever sorted or gathered. A document
    is taken as often as its words lie in chosen blocks, never over `limit` times its size.

    Positions come from two levels of running sums (lanes of the seeded order, then rows in a lane), so a source that
    holds a third of all rows is spread over 16 ** lane_digits lanes. Only rows of (id, source, size) are shuffled.

    Null text has size 0 and is never taken; a null source is the last source. A null doc_id and repeated rows are
    ordinary rows; rows equal in id, source and size are interchangeable. A source without words has target 0. An empty
    table gives an empty result.
    """
    sized = shared_table(
        docs.select(
            "doc_id",
            "source",
            F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source"))).alias("skey"),
            F.regexp_count(text_of(), F.lit(f"[^{SPACE_CLASS}]+")).cast("long").alias("size"),
            F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"))).alias("place"),
        ).withColumn("lane", F.substring("place", 1, lane_digits)),
        "sized",
    )
    lanes = sized.groupBy("skey", "source", "lane").agg(F.sum("size").alias("words"))
    lanes = shared_table(lanes, "lanes")
    sources = lanes.groupBy("skey", "source").agg(F.sum("words").alias("source_size"))
    blocks_of = F.ceil(F.col("source_size") / block).cast("long")
    goal = targets(sources, weights, float(limit)).withColumn("g", F.lit(0)).withColumn("blocks", blocks_of)
    seats = F.round(F.sum("source_size").over(Window.partitionBy("g")) / block).cast("long")
    goal = sainte_lague(
        goal.withColumnRenamed("weight", "w").withColumn("weight", F.col("target")).withColumn("seats", seats), "g", "skey"
    )
    won_words = F.col("won") * block
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(limit), F.floor(won_words / F.col("source_size")))).otherwise(0).cast("long")
    rest = F.round((won_words - F.col("passes") * F.col("source_size")) * F.col("blocks") / F.col("source_size"))
    goal = shared_table(
        goal.withColumn("passes", passes)
        .withColumn(
            "rest",
            F.when((F.col("passes") < limit) & (F.col("source_size") > 0), F.least(F.col("blocks"), rest.cast("long"))).otherwise(0).cast("long"),
        )
        .select("skey", "source_size", "target", "blocks", "passes", "rest"),
        "goal",
    )
    shards = goal.where("blocks > 0").select(
        "skey",
        F.col("rest").alias("seats"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / shard_blocks).cast("long"))).alias("shard"),
        F.col("blocks").alias("all_blocks"),
    ).withColumn("in_shard", F.least(F.lit(shard_blocks).cast("long"), F.col("all_blocks") - F.col("shard") * shard_blocks))
    quotas = sainte_lague(shards.withColumn("weight", F.col("in_shard").cast("double")), "skey", "shard").select(
        "skey", "shard", "in_shard", F.col("won").alias("quota")
    )

    below = Window.partitionBy("skey").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    in_lane = Window.partitionBy("skey", "lane").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lanes.select("skey", "lane", F.coalesce(F.sum("words").over(below), F.lit(0)).alias("offset"))
    placed = (
        sized.withColumn("start", F.coalesce(F.sum("size").over(in_lane), F.lit(0)))
        .join(offsets, ["skey", "lane"])
        .join(goal, "skey")
        .select("doc_id", "size", "source_size", "target", "skey", "passes", (F.col("start") + F.col("offset")).alias("start"))
    )
    last = F.greatest(F.col("start") + F.col("size") - 1, F.col("start"))
    first_block, last_block = F.floor(F.col("start") / block).cast("long"), F.floor(last / block).cast("long")
    parts = placed.withColumns({"b0": first_block, "b1": last_block}).withColumn(
        "shard",
        F.explode(F.sequence(F.floor(F.col("b0") / shard_blocks).cast("long"), F.floor(F.col("b1") / shard_blocks).cast("long"))),
    )
    lo = F.greatest(F.col("b0"), F.col("shard") * shard_blocks)
    hi = F.least(F.col("b1"), (F.col("shard") + 1) * shard_blocks - 1)
    end = F.col("start") + F.col("size")

    def add(total: Column, j: Column) -> Column:
        inside = F.least((j + 1) * block, end) - F.greatest(j * block, F.col("start"))
        hit = _chosen(j - F.col("shard") * shard_blocks, F.col("in_shard"), F.col("quota"), F.col("shard"), seed)
        return total + F.when(hit, inside).otherwise(0)

    part = F.when(F.col("quota") >= F.col("in_shard"), F.least((hi + 1) * block, end) - F.greatest(lo * block, F.col("start"))).when(
        F.col("quota") > 0, F.aggregate(F.sequence(lo, hi), F.lit(0).cast("long"), add)
    ).otherwise(0)
    part = F.when((F.col("size") > 0) & F.col("quota").isNotNull(), part).otherwise(0).cast("long")
    # start is the row's identity within its source; rows of size 0 share it, so they are told apart by nothing else
    # and keep a row each through their own branch
    words = (
        parts.where("size > 0")
        .join(quotas, ["skey", "shard"], "left")
        .withColumn("part", part)
        .groupBy("doc_id", "size", "source_size", "target", "skey", "start", "passes")
        .agg(F.sum("part").alias("part"))
        .select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("part")).alias("taken"))
    )
    empty = sized.where("size = 0").join(goal, "skey").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return words.unionByName(empty)
