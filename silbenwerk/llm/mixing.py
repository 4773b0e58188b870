"""Mixing sources to target weights by capped water-filling.

A source's share of all words follows its weight; no source may exceed `epochs` times its own
words. Sources are taken in the order of words per weight: as long as the next one's cap lies
below its share of what is left, it is clamped and the rest is shared anew, until the shares are
feasible. Prefix sums over the sorted sources give all those rounds at once.

A source's target then means whole repetitions of each document and one fractional repetition:
the documents that come first in a seeded order, up to the words that are still missing. The
order is that of md5(seed, doc_id); 4,096 hash slots per source are summed first, so that only
the slot in which the target falls is ordered row by row. A source may hold any share of the rows.

Defined results: a null or empty text has size 0 and is taken 0 times its size; a null source is
a source of its own, ordered last; rows that repeat a doc_id are decided alike; an empty table
gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

SLOT = 3  # hex digits of the hash: 4,096 slots


def source_targets(sized: DataFrame, epochs: int = 3) -> DataFrame:
    """sized(source, size) -> source, source_size, weight, target."""
    every = Window.partitionBy(F.lit(0))  # one row for each source
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = src.withColumn("weight", ((F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("long"))
    src = src.withColumn("cap", epochs * F.col("source_size"))
    by_level = every.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    src = src.withColumn("left_words", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    src = src.withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    src = src.withColumn("turn", F.row_number().over(by_level)).withColumn("level", F.col("left_words") / F.col("left_weight"))
    # the first source that is not clamped sets the level for all that follow
    first_open = F.min(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.struct("turn", "level"))).over(every)
    src = src.withColumn("level", F.coalesce(first_open["level"], F.lit(0.0)))
    return src.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def drawn(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))))


def source_plan(sized: DataFrame, epochs: int = 3) -> DataFrame:
    """sized(source, size, draw) -> source, source_size, target, whole, limit.

    A document of the source is taken `whole` times, and once more if its draw is at most `limit`.
    """
    sized = sized.withColumn("slot", F.substring("draw", 1, SLOT))
    slots = sized.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"), F.max("draw").alias("last"))
    goal = source_targets(sized, epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = cut(goal.withColumn("whole", F.floor(rate)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    in_source = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("before", F.coalesce(F.sum("slot_size").over(in_source), F.lit(0)))
    state = F.when(F.col("before") >= F.col("rest"), 0).when(F.col("before") + F.col("slot_size") <= F.col("rest"), 1).otherwise(2)
    slots = cut(slots.alias("s").join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.*", "g.rest").withColumn("state", state))
    # at most one slot of a source is open: its rows alone are ordered
    open_slots = slots.where("state = 2").select("source", "slot", "before", "rest")
    rows = sized.alias("d").join(open_slots.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.slot") == F.col("p.slot"))).select("d.source", "d.size", "d.draw", "p.before", "p.rest")
    inner = Window.partitionBy("source").orderBy("draw").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.col("before") + F.sum("size").over(inner)).where(F.col("upto") - F.col("size") / 2 <= F.col("rest"))
    limit = rows.select("source", "draw").union(slots.where("state = 1").select("source", "last")).groupBy("source").agg(F.max("draw").alias("limit"))
    return cut(goal.alias("g").join(limit.alias("l"), F.col("g.source").eqNullSafe(F.col("l.source")), "left").select("g.source", "g.source_size", "g.target", "g.whole", F.coalesce("l.limit", F.lit("")).alias("limit")))


def with_plan(rows: DataFrame, plan: DataFrame, most_broadcast: int = 20_000) -> DataFrame:
    """rows(source, draw, ...) with the plan of their source, and repeats."""
    p = plan.withColumnRenamed("source", "plan_source")
    if plan.count() <= most_broadcast:  # one row for each source; beyond that a shuffle, where AQE splits hot sources
        p = F.broadcast(p)
    out = rows.join(p, rows.source.eqNullSafe(p.plan_source)).drop("plan_source")
    return out.withColumn("repeats", F.col("whole") + (F.col("draw") <= F.col("limit")).cast("long"))


def sizes_of(docs: DataFrame, seed: str) -> DataFrame:
    return cut(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), drawn(F.col("doc_id"), seed).alias("draw")))


def mix(docs: DataFrame, epochs: int = 3, seed: str = "mix-1") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, repeats, taken."""
    sized = sizes_of(docs, seed)
    out = with_plan(sized, source_plan(sized, epochs))
    return out.select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, epochs: int = 3, seed: str = "mix-1") -> DataFrame:
    """The documents themselves, each as often as the mix takes it; texts are not shuffled.

    The caller's columns travel as one struct, so their names clash with nothing. Sizes, nulls, ties,
    repeated rows and empty tables are as for `mix`; documents without words are not taken.
    """
    plan = source_plan(sizes_of(docs, seed), epochs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = with_plan(docs.select(drawn(F.col("doc_id"), seed).alias("draw"), "source", row), plan).where("repeats > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("copy")).select("row.*")
