"""Problem 9: draw documents so that every source has its target share of all tokens.

Method: weighted fair queueing. Every (document, repeat) of a source is shuffled by a hash; its
virtual finish time is the source's cumulative tokens up to it divided by the target weight. The copies are
range-sorted by finish time over the whole cluster, every copy gets the tokens queued up to and with it (running sums
inside range partitions, stitched by the partitions' offsets), and the queue is truncated at the total budget. So at every
moment each source has had tokens in proportion to its weight as long as it has documents left; when a source runs out, the queue goes
on with the others, which share out what it leaves. At the end a source is short of its part by less than one document.

The budget is the most that the targets allow: the least over the named sources that have tokens of
tokens x max_repeats / (share of the source among those sources); it may be given instead. Cumulative
sums of a source are made in two steps, hash slices first, as many as its documents need, so a source of any size is spread over tasks.
A repeat comes after all documents of the pass before it. Null or empty texts have no tokens and aren't drawn; sources without documents get nothing and are reported;
documents of sources that aren't named (or null) aren't drawn. Ties of the hash are broken by id. Only the target table and a row a
slice or range partition are broadcast or collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import written
from lexmill.llm.tokenise import DEFAULT_VOCABULARY, count_tokens

#: Documents of a slice, about; copies of a range partition of the queue, about.
SLICE_ROWS, QUEUE_ROWS = 200_000, 500_000


def _targets(targets: DataFrame) -> DataFrame:
    """The target table, one row a source (a repeated source keeps its largest row)."""
    return targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).where("source is not null and target_share > 0 and max_repeats > 0")


def _due(sources: list, budget: float) -> float:
    """A finish time by which the queue of all sources (rows with supply, target_share, max_repeats, longest) is over the budget."""
    slack = sum(r.longest for r in sources)
    low, high = 0.0, max((r.supply * r.max_repeats / r.target_share for r in sources), default=0.0)
    for _ in range(100):
        now = (low + high) / 2
        if sum(min(now * r.target_share, r.supply * r.max_repeats) for r in sources) >= budget + slack:
            high = now
        else:
            low = now
    return high


def draw(documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", budget: int | None = None, vocabulary: str = DEFAULT_VOCABULARY, seed: int = 17) -> DataFrame:
    """(source, id, tokens, repeat, finish, queued): the drawn copies of the documents; queued: tokens of the queue up to the copy and with it."""
    goal = F.broadcast(_targets(targets))  # the target table: a row a source, written by hand
    rows = documents.join(goal.select("source"), "source", "left_semi").where(F.col(id_col).isNotNull())
    counted = count_tokens(rows, ["source", id_col], vocabulary=vocabulary).where("tokens > 0").withColumnRenamed(id_col, "id")
    counted = written(counted.withColumn("slot", F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 32)), "mix-tokens")
    supply = counted.groupBy("source").agg(F.sum("tokens").alias("supply"), F.count("*").alias("documents"), F.max("tokens").alias("longest"))
    sources = supply.join(goal, "source").collect()  # a row a source of the target table
    if not sources:
        return counted.select("source", F.col("id").alias(id_col), "tokens", F.lit(1).alias("repeat"), F.lit(0.0).alias("finish"), F.lit(0).cast("long").alias("queued")).limit(0)
    every = sum(r.target_share for r in sources)
    if budget is None:
        budget = int(every * min(r.supply * r.max_repeats / r.target_share for r in sources) * (1 + 1e-12))
    spark = documents.sparkSession
    known = F.broadcast(spark.createDataFrame([(r.source, r.supply, r.target_share, r.max_repeats, 1 + r.documents // SLICE_ROWS) for r in sources], "source string, supply long, target_share double, max_repeats int, slices long"))
    spread = counted.join(known, "source").withColumn("slice", F.floor(F.col("slot") * F.col("slices") / F.lit(1 << 32)))
    per_slice = spread.groupBy("source", "slice").agg(F.sum("tokens").alias("in_slice"))
    before = F.sum("in_slice").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_slice.select("source", "slice", F.coalesce(before, F.lit(0)).alias("offset"))
    inside = F.sum("tokens").over(Window.partitionBy("source", "slice").orderBy("slot", "id").rowsBetween(Window.unboundedPreceding, 0))
    once = spread.withColumn("inside", inside).join(offsets, ["source", "slice"])
    copies = once.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("max_repeats"))))
    finish = ((F.col("repeat") - 1) * F.col("supply") + F.col("offset") + F.col("inside")) / F.col("target_share")
    # copies far behind the budget's end can't be drawn and needn't be sorted
    copies = copies.withColumn("finish", finish).where(F.col("finish") <= _due(sources, budget)).select("source", "id", "tokens", "repeat", "finish")
    parts = 1 + sum(r.documents * r.max_repeats for r in sources) // QUEUE_ROWS
    order = ["finish", "source", "id", "repeat"]
    ranged = written(copies.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "mix-queue")
    per_part = ranged.groupBy("part").agg(F.sum("tokens").alias("in_part"))
    earlier = F.sum("in_part").over(Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range partition
    ahead = per_part.select("part", F.coalesce(earlier, F.lit(0)).alias("ahead"))
    running = F.sum("tokens").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    queued = ranged.withColumn("queued", running).join(ahead, "part").withColumn("queued", F.col("queued") + F.col("ahead"))
    return queued.where(F.col("queued") <= budget).select("source", F.col("id").alias(id_col), "tokens", "repeat", "finish", "queued")


def queue(drawn: DataFrame) -> DataFrame:
    """The drawn copies in queue order."""
    return drawn.orderBy("queued")


def share_report(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, copies, tokens, actual_share, most_repeats, met of every target row; zeros where a source has no documents.

    met: the actual share is the target (among the sources that have documents) but for one document of the source.
    """
    got = drawn.groupBy("source").agg(F.count("*").alias("copies"), F.sum("tokens").alias("tokens"), F.max("repeat").alias("most_repeats"), F.max("tokens").alias("longest"))
    out = _targets(targets).join(got, "source", "left").na.fill(0, ["copies", "tokens", "most_repeats", "longest"])
    all_rows = Window.partitionBy(F.lit(1))  # a row a target: sums over a hand-written table
    every, named = F.sum("tokens").over(all_rows), F.sum(F.when(F.col("copies") > 0, F.col("target_share"))).over(all_rows)
    share = F.when(every > 0, F.col("tokens") / every).otherwise(0.0)
    met = (F.col("copies") > 0) & (F.abs(share - F.col("target_share") / named) <= F.col("longest") / every)
    return out.select("source", "target_share", "max_repeats", "copies", "tokens", F.round(share, 6).alias("actual_share"), "most_repeats", F.coalesce(met, F.lit(False)).alias("met"))
