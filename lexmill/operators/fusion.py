"""Fusing ranked lists: reciprocal ranks, best rank, best score, weighted queries; boosts and floors.

A ranked list is rows (qid, list_no, chunk_no, rank from 1, score).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("qid", "chunk_no")


def ranked(df: DataFrame, *order: Column, qid: str = "qid") -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(qid).orderBy(*order)))


def rrf(lists: DataFrame, k: int = 60, weight: Column | None = None) -> DataFrame:
    """(qid, chunk_no, score, rank): sum of weight / (k + rank); lists of no weight are left out."""
    w = F.lit(1.0) if weight is None else weight
    rows = lists.withColumn("w", w).where("w > 0")
    out = rows.groupBy(*KEYS).agg(F.round(F.sum(F.col("w") / (k + F.col("rank"))), 9).alias("score"), F.min_by("list_no", "list_no").alias("first_list"))
    return ranked(out, F.desc("score"), F.col("chunk_no")).drop("first_list")


def by_best_rank(lists: DataFrame) -> DataFrame:
    best = Window.partitionBy(*KEYS).orderBy("rank", "list_no")
    rows = lists.withColumn("n", F.row_number().over(best)).where("n = 1").withColumnRenamed("rank", "best_rank")
    return ranked(rows.select(*KEYS, "score", "best_rank"), F.col("best_rank"), F.desc("score"), F.col("chunk_no"))


def by_best_score(lists: DataFrame) -> DataFrame:
    return ranked(lists.groupBy(*KEYS).agg(F.max("score").alias("score")), F.desc("score"), F.col("chunk_no"))


def by_weighted_queries(lists: DataFrame, decay: float, k: int = 60) -> DataFrame:
    return rrf(lists, k, F.pow(F.lit(decay), F.col("list_no")))


def collapse(lists: DataFrame, strategy: str, decay: float = 1.0, k: int = 60) -> DataFrame:
    """One list of the query lists; 'rrf' keeps them all, as each then has the channel's whole weight."""
    if strategy == "rrf":
        return lists
    one = {"best": by_best_rank, "best-score": by_best_score}.get(strategy)
    out = one(lists) if one else by_weighted_queries(lists, decay, k)
    return out.select(*KEYS, "rank", "score").withColumn("list_no", F.lit(0))


def channels(lexical: DataFrame, dense: DataFrame | None, lexical_weight: float, k: int = 60) -> DataFrame:
    """Both channels fused; a channel without weight isn't planned."""
    if dense is None or lexical_weight >= 1:
        return rrf(lexical, k)
    if lexical_weight <= 0:
        return rrf(dense, k)
    cols = ("qid", "list_no", "chunk_no", "rank", "score")
    both = lexical.select(*cols).withColumn("cw", F.lit(lexical_weight)).unionByName(dense.select(*cols).withColumn("cw", F.lit(1 - lexical_weight)))
    return rrf(both, k, F.col("cw"))


def source_boost(fused: DataFrame, sources: DataFrame, boost: float, source: str = "user") -> DataFrame:
    rows = fused.join(sources, "chunk_no").withColumn("score", F.round(F.when(F.col("source") == source, F.col("score") * boost).otherwise(F.col("score")), 9))
    return ranked(rows.drop("rank"), F.desc("score"), F.col("chunk_no"))


def score_floor(fused: DataFrame, ratio: float) -> DataFrame:
    if ratio <= 0:
        return fused
    best = F.max("score").over(Window.partitionBy("qid"))
    return fused.withColumn("best", best).where(F.col("score") >= F.col("best") * ratio).drop("best")


def apply_order(hits: DataFrame, order: DataFrame) -> DataFrame:
    """Hits in a given order of 1-based places (qid, place, pos); invalid and repeated places are ignored, the rest follow."""
    said = order.where("place >= 1").groupBy("qid", F.col("place").alias("rank")).agg(F.min("pos").alias("said"))
    rows = hits.join(said, ["qid", "rank"], "left").withColumn("old", F.col("rank"))
    return ranked(rows.drop("rank"), F.coalesce("said", F.lit(1_000_000) + F.col("old")), F.col("old")).drop("said", "old")


def on_topic(rewrites: DataFrame, topic: DataFrame) -> DataFrame:
    """Rewrites (qid, list_no, term array 'terms') that share a term with the topic (qid, 'terms'); an empty topic keeps all."""
    t = topic.select("qid", F.col("terms").alias("topic"))
    return rewrites.join(t, "qid", "left").where((F.coalesce(F.size("topic"), F.lit(0)) == 0) | F.arrays_overlap("terms", "topic")).drop("topic")


def query_list(queries: Column, n: int) -> Column:
    """Distinct queries of over two characters, the first n + 1."""
    return F.slice(F.array_distinct(F.filter(queries, lambda q: F.length(F.trim(q)) > 2)), 1, n + 1)
