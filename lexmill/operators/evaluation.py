"""Retrieval metrics against a gold set, and the sweep of parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.params import GRID, RagParams


def gold_targets(gold: DataFrame) -> DataFrame:
    """(qid, act, ref): one row a wanted act and reference; a null ref wants any section."""
    rows = gold.select(F.col("id").alias("qid"), F.explode("relevant").alias("r"))
    return rows.select("qid", "r.act", F.explode_outer(F.when(F.size("r.refs") > 0, F.col("r.refs"))).alias("ref"))


def judged(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """Hits (qid, rank, title, ref, chars) with the wanted target each meets, if any (the first by act and reference)."""
    t = targets.select("qid", F.col("act").alias("title"), F.col("ref").alias("wanted"))
    rows = hits.join(t, ["qid", "title"], "left").withColumn("rel", F.col("wanted").isNull() | F.col("wanted").eqNullSafe(F.col("ref")))
    known = targets.select("qid", F.col("act").alias("title")).distinct().withColumn("known", F.lit(True))
    rows = rows.join(known, ["qid", "title"], "left").withColumn("rel", F.coalesce("known", F.lit(False)) & F.col("rel"))
    met = F.when(F.col("rel"), F.concat_ws("|", "title", F.coalesce("wanted", F.lit("*"))))
    return rows.groupBy("qid", "rank", "chars").agg(F.bool_or("rel").alias("rel"), F.array_compact(F.collect_set(met)).alias("met"))


def per_question(hits: DataFrame, targets: DataFrame, questions: DataFrame, top_k: int) -> DataFrame:
    """hit, rr, ndcg, precision, coverage, chars and returned of every question."""
    j = judged(hits, targets)
    wanted = targets.groupBy("qid").agg(F.count_distinct(F.concat_ws("|", "act", F.coalesce("ref", F.lit("*")))).alias("wanted"))
    found = j.select("qid", F.explode("met").alias("m")).groupBy("qid").agg(F.count_distinct("m").alias("found"))
    gain = F.sum(F.when(F.col("rel"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    m = j.groupBy("qid").agg(
        F.min(F.when(F.col("rel"), F.col("rank"))).alias("first"), gain.alias("dcg"), F.avg(F.col("rel").cast("int")).alias("precision"), F.sum("chars").alias("chars"), F.count("*").alias("returned")
    )
    rows = questions.select("qid").join(wanted, "qid", "left").join(m, "qid", "left").join(found, "qid", "left").na.fill(0, ["wanted", "found", "returned", "chars"]).na.fill(0.0, ["dcg", "precision"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("wanted").cast("int"), F.lit(top_k)))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return rows.select(
        "qid",
        F.col("first").isNotNull().cast("int").alias("hit"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"),
        F.when(F.col("wanted") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"),
        "precision",
        F.when(F.col("wanted") > 0, F.col("found") / F.col("wanted")).otherwise(0.0).alias("coverage"),
        "chars",
        "returned",
    )


def means(each: DataFrame, *by: str) -> DataFrame:
    """Mean metrics and the objective 0.6 hit + 0.4 rr - 0.08 chars / 24000 - 0.02 seconds a question (where rows have ``ms``; a batch has none)."""
    late = 0.02 * F.avg("ms") / 1000 if "ms" in each.columns else None
    out = each.groupBy(*by).agg(*(F.avg(c).alias(c) for c in ("hit", "rr", "ndcg", "precision", "coverage", "chars", "returned")), (F.lit(0.0) if late is None else late).alias("__late"))
    return out.withColumn("objective", 0.6 * F.col("hit") + 0.4 * F.col("rr") - 0.08 * F.col("chars") / 24000 - F.col("__late")).drop("__late")


def over_samples(each: DataFrame) -> DataFrame:
    """Means over rewrite samples (a column 'sample'), the questions any sample hits, and the spread of the hit rate."""
    m = means(each, "sample")
    any_hit = each.groupBy("qid").agg(F.max("hit").alias("h")).agg(F.avg("h").alias("any_hit"))
    return m.agg(*(F.avg(c).alias(c) for c in ("hit", "rr", "ndcg", "coverage", "objective")), (F.max("hit") - F.min("hit")).alias("hit_spread")).crossJoin(any_hit)


def coordinate_ascent(score: Callable[[RagParams], float], start: RagParams, grid: dict[str, tuple] = GRID, passes: int = 2, gain: float = 0.005) -> tuple[RagParams, list[tuple[str, object, float]]]:
    """The best parameters found by sweeping one at a time; ``score`` runs a Spark job and returns one number."""
    best, value, steps = start, score(start), []
    for _ in range(passes):
        changed = False
        for name, options in grid.items():
            trials = [(score(best.over(**{name: o})), o) for o in options if o != getattr(best, name)]
            top = max(trials, key=lambda t: t[0], default=None)
            if top and top[0] > value + gain:
                best, value, changed = best.over(**{name: top[1]}), top[0], True
                steps.append((name, top[1], top[0]))
        if not changed:
            break
    return best, steps


def worth_reranking(off: float, on: float, gain: float = 0.01) -> bool:
    """Whether a re-ranker's objective is better by more than the gain that its latency must earn."""
    return on > off + gain


def report(steps: list[tuple[str, object, float]], best: RagParams, before: float, after: float) -> str:
    """A sweep in words: objective before and after, every accepted change, the parameters (a few lines, made on the driver)."""
    lines = [f"objective {before:.4f} -> {after:.4f}", *(f"{name} = {value}: {got:.4f}" for name, value, got in steps), repr(best)]
    return "\n".join(lines) + "\n"
