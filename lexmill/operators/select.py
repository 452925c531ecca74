"""Choosing what a question gets: diversity, neighbours, character budget, context and citations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import citation_label


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of lower-case words of over three letters."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^A-Za-z0-9_]+"), lambda w: F.length(w) > 3))
    x, y = words(a), words(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def mmr(hits: DataFrame, k: int, lam: float) -> DataFrame:
    """Maximal marginal relevance over (qid, chunk_no, score, rank, text, vec): k of each question's candidates, which are bounded by the lists' k."""
    if lam >= 1:
        return hits.where(F.col("rank") <= k).select("qid", "chunk_no", "rank", F.col("rank").alias("picked"))

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank").reset_index(drop=True)
        like = _likeness(group)
        gain = lam * group["score"].to_numpy(float) / (group["score"].iloc[0] or 1.0)
        worst = np.zeros(len(group))  # likeness to the nearest picked one, never under 0
        got: list[int] = []
        for _ in range(min(k, len(group))):
            value = gain - (1 - lam) * worst
            value[got] = -np.inf
            got.append(int(value.argmax()))
            worst = np.maximum(worst, like[got[-1]])
        out = group.loc[got, ["qid", "chunk_no", "rank"]].copy()
        out["picked"] = range(1, len(got) + 1)
        return out

    qid, key = hits.schema["qid"].dataType.simpleString(), hits.schema["chunk_no"].dataType.simpleString()
    return hits.select("qid", "chunk_no", "score", "rank", "text", "vec").groupBy("qid").applyInPandas(pick, f"qid {qid}, chunk_no {key}, rank int, picked int")


def _words(text: str) -> list[str]:
    import re

    return re.split(r"\W+", text.lower(), flags=re.ASCII)


def _likeness(group: pd.DataFrame) -> np.ndarray:
    """Likeness of all pairs of a question's candidates: the cosine where both have vectors, else the overlap of words."""
    words = [{w for w in _words(t) if len(w) > 3} for t in group["text"].fillna("")]
    out = np.array([[len(a & b) / len(a | b) if a | b else 0.0 for b in words] for a in words])
    size = max((len(v) for v in group["vec"] if v is not None), default=0)
    has = np.array([v is not None for v in group["vec"]])
    vec = np.array([np.pad(np.asarray(v, float), (0, size - len(v))) if v is not None else np.zeros(size) for v in group["vec"]])
    norm = np.linalg.norm(vec, axis=1)
    cosine = vec @ vec.T / np.where(norm == 0, 1.0, norm)[:, None] / np.where(norm == 0, 1.0, norm)[None, :]
    return np.where(has[:, None] & has[None, :], cosine, out)


def with_neighbours(winners: DataFrame, passages: DataFrame, window: int, share: float = 0.35) -> DataFrame:
    """Winners (qid, chunk_no, rank, score), then their neighbours by ordinal in the document, nearest first, each once."""
    if window <= 0:
        return winners.select("qid", "chunk_no", "score", "rank", F.lit(False).alias("neighbour"))
    place = passages.select("chunk_no", "doc_id", "ordinal")
    away = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(side).alias("side"), F.lit(d * step).alias("shift")) for d in range(1, window + 1) for side, step in ((0, -1), (1, 1)))))
    near = winners.join(place, "chunk_no").select("qid", "rank", "score", "doc_id", "ordinal", away.alias("a"))
    near = near.select("qid", "rank", "score", "doc_id", (F.col("ordinal") + F.col("a.shift")).alias("ordinal"), "a.d", "a.side")
    near = near.join(place, ["doc_id", "ordinal"]).join(winners.select("qid", "chunk_no"), ["qid", "chunk_no"], "left_anti")
    once = Window.partitionBy("qid", "chunk_no").orderBy("rank", "d", "side")
    near = near.withColumn("n", F.row_number().over(once)).where("n = 1")
    last = winners.groupBy("qid").agg(F.max("rank").alias("last"))
    order = Window.partitionBy("qid").orderBy("rank", "d", "side", "chunk_no")
    near = near.join(last, "qid").withColumn("at", F.row_number().over(order))
    rows = near.select("qid", "chunk_no", F.round(F.col("score") * share, 9).alias("score"), (F.col("last") + F.col("at")).alias("rank"), F.lit(True).alias("neighbour"))
    return winners.select("qid", "chunk_no", "score", "rank", F.lit(False).alias("neighbour")).unionByName(rows)


def labelled(hits: DataFrame, passages: DataFrame) -> DataFrame:
    """Hits with their passage and citation label."""
    rows = hits.join(passages.select("chunk_no", "source", "title", "ref", "page", "text"), "chunk_no")
    return rows.withColumn("label", citation_label(F.col("rank"), F.col("source"), F.col("title"), F.col("ref"), F.col("page")))


def within_budget(hits: DataFrame, most: int) -> DataFrame:
    """The leading hits whose labels and texts fit in ``most`` characters; the first always stays."""
    size = F.length("label") + 1 + F.length("text")
    used = F.sum(size).over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return hits.withColumn("used", used).where((F.col("used") <= most) | (F.col("rank") == 1))


def context(hits: DataFrame, rule: str = "\n\n---\n\n") -> DataFrame:
    """(qid, context): the passages of a question in rank order (bounded by the budget)."""
    piece = F.struct("rank", F.concat_ws("\n", "label", "text").alias("t"))
    return hits.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x.t), rule).alias("context"))


def citations(hits: DataFrame) -> DataFrame:
    return hits.select("qid", F.col("rank").alias("n"), "chunk_no", "title", "ref", "page", "source", F.left("text", F.lit(320)).alias("snippet"), (F.floor(F.col("score") * 10000 + 0.5) / 10000).alias("score"))
