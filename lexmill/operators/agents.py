"""Routing, rewriting and answering steps around retrieval; what a model says enters as columns or tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import exploded_terms, java, trimmed
from lexmill.operators import fusion

# Intents, greetings and words of risk.
INTENTS = ("law_question", "doc_question", "risk_scan", "summarise", "followup", "smalltalk", "out_of_scope")
GREETING = r"^(?:hi|hey|hello|namaste|yo|thanks|thank you|ok|okay|bye|good (?:morning|evening))\b"
RISKY = r"\b(?:risk|risky|unfair|trap|catch|danger|problem|red flag)\b"


def quick_intent(question: Column, has_docs: Column) -> Column:
    """smalltalk for a short greeting, risk_scan for words of risk about a document, else null."""
    t = F.lower(trimmed(question))
    return F.when((F.length(t) <= 24) & t.rlike(java(GREETING)), "smalltalk").when(has_docs & t.rlike(java(RISKY)), "risk_scan")


def routed(rows: DataFrame, question: str, has_docs: str, said: str, language: str, reason: str) -> DataFrame:
    """Rows with intent, needs_retrieval, route_language and route_reason: the quick route, else a model's valid answer, else the fallback."""
    quick, valid = quick_intent(F.col(question), F.col(has_docs)), F.col(said).isin(*INTENTS)
    fallback = F.when(F.col(has_docs), "doc_question").otherwise("law_question")
    intent = F.coalesce(quick, F.when(valid, F.col(said)), fallback)
    told = F.when(quick == "smalltalk", "greeting").when(quick.isNotNull(), "risk keywords").when(valid, F.coalesce(reason, F.lit(""))).otherwise("fallback")
    spoken = F.when(quick.isNull() & valid & (F.col(language) != ""), F.col(language)).otherwise("en")
    needs = F.when(quick.isNotNull(), quick != "smalltalk").when(valid, ~F.col(said).isin("smalltalk", "out_of_scope")).otherwise(True)
    return rows.withColumns({"intent": intent, "needs_retrieval": F.coalesce(needs, F.lit(True)), "route_language": spoken, "route_reason": told})


def _topics(df: DataFrame, text: str, *keys: str) -> DataFrame:
    return exploded_terms(df, F.col(text), *keys).groupBy(*keys).agg(F.collect_set("term").alias("terms"))


def expanded(questions: DataFrame, rewrites: DataFrame, multi_query: int, use_terms: bool) -> DataFrame:
    """(qid, list_no, query): the question, its rewrites that keep to the topic (up to multi_query), and its terms as one more query.

    rewrites: (qid, queries, terms, clarified); the first query is the question again. A question without rewrites stays alone.
    """
    both = questions.select("qid", "query").join(rewrites.select("qid", "queries", "terms", "clarified"), "qid", "left")
    about = F.concat_ws(" ", "query", "clarified", F.array_join(F.coalesce("terms", F.array().cast("array<string>")), " "))
    topic = _topics(both.select("qid", about.alias("about")), "about", "qid")
    others = both.select("qid", F.posexplode(F.slice("queries", 2, 1000)).alias("pos", "query")).where(F.length(F.trim("query")) > 0)
    kept = fusion.on_topic(others.join(_topics(others, "query", "qid", "pos"), ["qid", "pos"], "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>"))), topic)
    kept = fusion.ranked(kept.select("qid", "pos", "query"), F.col("pos")).where(F.col("rank") <= multi_query).select("qid", F.col("rank").alias("list_no"), "query")
    out = questions.select("qid", F.lit(0).alias("list_no"), "query").unionByName(kept)
    if not use_terms:
        return out
    words = F.trim(F.array_join("terms", " "))
    last = out.groupBy("qid").agg((F.max("list_no") + 1).alias("list_no"))
    return out.unionByName(rewrites.where(F.length(words) > 8).select("qid", words.alias("query")).join(last, "qid").select("qid", "list_no", "query"))


def reranked(hits: DataFrame, order: DataFrame | None, top: int) -> DataFrame:
    """The first ``top`` hits in a model's order (qid, place, pos), the others dropped; without an order nothing changes."""
    return hits if order is None else fusion.apply_order(hits.where(F.col("rank") <= top), order)


def graded(hits: DataFrame, keep: DataFrame) -> DataFrame:
    """Hits at the places a grader keeps (qid, place); under three hits, or where it keeps none of them, all stay."""
    said = keep.select("qid", F.col("place").alias("rank")).distinct().withColumn("__kept", F.lit(True))
    rows = hits.join(said, ["qid", "rank"], "left")
    per = rows.groupBy("qid").agg(F.count("*").alias("__n"), F.count("__kept").alias("__k"))
    return rows.join(per, "qid").where((F.col("__n") < 3) | (F.col("__k") == 0) | F.col("__kept")).drop("__kept", "__n", "__k")


def retrieval_stats(questions: DataFrame, indexed: DataFrame, lexical: DataFrame, dense: DataFrame | None, fused: DataFrame, floored: DataFrame, returned: DataFrame) -> DataFrame:
    """(qid, indexed, lexical, dense, fused, after_floor, returned, chars) of every question; returned has chars."""
    none = questions.select("qid").limit(0)
    counts = [(lexical, F.count_distinct("chunk_no"), "lexical"), (dense if dense is not None else None, F.count_distinct("chunk_no"), "dense"), (fused, F.count("*"), "fused"), (floored, F.count("*"), "after_floor"), (returned, F.count("*"), "returned"), (returned, F.sum("chars"), "chars")]
    out = questions.select("qid")
    for df, agg, name in counts:
        part = none.withColumn(name, F.lit(0).cast("long")) if df is None else df.groupBy("qid").agg(agg.alias(name))
        out = out.join(part, "qid", "left")
    out = out.na.fill(0, ["lexical", "dense", "fused", "after_floor", "returned", "chars"])
    return out.crossJoin(indexed.agg(F.count("*").alias("indexed")))  # one row


def prompt_blocks(blocks: list[tuple[str, Column]]) -> Column:
    """Headed blocks joined by blank lines, empty ones left out."""
    return F.concat_ws("\n\n", *(F.when(F.length(F.coalesce(c, F.lit(""))) > 0, F.concat(F.lit(f"{head}:\n"), c)) for head, c in blocks))


def memory_facts(said: Column, most: int = 4) -> Column:
    """At most four trimmed facts of over three characters from what a model said."""
    return F.slice(F.transform(F.filter(said, lambda f: F.length(F.trim(f)) > 3), lambda f: F.trim(f)), 1, most)


def run_summary(runs: DataFrame, score: str = "flesch", ms: str = "ms", text: str = "answer") -> DataFrame:
    """One row: answered, blocked, failed, the upper median score, the mean latency and the answers with dashes (runs: blocked, failed, score, ms, answer).

    Scores are counted first, so the running sum goes over distinct scores.
    """
    answered = F.col(score).isNotNull()
    totals = runs.agg(F.count_if(answered).alias("answered"), F.count_if("blocked").alias("blocked"), F.count_if("failed").alias("failed"), F.floor(F.avg(F.when(answered, F.col(ms))) + 0.5).cast("long").alias("mean_ms"), F.count_if(answered & F.col(text).rlike("[–—]")).alias("dashes"))
    from pyspark.sql import Window

    counts = runs.where(answered).groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    median = counts.select("s", upto.alias("upto"), total.alias("total")).where(F.col("upto") >= F.floor(F.col("total") / 2) + 1).agg(F.min("s").alias("median"))
    return totals.crossJoin(median)  # one row each
