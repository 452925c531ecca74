"""Queries of the steps around retrieval: dense and hybrid search, rewriting, re-ranking, routing, stores and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import guard, readability, text
from lexmill.operators import agents, dense, evaluation, fusion, lexical, metering, select
from lexmill.plans import queries as q
from lexmill.sources import files


def _dense_lists(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    chunks = dense.hashed_sparse(q._t(spark, d, "chunks"), "text", "chunk_no")
    return dense.sparse_top_k(chunks, dense.hashed_sparse(q._questions(spark, d), "query", "qid"), k)


def lexical_index(spark: SparkSession, d: str) -> DataFrame:
    """The stored indexes that questions read, built where they are missing: their settings and totals."""
    made = [q._index(spark, d, hw).lengths().agg(F.lit(hw).cast("bigint").alias("heading_weight"), F.count("*").alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).cast("bigint").alias("terms"), F.max("len").cast("bigint").alias("longest")) for hw in (1, 3)]
    return made[0].unionByName(made[1])


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 10 passages of the highest cosine of hashed vectors, of every gold question."""
    return _dense_lists(spark, d, 10).select("qid", "chunk_no", F.col("rank").cast("bigint").alias("rank"), F.round("score", 4).alias("score"))


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """Lexical and dense lists of every gold question, fused with equal weight."""
    words = lexical.top_k(lexical.bm25(q._index(spark, d), q._questions(spark, d)), 20).withColumn("list_no", F.lit(0))
    return q._fused(fusion.channels(words, _dense_lists(spark, d).withColumn("list_no", F.lit(0)), 0.5))


def _rewrites(spark: SparkSession, d: str) -> DataFrame:
    """Rewrites of the gold questions that hold 'the': the question, its second half, one off the topic."""
    halves = q._halves(spark, d).groupBy("qid").agg(F.max_by("query", F.struct(F.lit(1) - F.col("list_no"))).alias("query"), F.max_by("query", "list_no").alias("half"))
    return halves.where("query like '%the%'").select("qid", F.array("query", F.lit("qqq zzz"), "half", F.lit(" ")).alias("queries"), F.array(F.lit("security"), F.lit("deposit")).alias("terms"), F.lit(None).cast("string").alias("clarified"))


def rewrite_expansion(spark: SparkSession, d: str) -> DataFrame:
    return agents.expanded(q._questions(spark, d), _rewrites(spark, d), 3, True).select("qid", F.col("list_no").cast("bigint").alias("list_no"), "query")


def reranked_hits(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in model order: the first six of twelve hits by length of text, the longest first, with an invalid and a repeated place."""
    hits = q._hits(spark, d, 12)
    sized = hits.where("rank <= 6").join(q._t(spark, d, "chunks").select("chunk_no", F.length("text").alias("chars")), "chunk_no")
    order = fusion.ranked(sized.withColumnRenamed("rank", "place"), F.desc("chars"), F.col("place")).select("qid", "place", F.col("rank").alias("pos"))
    extra = order.where("pos = 1").select("qid", "place", F.lit(50).alias("pos")).unionByName(order.where("pos = 1").select("qid", F.lit(99).alias("place"), F.lit(0).alias("pos")))
    return agents.reranked(hits, order.where("pos <= 4").unionByName(extra), 6).select("qid", "chunk_no", F.col("rank").cast("bigint").alias("rank"))


def graded_hits(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in grader: it keeps the hits of statutes with a reference."""
    hits = q._hits(spark, d, 8)
    keep = hits.join(q._t(spark, d, "chunks").where("source <> 'user' and ref is not null").select("chunk_no"), "chunk_no").select("qid", F.col("rank").alias("place"))
    return agents.graded(hits, keep).select("qid", "chunk_no", F.col("rank").cast("bigint").alias("rank"))


def retrieval_stats(spark: SparkSession, d: str) -> DataFrame:
    lists = q._lists(spark, d)
    fused = fusion.rrf(lists)
    floored = fusion.score_floor(fused, 0.45)
    returned = fusion.ranked(floored.drop("rank"), F.desc("score"), F.col("chunk_no")).where("rank <= 8").join(q._t(spark, d, "chunks").select("chunk_no", F.length("text").alias("chars")), "chunk_no")
    out = agents.retrieval_stats(q._questions(spark, d), q._passages(spark, d), lists, None, fused, floored, returned)
    return out.select("qid", *(F.col(c).cast("bigint").alias(c) for c in ("indexed", "lexical", "dense", "fused", "after_floor", "returned", "chars")))


def quick_routes(spark: SparkSession, d: str) -> DataFrame:
    """Every routed message: the quick route, else the stored intent; a chat has documents where its messages needed retrieval."""
    m = metering.latest_delivery(q._t(spark, d, "messages")).where("role = 'user'").select("msg_no", "content")
    r = q._t(spark, d, "route_results").select("msg_no", F.col("intent").alias("said"), F.coalesce("needs_retrieval", F.lit(False)).alias("docs"), "language", "reason")
    out = agents.routed(m.join(r, "msg_no"), "content", "docs", "said", "language", "reason")
    return out.select("msg_no", "intent", "needs_retrieval", "route_language", "route_reason")


def full_verdicts(spark: SparkSession, d: str) -> DataFrame:
    rows = guard.verdicts(q._t(spark, d, "messages").where("role = 'user'").select("msg_no", "received_at", "content"), "content")
    return rows.select("msg_no", "received_at", "ok", "category", F.md5("sanitised").alias("sanitised"), F.array_join("redactions", ",").alias("redactions"), F.array_join("notices", "|").alias("notices"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    rows = metering.latest_delivery(q._t(spark, d, "messages")).where("role = 'assistant' and content is not null")
    rows = rows.select("msg_no", "content", "created_at", "received_at", *(c.cast("bigint").alias(k) for k, c in readability.measures(F.col("content")).items()))
    return rows.withColumn("flesch", F.round(readability.flesch(F.col("words"), F.col("sentences"), F.col("syllables")), 1))


def readability_gate(spark: SparkSession, d: str) -> DataFrame:
    """Which answers are to be put more simply, and whether their plain-word version would be taken."""
    rows = _answers(spark, d).withColumn("plain", text.plain_words(F.col("content")))
    m = readability.measures(F.col("plain"))
    after = F.round(readability.flesch(m["words"].cast("bigint"), m["sentences"].cast("bigint"), m["syllables"].cast("bigint")), 1)
    hard = guard.wants_simpler(F.col("content"), F.col("flesch"), readability.unexplained_jargon(F.col("content")))
    return rows.select("msg_no", "flesch", hard.alias("hard"), (hard & guard.keeps_simpler(F.col("content"), F.col("plain"), F.col("flesch"), after)).alias("taken"))


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    ms = (F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1000
    return agents.run_summary(_answers(spark, d).select(F.lit(False).alias("blocked"), (F.col("content") == "").alias("failed"), "flesch", ms.alias("ms"), F.col("content").alias("answer")))


def chat_store(spark: SparkSession, d: str) -> DataFrame:
    kept = metering.stored_chats(metering.latest_delivery(q._t(spark, d, "messages")))
    line = lambda m: F.concat_ws(":", m.role, F.coalesce(m.content, F.lit("")))
    return kept.select("user_id", "chat_id", F.col("rank").cast("bigint").alias("rank"), F.size("messages").cast("bigint").alias("kept"), F.md5(F.array_join(F.transform("messages", line), "\n")).alias("history"))


def open_chats(spark: SparkSession, d: str) -> DataFrame:
    """Local copies are of the first half of the turns, the server's of assistant messages: the newer stands."""
    m = metering.latest_delivery(q._t(spark, d, "messages"))
    local = m.where("turn <= 4").groupBy("chat_id").agg(F.max("created_at").alias("updated"), F.count("*").alias("messages"))
    server = m.where("role = 'assistant'").groupBy("chat_id").agg(F.max("created_at").alias("updated"), F.count("*").alias("messages"))
    return metering.opened(local, server, "chat_id", "updated").select("chat_id", "updated", "messages", "origin")


def prompt_texts(spark: SparkSession, d: str) -> DataFrame:
    """The blocks that a chat's latest question goes out with."""
    m = metering.latest_delivery(q._t(spark, d, "messages"))
    asked = metering.recent(m.where("role = 'user'"), "chat_id", "turn", "msg_no", 1).select("chat_id", F.col("content").alias("question"))
    said = metering.recent(m.where("role = 'assistant'"), "chat_id", "turn", "msg_no", 1).select("chat_id", F.col("content").alias("history"))
    rows = asked.join(said, "chat_id", "left")
    return rows.select("chat_id", F.md5(agents.prompt_blocks([("Earlier", F.col("history")), ("Question", F.col("question"))])).alias("prompt"))


def manifest_rows(spark: SparkSession, d: str) -> DataFrame:
    return files.manifest_rows(q._t(spark, d, "chunks").select("chunk_no", "title", "text"))


def usage_resets(spark: SparkSession, d: str) -> DataFrame:
    """When the allowance of each day's last call returns, and what is said until then."""
    last = q._t(spark, d, "events").groupBy(metering.local_day(F.col("ts")).cast("string").alias("day")).agg(F.max("ts").alias("at"))
    reset = metering.next_reset(F.col("at"))
    left = F.unix_timestamp(reset.cast("timestamp")) - F.unix_timestamp(F.col("at").cast("timestamp"))
    return last.select("day", reset.alias("reset_at"), metering.exhausted_message(left, F.lit("user")).alias("message"))


def text_marks(spark: SparkSession, d: str) -> DataFrame:
    """Small text functions over whole columns: file title, collapsed and capped text, leading number, device id, age."""
    now = F.lit("2025-06-01 00:00:00").cast("timestamp_ntz")
    m = q._t(spark, d, "doc_meta").dropDuplicates(["doc_id", "name", "created_at"])
    return m.select("doc_id", F.coalesce("name", F.lit("")).alias("name"), text.file_title(F.col("name")).alias("title"), text.collapsed(F.concat(F.lit(" "), "name", F.lit("  x"))).alias("flat"), F.length(text.capped(F.repeat("name", 2), 20)).cast("bigint").alias("capped"), text.leading_int(F.regexp_extract("name", "([0-9]+[^0-9]*)$", 1)).cast("bigint").alias("number"), text.device_id(F.concat("name", F.lit("#é_1"))).alias("device"), text.relative_time(F.col("created_at"), now).alias("age"))


def source_overview(spark: SparkSession, d: str) -> DataFrame:
    """Cited passages by origin of every question."""
    cited = select.citations(select.labelled(q._hits(spark, d, 6), q._passages(spark, d)))
    return cited.groupBy("qid").agg(F.count_if(F.col("source") == "user").alias("own"), F.count_if(F.col("source") != "user").alias("law"))


def rewrite_samples(spark: SparkSession, d: str) -> DataFrame:
    """Two rewrite samples (the question, its half) judged and averaged: means, questions any sample hits, spread."""
    hits = lexical.top_k(lexical.bm25(q._index(spark, d, 3), q._halves(spark, d), "qno", "query"), 12, "qno")
    each = None
    for n in (0, 1):
        mine = hits.where(F.endswith("qno", F.lit(f"/{n}"))).select(F.element_at(F.split("qno", "/"), 1).alias("qid"), "chunk_no", "rank", "score")
        part = q._judge(spark, d, mine, 12).withColumn("sample", F.lit(n))
        each = part if each is None else each.unionByName(part)
    out = evaluation.over_samples(each)
    return out.select(*(F.round(c, 6).alias(c) for c in ("hit", "rr", "ndcg", "coverage", "objective", "hit_spread", "any_hit")))


QUERIES = {
    f.__name__: f
    for f in (
        lexical_index, dense_topk, hybrid_topk, rewrite_expansion, reranked_hits, graded_hits, retrieval_stats, quick_routes, full_verdicts, readability_gate, run_summary, chat_store, open_chats, prompt_texts,
        manifest_rows, usage_resets, text_marks, source_overview, rewrite_samples,
    )
}
