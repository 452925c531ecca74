"""The core's queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import guard, readability, risk, text, vectors
from lexmill.operators import chunking, corpus, dense, evaluation, fusion, lexical, metering, select
from lexmill.params import GRID
from lexmill.sources import files


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "chunks").select("chunk_no", "chunk_id", "doc_id", "source", "text", "title", "ref", "heading", "page", "ordinal")


def _index(spark: SparkSession, d: str, heading_weight: float = 1) -> lexical.Index:
    """The chunks' index, stored in the session's shared folder (built once for its files); without such a folder it is a plan."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    passages = _passages(spark, d)
    return lexical.StoredIndex.cached(passages, folder.rstrip("/"), heading_weight=heading_weight) if folder else lexical.Index(passages, heading_weight=heading_weight)


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "goldset").select(F.col("id").alias("qid"), "query")


def _halves(spark: SparkSession, d: str) -> DataFrame:
    """Each question as two queries: itself, and its text from the middle word on."""
    q = _questions(spark, d)
    words = F.split("query", " ")
    half = F.array_join(F.slice(words, F.floor(F.size(words) / 2).cast("int") + 1, F.size(words)), " ")
    return q.select("qid", F.posexplode(F.array("query", half)).alias("list_no", "query")).withColumn("qno", F.concat_ws("/", "qid", F.col("list_no").cast("string")))


def _lists(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    q = _halves(spark, d)
    scored = lexical.bm25(_index(spark, d), q, "qno", "query")
    hits = lexical.top_k(scored, k, "qno")
    return hits.select(F.element_at(F.split("qno", "/"), 1).alias("qid"), F.element_at(F.split("qno", "/"), 2).cast("int").alias("list_no"), "chunk_no", "rank", "score")


def _hits(spark: SparkSession, d: str, k: int = 8, hw: float = 1) -> DataFrame:
    return lexical.top_k(lexical.bm25(_index(spark, d, hw), _questions(spark, d)), k)


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "chunks").select("chunk_no", F.md5(text.normalised(F.col("text"))).alias("md5"))


def term_df(spark: SparkSession, d: str) -> DataFrame:
    terms = text.exploded_terms(_t(spark, d, "chunks"), F.col("text"), "chunk_no")
    each = terms.groupBy("term", "chunk_no").agg(F.count("*").alias("tf"))
    return each.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("bigint").alias("cf"))


def doc_length_stats(spark: SparkSession, d: str) -> DataFrame:
    lengths = _index(spark, d, 3).lengths()
    return lengths.agg(F.count("*").alias("docs"), F.sum("len").cast("bigint").alias("terms"), F.max("len").cast("bigint").alias("longest"))


def extract_refs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "chunks").select("chunk_no", text.extracted_ref(F.col("text")).alias("ref"))


def heading_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(text.is_heading(F.col("line"))).alias("headings"))


def marginal_notes(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "chunks").select("chunk_no", text.marginal_note(F.col("text")).alias("note"))


def text_labels(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("name")
    return _t(spark, d, "acts").select("name", text.slug(name).alias("slug"), text.act_display(name).alias("display"), text.chat_title(F.concat(name, F.lit("  "), name)).alias("title"), text.user_name(name).alias("user"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, 10).select("qid", "chunk_no", "score", F.col("rank").cast("bigint").alias("rank"))


def bm25_heading_boost(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, 10, 3).select("qid", "chunk_no", "score", F.col("rank").cast("bigint").alias("rank"))


def fnv_hash_buckets(spark: SparkSession, d: str) -> DataFrame:
    terms = text.exploded_terms(_t(spark, d, "documents"), F.col("text"), "doc_id").select("term").distinct().where("term rlike '^[a-z0-9]+$'")
    return terms.select("term", vectors.fnv(F.col("term")).alias("hash"), F.pmod(vectors.fnv(F.col("term")), F.lit(512)).alias("idx"), (vectors.fnv(F.col("term"), dense.SIGN_SEED).bitwiseAND(F.lit(1)) == 1).alias("positive"))


def hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = dense.hashed_sparse(_t(spark, d, "documents"), "text", "doc_id")
    return v.groupBy("doc_id").agg(F.count("*").alias("cells"), F.round(F.max("value"), 5).alias("top"), F.round(F.sum(F.col("value") * F.col("value")), 5).alias("norm"))


def quantize_vectors(spark: SparkSession, d: str) -> DataFrame:
    q = vectors.quantised(F.col("embedding"))
    return _t(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(q, lambda x: x.cast("string")), ",").alias("q"))


def quantize_loss(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "embeddings").select("vec_id", "embedding", vectors.quantised(F.col("embedding")).alias("q"))
    size = F.sqrt(vectors.dot(F.col("embedding"), F.col("embedding")) * vectors.dot(F.col("q"), F.col("q")))
    return rows.select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("q")) / F.when(size == 0, 1.0).otherwise(size), 4).alias("cosine"))


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings")
    return dense.cosine_top_k(e, e.where("vec_id % 50 = 0")).select(F.col("query").alias("vec_id"), "near", "cosine", F.col("rank").cast("bigint").alias("rank"))


def _fused(df: DataFrame, k: int = 10) -> DataFrame:
    return df.where(F.col("rank") <= k).select("qid", "chunk_no", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return _fused(fusion.rrf(_lists(spark, d)))


def fuse_best_rank(spark: SparkSession, d: str) -> DataFrame:
    return _fused(fusion.by_best_rank(_lists(spark, d)))


def fuse_best_score(spark: SparkSession, d: str) -> DataFrame:
    return _fused(fusion.by_best_score(_lists(spark, d)))


def fuse_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _fused(fusion.by_weighted_queries(_lists(spark, d), 0.7))


def source_boost(spark: SparkSession, d: str) -> DataFrame:
    return _fused(fusion.source_boost(fusion.rrf(_lists(spark, d)), _passages(spark, d).select("chunk_no", "source"), 1.15))


def score_floor(spark: SparkSession, d: str) -> DataFrame:
    return fusion.score_floor(fusion.rrf(_lists(spark, d)), 0.45).select("qid", "chunk_no", F.round("score", 6).alias("score"))


def mmr_select(spark: SparkSession, d: str) -> DataFrame:
    hits = fusion.rrf(_lists(spark, d)).join(_t(spark, d, "chunks").select("chunk_no", "text", "vec"), "chunk_no")
    return select.mmr(hits, 8, 0.7)


def neighbor_expand(spark: SparkSession, d: str) -> DataFrame:
    out = select.with_neighbours(_hits(spark, d, 3), _passages(spark, d), 1)
    return out.select("qid", "chunk_no", F.col("rank").cast("bigint").alias("rank"), "neighbour")


def context_budget(spark: SparkSession, d: str) -> DataFrame:
    hits = select.within_budget(select.labelled(_hits(spark, d, 12), _passages(spark, d)), 6000)
    return hits.select("qid", "chunk_no", F.col("rank").cast("bigint").alias("rank"), F.col("used").cast("bigint").alias("used"))


def citations(spark: SparkSession, d: str) -> DataFrame:
    c = select.citations(select.labelled(_hits(spark, d, 6), _passages(spark, d)))
    return c.select("qid", F.col("n").cast("bigint").alias("n"), "chunk_no", "title", "ref", F.md5("snippet").alias("snippet"), "score")


def contexts(spark: SparkSession, d: str) -> DataFrame:
    return select.context(select.within_budget(select.labelled(_hits(spark, d, 8), _passages(spark, d)), 24000))


def full_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """Questions to hits: lexical lists, fusion, source boost, floor, diversity, neighbours and budget."""
    passages = _passages(spark, d)
    fused = fusion.score_floor(fusion.source_boost(fusion.channels(_lists(spark, d), None, 1.0), passages.select("chunk_no", "source"), 1.15), 0.15)
    picked = select.mmr(fused.join(_t(spark, d, "chunks").select("chunk_no", "text", "vec"), "chunk_no"), 8, 0.85)
    winners = picked.drop("rank").withColumnRenamed("picked", "rank").join(fused.select("qid", "chunk_no", "score"), ["qid", "chunk_no"])
    near = select.with_neighbours(winners, passages, 1)
    return select.within_budget(select.labelled(near, passages), 24000).select("qid", "chunk_no", "rank", "label", "used")


def jaccard_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of each message with the one before it in its chat."""
    from pyspark.sql import Window

    m = metering.latest_delivery(_t(spark, d, "messages")).withColumn("before", F.lag("content").over(Window.partitionBy("chat_id").orderBy("turn", "msg_no")))
    return m.where("before is not null").select("msg_no", F.round(select.jaccard(F.col("content"), F.col("before")), 6).alias("overlap"))


def rewrite_guard(spark: SparkSession, d: str) -> DataFrame:
    q = _halves(spark, d)
    arrays = lambda df, *k: text.exploded_terms(df, F.col("query"), *k).groupBy(*k).agg(F.collect_set("term").alias("terms"))
    return fusion.on_topic(arrays(q, "qid", "list_no"), arrays(_questions(spark, d), "qid")).select("qid", "list_no")


def pii_redact(spark: SparkSession, d: str) -> DataFrame:
    rows = guard.masked_rows(_t(spark, d, "messages").select("msg_no", "content"), "content")
    return rows.select("msg_no", F.md5("masked").alias("masked"), F.array_join("found", ",").alias("found"))


def input_verdict(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "messages").where("role = 'user'").select("msg_no", guard.category(F.col("content")).alias("category"))


def output_guard(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "messages").where("role = 'assistant'").select("msg_no", F.md5(guard.checked_answer(F.col("content"), 2)).alias("text"))


def citation_check(spark: SparkSession, d: str) -> DataFrame:
    bad = guard.invalid_citations(F.col("content"), 2)
    return _t(spark, d, "messages").where("role = 'assistant'").select("msg_no", F.array_join(F.transform(F.array_sort(bad), lambda x: x.cast("string")), ",").alias("invalid"))


def readability_scores(spark: SparkSession, d: str) -> DataFrame:
    m = _t(spark, d, "documents").where("text is not null").select("doc_id", *(c.cast("bigint").alias(k) for k, c in readability.measures(F.col("text")).items()))
    w, s, y = F.col("words"), F.col("sentences"), F.col("syllables")
    return m.select("doc_id", "words", "sentences", "syllables", "long_words", F.round(readability.flesch(w, s, y), 1).alias("flesch"), F.round(readability.grade(w, s, y), 1).alias("grade"))


def jargon_flags(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.array_join(readability.unexplained_jargon(F.col("text")), ",").alias("jargon"))


def risk_clauses(spark: SparkSession, d: str) -> DataFrame:
    rows = risk.scored(risk.clauses(_t(spark, d, "documents"), F.col("text"), "doc_id"))
    return rows.groupBy("severity").agg(F.count("*").alias("clauses"), F.sum("score").cast("bigint").alias("score"), F.count_distinct("doc_id").alias("docs"))


def risk_findings(spark: SparkSession, d: str) -> DataFrame:
    f = risk.findings(_t(spark, d, "documents"), F.col("text"), "doc_id")
    return f.select("doc_id", F.col("rank").cast("bigint").alias("rank"), "severity", F.col("score").cast("bigint").alias("score"), "clause", F.array_join("reasons", "|").alias("reasons"))


def risk_keywords(spark: SparkSession, d: str) -> DataFrame:
    parts = _t(spark, d, "chunks").select("chunk_no", F.explode(F.split("text", "\\n+|(?<=[.?!])\\s+")).alias("clause")).where("clause <> ''")
    rows = parts.select("chunk_no", risk.keyword_score(F.col("clause")).alias("score")).where("score > 0")
    level = F.when(F.col("score") >= 4, "high").when(F.col("score") >= 2, "medium").otherwise("low")
    return rows.groupBy("chunk_no", level.alias("severity")).agg(F.count("*").alias("clauses"), F.sum("score").cast("bigint").alias("score"))


def structure_chunks(spark: SparkSession, d: str) -> DataFrame:
    units = _t(spark, d, "documents").where("text is not null").select("doc_id", F.lit(0).alias("unit"), "text")
    return chunking.chunks(units, 900, 180, True).select("doc_id", "ordinal", "chunk_id", "text", "ref", "heading")


def window_chunks(spark: SparkSession, d: str) -> DataFrame:
    units = _t(spark, d, "documents").where("text is not null").select("doc_id", F.lit(0).alias("unit"), "text")
    return chunking.chunks(units, 600, 100).select("doc_id", "ordinal", "text")


def act_passages(spark: SparkSession, d: str) -> DataFrame:
    pages = corpus.section_pages(_t(spark, d, "acts"))
    return chunking.stamped(chunking.chunks(pages, 900, 180, True), pages)


def chunk_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return chunking.length_percentiles(_t(spark, d, "chunks"))


def shard_manifest(spark: SparkSession, d: str) -> DataFrame:
    return files.sharded(_t(spark, d, "chunks").select("chunk_no", "text")).groupBy("shard").agg(F.count("*").alias("passages"), F.sum(F.length("text")).cast("bigint").alias("chars"))


def corpus_manifest(spark: SparkSession, d: str) -> DataFrame:
    return files.manifest(_t(spark, d, "chunks")).select("title", "passages", F.col("chars").cast("bigint").alias("chars"))


def acts_repaired(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.ordered(corpus.longest(corpus.repaired(corpus.exploded(_t(spark, d, "acts")))))
    return rows.select("name", "place", "section", "text")


def acts_recovered(spark: SparkSession, d: str) -> DataFrame:
    before = corpus.exploded(_t(spark, d, "acts"))
    return corpus.recovered(before, corpus.longest(corpus.repaired(before)))


def dedupe_longest(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.exploded(_t(spark, d, "acts")).withColumn("part", F.lit(0))
    return corpus.longest(rows).select("name", "section", "pos", F.length("text").cast("bigint").alias("chars"))


def acts_without_passages(spark: SparkSession, d: str) -> DataFrame:
    return corpus.missing(_t(spark, d, "acts").select("name"), _passages(spark, d).select(F.col("title").alias("name"))).select("name")


def page_plan(spark: SparkSession, d: str) -> DataFrame:
    return files.page_plan(_t(spark, d, "extracted_pages")).groupBy("doc_id", "plan").agg(F.count("*").alias("pages"))


def extraction_label(spark: SparkSession, d: str) -> DataFrame:
    return files.extraction_label(_t(spark, d, "extracted_pages"))


def _judge(spark: SparkSession, d: str, hits: DataFrame, k: int) -> DataFrame:
    passages = _passages(spark, d).select("chunk_no", "title", "ref", F.length("text").alias("chars"))
    targets = evaluation.gold_targets(_t(spark, d, "goldset"))
    return evaluation.per_question(hits.join(passages, "chunk_no").select("qid", "rank", "title", "ref", "chars"), targets, _questions(spark, d), k)


def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    each = _judge(spark, d, _hits(spark, d, 12, 3), 12)
    return each.select("qid", F.col("hit").cast("bigint").alias("hit"), *(F.round(c, 6).alias(c) for c in ("rr", "ndcg", "precision", "coverage")), F.col("returned").cast("bigint").alias("returned"))


def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    m = evaluation.means(_judge(spark, d, _hits(spark, d, 12, 3), 12))
    return m.select(*(F.round(c, 5).alias(c) for c in m.columns))


def param_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Mean metrics over the whole grid of k1 and b: one index, all trials in one pass."""
    trials = [(k1, b) for k1 in GRID["bm25_k1"] for b in GRID["bm25_b"]]
    tried = spark.createDataFrame([(n, *t) for n, t in enumerate(trials)], "trial int, k1 double, b double")
    scored = lexical.bm25_trials(_index(spark, d, 3), _questions(spark, d), trials)
    asked = F.concat_ws("/", F.col("trial").cast("string"), "qid").alias("qid")  # a question of a trial is judged as one of its own
    hits = lexical.top_k(scored.select(asked, "chunk_no", "score"), 12)
    passages = _passages(spark, d).select("chunk_no", "title", "ref", F.length("text").alias("chars"))
    hits = hits.join(passages, "chunk_no").select("qid", "rank", "title", "ref", "chars")
    targets = evaluation.gold_targets(_t(spark, d, "goldset")).crossJoin(tried).select(asked, "act", "ref")
    each = evaluation.per_question(hits, targets, _questions(spark, d).crossJoin(tried).select(asked), 12)
    each = each.withColumn("trial", F.element_at(F.split("qid", "/"), 1).cast("int")).join(tried, "trial")
    return evaluation.means(each, "k1", "b").select("k1", "b", "hit", "rr", "ndcg", "objective")


def daily_usage(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select(metering.local_day(F.col("ts")).alias("day"), F.col("user_id").cast("string").alias("user"), F.get_json_object("props", "$.k").alias("device"), F.col("value").alias("tokens"))
    return metering.usage_by_scope(e).select(F.col("day").cast("string").alias("day"), "scope", "who", F.round("used", 2).alias("used"))


def usage_tightest(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select(metering.local_day(F.col("ts")).alias("day"), F.col("user_id").cast("string").alias("user"), F.get_json_object("props", "$.k").alias("device"), F.col("value").alias("tokens"))
    s = metering.usage_by_scope(e).where("scope <> 'device'").select("day", "scope", F.when(F.col("scope") == "user", F.col("who")).alias("user"), F.round("used", 2).alias("used"))
    users = s.where("scope = 'user'").select("day", "user", "scope", F.lit(0).alias("scope_pos"), "used", F.lit(300.0).alias("limit"))
    everyone = users.select("day", "user").join(s.where("scope = 'global'").select("day", "scope", F.lit(2).alias("scope_pos"), "used", F.lit(20000.0).alias("limit")), "day")
    t = metering.tightest(users.unionByName(everyone.select(*users.columns)), "day", "user")
    return t.select(F.col("day").cast("string").alias("day"), "user", "ok", F.round("remaining", 2).alias("remaining"), "scope")


def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return metering.admitted(_t(spark, d, "events").select("event_id", "user_id", "ts"), 1).select("event_id")


def recent_chats(spark: SparkSession, d: str) -> DataFrame:
    chats = metering.latest_delivery(_t(spark, d, "messages")).groupBy("user_id", "chat_id").agg(F.max("created_at").alias("at"), F.count("*").alias("messages"))
    return metering.recent(chats, "user_id", "at", "chat_id", 40).select("user_id", "chat_id", F.col("rank").cast("bigint").alias("rank"), "messages")


def history_text(spark: SparkSession, d: str) -> DataFrame:
    """The last six messages of each chat, 400 characters each."""
    m = metering.latest_delivery(_t(spark, d, "messages"))
    last = metering.recent(m, "chat_id", "turn", "msg_no", 6)
    line = F.struct("turn", "msg_no", F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.left("content", F.lit(400))).alias("t"))
    return last.groupBy("chat_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x.t), "\n")).alias("history"))


def memory_merge(spark: SparkSession, d: str) -> DataFrame:
    m = metering.latest_delivery(_t(spark, d, "messages")).where("role = 'user'").select(F.col("user_id").alias("user"), F.col("content").alias("text"), "created_at", "turn")
    stored, facts = m.where("turn = 1").drop("turn"), m.where("turn > 1").drop("turn")
    return metering.new_facts(stored, facts).groupBy("user").agg(F.count("*").alias("facts"))


def json_salvage(spark: SparkSession, d: str) -> DataFrame:
    noisy = F.concat(F.lit("Here it is: ```json "), F.col("props"), F.lit(" ```"))
    return _t(spark, d, "events").select("event_id", F.get_json_object(text.salvaged_json(noisy), "$.k").alias("k"))


def latest_messages(spark: SparkSession, d: str) -> DataFrame:
    return metering.latest_delivery(_t(spark, d, "messages")).groupBy("role").agg(F.count("*").alias("messages"), F.sum(F.length("content")).cast("bigint").alias("chars"))


def document_sources(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "doc_meta").dropDuplicates(["doc_id"]).groupBy("source").agg(F.count("*").alias("docs"))


def plain_language(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.md5(text.plain_words(F.col("text"))).alias("plain"))


NAMES = (
    normalize_text, term_df, doc_length_stats, extract_refs, heading_lines, marginal_notes, text_labels, bm25_topk, bm25_heading_boost, fnv_hash_buckets, hashed_vectors, quantize_vectors, quantize_loss, cosine_topk,
    rrf_fuse, fuse_best_rank, fuse_best_score, fuse_weighted, source_boost, score_floor, mmr_select, neighbor_expand, context_budget, citations, contexts, full_retrieve, jaccard_repeats, rewrite_guard,
    pii_redact, input_verdict, output_guard, citation_check, readability_scores, jargon_flags, risk_clauses, risk_findings, risk_keywords, structure_chunks, window_chunks, act_passages, chunk_percentiles, shard_manifest,
    corpus_manifest, acts_repaired, acts_recovered, dedupe_longest, acts_without_passages, page_plan, extraction_label, eval_metrics, eval_summary, param_sweep, daily_usage, usage_tightest, rate_limit, recent_chats, history_text,
    memory_merge, json_salvage, latest_messages, document_sources, plain_language,
)
QUERIES = {f.__name__: f for f in NAMES}
