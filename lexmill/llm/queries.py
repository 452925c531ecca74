"""Queries of the training-data operators, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import canonical, knn, langid, mixing, neardup, ocr, pii, splitting, tokenise, truncation
from lexmill.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr.line_faults(table(spark, d, "extracted_pages"))


def p1_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return ocr.paragraphs(table(spark, d, "extracted_pages"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    model = langid.fit(table(spark, d, "documents"))
    return langid.unnamed_languages(table(spark, d, "messages"), table(spark, d, "route_results"), model)


def p2_languages(spark: SparkSession, d: str) -> DataFrame:
    model = langid.fit(table(spark, d, "documents"))
    return langid.segment_languages(table(spark, d, "messages").where("role = 'user'"), model)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    docs = canonical.look_alike_pairs(table(spark, d, "documents"), "doc_id", "text")
    chunks = canonical.look_alike_pairs(table(spark, d, "chunks"), "chunk_no", "text")
    return docs.select(F.lit("documents").alias("tab"), "key_a", "key_b").unionByName(chunks.select(F.lit("chunks").alias("tab"), "key_a", "key_b"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every text that isn't blank with the class of its form: the form to join on where pairs would be many."""
    parts = [canonical.look_alike_classes(table(spark, d, tab), key, "text").select(F.lit(tab).alias("tab"), "key", "class", "spellings") for tab, key in (("documents", "doc_id"), ("chunks", "chunk_no"))]
    return parts[0].unionByName(parts[1])


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    parts = [("documents", "doc_id"), ("chunks", "chunk_no")]
    forms = [table(spark, d, tab).select(F.lit(tab).alias("tab"), F.col(key).alias("key"), canonical.one_form_column(F.col("text")).alias("text")) for tab, key in parts]
    return forms[0].unionByName(forms[1])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_pairs(table(spark, d, "chunks")).select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return neardup.classes_with_links(table(spark, d, "chunks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = knn.nearest(table(spark, d, "chunks"), table(spark, d, "vec_probes"))
    return found.select(F.col("query").alias("chunk_no"), F.col("near").alias("near_no"))


def p5_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Queries: every chunk whose number is divisible by 50, against all rows."""
    chunks = table(spark, d, "chunks")
    found = knn.nearest(chunks, chunks.where("chunk_no % 50 = 0").select("chunk_no"), share=1 / 16)
    return found.select(F.col("query").alias("chunk_no"), F.col("near").alias("near_no"), "cosine", "rank")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.boundary_gaps(table(spark, d, "chunks"), "chunk_no", "text").select("chunk_no", "cut")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_pieces(table(spark, d, "chunks"), "chunk_no", "text", ("heading",))


def p6_files(spark: SparkSession, d: str) -> DataFrame:
    """Every act as a file of the shared folder, cut by byte ranges."""
    acts = table(spark, d, "acts").where("name is not null").groupBy("name").agg(F.max(F.array_join(F.transform("sections", lambda s: s.text), "\n")).alias("text"))
    stored = splitting.write_files(acts, "name", "text", f"acts-{uuid.uuid4().hex}").collect()  # the acts' names, a fixed list
    pieces = splitting.split_files(spark, [r.path for r in stored], range_size=1 << 12)
    names = spark.createDataFrame([(r.path, r.name) for r in stored], "path string, name string")
    return pieces.join(F.broadcast(names), "path").select("name", "piece_no", "piece_start", F.col("piece").cast("string").alias("piece"), "cut")


def _personal(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, str, str]]:
    """(src, table, key, text) of the texts with personal data."""
    return [("messages", table(spark, d, "messages"), "msg_no", "content"), ("extracted_pages", table(spark, d, "extracted_pages"), "page_no", "text"), ("input_verdicts", table(spark, d, "input_verdicts"), "msg_no", "sanitised")]


def _masker(spark: SparkSession, d: str) -> pii.Model:
    return pii.fitted(table(spark, d, "messages"), table(spark, d, "input_verdicts"), "msg_no", "content", "sanitised")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    model = _masker(spark, d)
    found = [pii.counted(t, key, text, model).select(F.lit(src).alias("src"), "row_key", "kind", "nth") for src, t, key, text in _personal(spark, d)]
    # a message delivered twice has the same content and items: they are counted once
    return found[0].distinct().unionByName(found[1]).unionByName(found[2])


def p7_masked(spark: SparkSession, d: str) -> DataFrame:
    """The masked text of every row, rows stored twice and null texts included."""
    model = _masker(spark, d)
    masked = [t.select(F.lit(src).alias("src"), F.col(key).alias("row_key"), pii.masked(F.col(text), model).alias("text")) for src, t, key, text in _personal(spark, d)]
    return masked[0].unionByName(masked[1]).unionByName(masked[2])


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenise.encode_corpus(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.queue(mixing.draw(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.share_report(mixing.draw(table(spark, d, "documents"), targets), targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents")).where("cut").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}
