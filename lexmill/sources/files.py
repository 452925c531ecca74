"""Reading and writing: JSON lines, act files, texts, documents, pages, shards and keyed tables."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.text import trimmed

ACT = "name string, sections array<struct<section:string,text:string>>"
MAX_BYTES, MIN_TEXT_LAYER, MAX_VISION_PAGES = 25 * 1024 * 1024, 90, 20


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON lines file, and one row with the number of lines that can't be read; blank lines are neither."""
    bad = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).where("trim(value) <> ''")
    rows = lines.select(F.from_json("value", bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    return rows.where("_bad is null").drop("_bad"), rows.agg(F.count("_bad").alias("skipped"))


def acts_of(rows: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """Rows of type act with a name and text; of the curated names only, if given."""
    rows = rows.where("type = 'act' and name <> '' and text <> ''")
    return rows if curated is None else rows.join(curated.select("name").distinct(), "name", "left_semi")


def act_files(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.schema(ACT).json(directory, multiLine=True)


def gold_file(spark: SparkSession, path: str) -> DataFrame:
    item = "struct<id:string,query:string,relevant:array<struct<act:string,refs:array<string>>>>"
    return spark.read.schema(f"name string, purpose string, batch array<{item}>").json(path, multiLine=True).select(F.explode("batch").alias("b")).select("b.*")


def rewrite_file(spark: SparkSession, path: str) -> DataFrame:
    """(qid, queries, terms, clarified) of a file that maps question ids to rewrites."""
    kind = "map<string,struct<queries:array<string>,terms:array<string>,clarified:string>>"
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("qid", "r")).select("qid", "r.*")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, length, content) of files of a known kind, not empty and not too large."""
    rows = spark.read.format("binaryFile").load(path)
    end = F.lower(F.regexp_extract("path", "\\.([A-Za-z0-9]+)\\z", 1))
    kind = F.when(end.isin("txt", "md", "csv"), "text").when(end == "docx", "docx").when(end == "pdf", "pdf").when(end.isin("png", "jpg", "jpeg", "webp"), "image")
    return rows.select("path", kind.alias("kind"), "length", "content").where(F.col("kind").isNotNull() & (F.col("length") > 0) & (F.col("length") <= MAX_BYTES))


def docx_text(content: bytes) -> str:
    """The paragraphs of a document file."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))


def texts(rows: DataFrame) -> DataFrame:
    """(path, text) of text and document files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [docx_text(c) if k == "docx" else bytes(c).decode("utf-8", "replace") for k, c in zip(b["kind"], b["content"])]
            yield pd.DataFrame({"path": b["path"], "text": out})

    return rows.where("kind in ('text', 'docx')").select("path", "kind", "content").mapInPandas(read, "path string, text string")


def page_plan(pages: DataFrame) -> DataFrame:
    """(doc_id, page, plan): pages with a thin text layer are scans, of which the first MAX_VISION_PAGES are read and later ones skipped."""
    scan = F.coalesce(F.length(trimmed(F.col("text"))), F.lit(0)) < MIN_TEXT_LAYER
    rows = pages.withColumn("scan", scan)
    nth = F.sum(F.col("scan").cast("int")).over(Window.partitionBy("doc_id").orderBy("page", "page_no").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("plan", F.when(~F.col("scan"), "text").when(nth <= MAX_VISION_PAGES, "vision").otherwise("skipped")).drop("scan")


def extraction_label(pages: DataFrame) -> DataFrame:
    """(doc_id, extraction): the kind of a document's pages, mixed if there are several."""
    return pages.where("via is not null").groupBy("doc_id").agg(F.when(F.min("via") == F.max("via"), F.min("via")).otherwise("mixed").alias("extraction"))


def stitched(items: DataFrame) -> DataFrame:
    """(doc_id, page, text) of positioned pieces (doc_id, page, pos, str, eol): a line end where one is marked, else a blank."""
    piece = F.struct("pos", F.concat("str", F.when(F.col("eol"), "\n").when(F.col("str").rlike("\\s\\z"), "").otherwise(" ")).alias("s"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x.s), "")
    return items.groupBy("doc_id", "page").agg(trimmed(F.regexp_replace(F.regexp_replace(text, "[ \\t]+", " "), "\\n{3,}", "\n\n")).alias("text"))


def sharded(passages: DataFrame, order: str = "chunk_no", size: int = 900) -> DataFrame:
    """With the shard of each row: ``size`` rows each, in order. Rows of a range of keys are counted first; no task sorts the whole table."""
    bucket = F.floor(F.col(order) / 100_000)
    counts = passages.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("bucket", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy(order))
    rows = passages.withColumn("bucket", bucket).join(offsets, "bucket")
    return rows.withColumn("shard", F.floor((inside - 1 + F.col("before")) / size)).drop("bucket", "before")


def write_shards(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("shard").parquet(path)


def manifest(rows: DataFrame) -> DataFrame:
    """(title, passages, chars): a row an act, and the totals under a null title."""
    return rows.rollup("title").agg(F.count("*").alias("passages"), F.sum(F.length("text")).alias("chars"))


def manifest_rows(rows: DataFrame, size: int = 900) -> DataFrame:
    """(part, name, passages, chars, bytes): a row an act, a row a shard, and the totals."""
    counts = [F.count("*").alias("passages"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("chars"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("bytes")]
    acts = rows.groupBy(F.lit("act").alias("part"), F.col("title").alias("name")).agg(*counts)
    shards = sharded(rows, size=size).groupBy(F.lit("shard").alias("part"), F.col("shard").cast("string").alias("name")).agg(*counts)
    total = rows.agg(*counts).select(F.lit("total").alias("part"), F.lit(None).cast("string").alias("name"), "passages", "chars", "bytes")
    return acts.unionByName(shards).unionByName(total)


def write_corpus(rows: DataFrame, path: str, built_at: str, params: str) -> None:
    """Shards and their manifest: the rows of ``manifest_rows`` with when and how they were built."""
    write_shards(sharded(rows), f"{path}/shards")
    manifest_rows(rows).withColumns({"built_at": F.lit(built_at), "params": F.lit(params)}).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_corpus(spark: SparkSession, path: str, stored: DataFrame | None = None, stored_at: str | None = None) -> tuple[DataFrame, bool]:
    """(passages, fresh): the stored table if it was built when the manifest was and has the rows it names, else the shards read again."""
    total = spark.read.json(f"{path}/manifest").where("part = 'total'").select("built_at", "passages").first()
    if stored is not None and stored_at == total.built_at and stored.count() == total.passages:
        return stored, True
    return spark.read.parquet(f"{path}/shards").drop("shard"), False


def write_acts(acts: DataFrame, path: str) -> None:
    """One folder of JSON an act, replacing what was there."""
    acts.withColumn("act", F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-")).write.mode("overwrite").partitionBy("act").json(path)


def fresh(manifest_rows: int, stored: DataFrame) -> bool:
    """Whether a stored table has the rows its manifest names."""
    return stored.count() == manifest_rows


def refused(spark: SparkSession, path: str) -> DataFrame:
    """(path, reason) of the files that ``files`` leaves out: of an unknown kind or too large. Empty files have no row in the reader, so neither list has them."""
    rows = spark.read.format("binaryFile").load(path).select("path", "length")
    known = F.lower(F.regexp_extract("path", "\\.([A-Za-z0-9]+)\\z", 1)).isin("txt", "md", "csv", "docx", "pdf", "png", "jpg", "jpeg", "webp")
    reason = F.when(~known, "unknown kind").when(F.col("length") > MAX_BYTES, "too large")
    return rows.select("path", reason.alias("reason")).where("reason is not null")


def upserted(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with rows replaced or added by key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def without_documents(docs: DataFrame, passages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the documents of ``gone`` (doc_id)."""
    keys = gone.select("doc_id").distinct()
    return docs.join(keys, "doc_id", "left_anti"), passages.join(keys, "doc_id", "left_anti")


def file_stem(path: str) -> str:
    return re.sub(r"\.[^.]+$", "", path.rsplit("/", 1)[-1])
