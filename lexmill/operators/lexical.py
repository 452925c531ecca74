"""BM25 over passages with a repeated heading field, for a batch of questions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.text import exploded_terms


def indexed_terms(passages: DataFrame, key: str = "chunk_no", heading_weight: float = 1) -> DataFrame:
    """One row a term of a passage: title, reference and text, and the heading's terms heading_weight - 1 times more."""
    body = F.concat_ws(" ", "title", "ref", "text")
    terms = exploded_terms(passages, body, key)
    extra = 0
    while extra < heading_weight - 1:
        extra += 1
    if extra:
        again = exploded_terms(passages.where("heading is not null"), F.col("heading"), key)
        terms = terms.unionByName(again.select(key, "term").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(extra)))).drop("n"))
    return terms


class Index:
    """Postings of the asked terms, lengths and totals; the statistics cover every passage."""

    def __init__(self, passages: DataFrame, key: str = "chunk_no", heading_weight: float = 1) -> None:
        self.passages, self.key = passages, key
        self.terms = indexed_terms(passages, key, heading_weight)

    def lengths(self) -> DataFrame:
        counted = self.terms.groupBy(self.key).agg(F.count("*").alias("len"))
        return self.passages.select(self.key).join(counted, self.key, "left").select(self.key, F.coalesce("len", F.lit(0)).alias("len"))

    def postings(self, asked: DataFrame) -> DataFrame:
        """(term, key, tf) of the asked terms only: the terms are filtered before they are counted."""
        return self.terms.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term", self.key).agg(F.count("*").alias("tf"))


class StoredIndex(Index):
    """An index on disk: postings (term, key, tf) sorted by term in buckets, and lengths with the totals.

    A question batch reads the row groups of its terms only (statistics and pushed filters on term and bucket); nothing is tokenised again.
    """

    #: Buckets of terms, and parts of a bucket by passage (a term that every passage has is spread over them); more for a larger collection.
    BUCKETS, SPREAD = 16, 8

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_no") -> None:
        self.key, self.spark, self.path = key, spark, path
        # the key's type is the lengths' (one small file is looked at); nothing else is inferred
        self.kind = spark.read.parquet(f"{path}/lengths").schema[key].dataType.simpleString()
        self.totals = spark.read.schema("docs long, mean double, terms long").parquet(f"{path}/totals")

    @classmethod
    def build(cls, passages: DataFrame, path: str, key: str = "chunk_no", heading_weight: float = 1) -> StoredIndex:
        """Write the index to a folder the executors share."""
        spark, plain = passages.sparkSession, Index(passages, key, heading_weight)
        tf = plain.terms.groupBy("term", key).agg(F.count("*").alias("tf"))
        tf.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(cls.BUCKETS)).cast("int")).repartition("bucket", F.pmod(F.xxhash64(key), F.lit(cls.SPREAD))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
        stored = spark.read.parquet(f"{path}/postings")
        counted = stored.groupBy(key).agg(F.sum("tf").alias("len"))
        lens = passages.select(key).join(counted, key, "left").select(key, F.coalesce("len", F.lit(0)).alias("len"))
        lens.write.parquet(f"{path}/lengths")
        rows = spark.read.parquet(f"{path}/lengths").agg(F.count("*").alias("docs"), F.avg("len").alias("mean"), F.sum("len").alias("terms"))
        rows.coalesce(1).write.parquet(f"{path}/totals")
        return cls(spark, path, key)

    @classmethod
    def cached(cls, passages: DataFrame, folder: str, key: str = "chunk_no", heading_weight: float = 1) -> StoredIndex:
        """The index of these files under these settings, built where the folder has none; another file, size, time or setting is another index."""
        spark = passages.sparkSession
        conf = spark._jsc.hadoopConfiguration()
        state = []
        for f in sorted(passages.inputFiles()):
            at = spark._jvm.org.apache.hadoop.fs.Path(f)
            found = at.getFileSystem(conf).getFileStatus(at)
            state.append((f, found.getLen(), found.getModificationTime()))
        name = hashlib.sha256(repr((state, key, heading_weight, cls.BUCKETS)).encode()).hexdigest()[:32]
        path = f"{folder}/lexical-{name}"
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/totals/_SUCCESS")
        if done.getFileSystem(conf).exists(done):
            return cls(spark, path, key)
        started = spark._jvm.org.apache.hadoop.fs.Path(path)
        started.getFileSystem(conf).delete(started, True)  # what a broken build left behind
        return cls.build(passages, path, key, heading_weight)

    def lengths(self) -> DataFrame:
        return self.spark.read.schema(f"{self.key} {self.kind}, len long").parquet(f"{self.path}/lengths")

    def postings(self, asked: DataFrame) -> DataFrame:
        words = [r.term for r in asked.select("term").distinct().limit(self.LITERALS + 1).collect()]
        rows = self.spark.read.schema(f"term string, {self.key} {self.kind}, tf long, bucket int").parquet(f"{self.path}/postings")
        if len(words) <= self.LITERALS:  # few enough terms are pushed to the files' statistics
            buckets = self.spark.range(1).select(*(F.pmod(F.xxhash64(F.lit(w)), F.lit(self.BUCKETS)).alias(f"b{i}") for i, w in enumerate(words))).first() if words else []
            rows = rows.where(F.col("bucket").isin(*sorted(set(buckets))) & F.col("term").isin(*words)) if words else rows.limit(0)
        else:
            rows = rows.join(asked.select("term").distinct(), "term", "left_semi")
        return rows.select("term", self.key, "tf")

    #: Terms of a question batch that are written into the plan.
    LITERALS = 500


def question_terms(questions: DataFrame, qid: str, text: str) -> DataFrame:
    """(qid, term, first): distinct terms of each question with the place of the first occurrence."""
    rows = exploded_terms(questions, F.col(text), qid, pos=True)
    return rows.groupBy(qid, "term").agg(F.min("pos").alias("first"))


def _matches(index: Index, questions: DataFrame, qid: str, text: str) -> DataFrame:
    """The asked terms of each passage with all that a score needs."""
    asked = question_terms(questions, qid, text)
    lengths = index.lengths()
    every = getattr(index, "totals", None)
    every = lengths.agg(F.count("*").alias("docs"), F.avg("len").alias("mean")) if every is None else every
    totals = every.select("docs", F.greatest("mean", F.lit(0.0)).alias("mean")).select("docs", F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0).alias("mean"))
    postings = index.postings(asked)
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    return asked.join(postings, "term").join(df, "term").join(lengths, index.key).crossJoin(totals)  # totals: one row


def _score(k1: float, b: float) -> Column:
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return F.round(F.sum(part), 6)


def bm25(index: Index, questions: DataFrame, qid: str = "qid", text: str = "query", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(qid, key, score) of every passage that has a term of the question."""
    return _matches(index, questions, qid, text).groupBy(qid, index.key).agg(_score(k1, b).alias("score"))


def bm25_trials(index: Index, questions: DataFrame, trials: list[tuple[float, float]], qid: str = "qid", text: str = "query") -> DataFrame:
    """(trial, qid, key, score) for every pair (k1, b); trial is its place in the list. The index is read once for all."""
    scores = F.array(*(_score(k1, b) for k1, b in trials))
    return _matches(index, questions, qid, text).groupBy(qid, index.key).agg(scores.alias("scores")).select(F.posexplode("scores").alias("trial", "score"), qid, index.key)


def top_k(scored: DataFrame, k: int, qid: str = "qid", key: str = "chunk_no", score: str | Column = "score") -> DataFrame:
    """The k best of each question with their rank from 1; ties go to the smaller key."""
    order = Window.partitionBy(qid).orderBy(F.desc(score) if isinstance(score, str) else score.desc(), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
