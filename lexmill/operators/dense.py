"""Dense retrieval: the hashing encoder and exhaustive cosine top-k of a stated query set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import exploded_terms
from lexmill.functions.vectors import fnv

DIM, SIGN_SEED, BIGRAM_WEIGHT = 512, 5381, 0.6


def hashed_sparse(df: DataFrame, text: str, key: str, dim: int = DIM) -> DataFrame:
    """(key, idx, value): L2-normalised sparse vectors of hashed words and word pairs."""
    words = exploded_terms(df, F.col(text), key, pos=True)
    after = F.lead("term").over(Window.partitionBy(key).orderBy("pos"))
    both = words.withColumn("after", after)
    grams = both.select(key, F.explode(F.array(F.struct(F.col("term").alias("g"), F.lit(1.0).alias("w")), F.struct(F.concat_ws("_", "term", F.when(F.col("after").isNotNull(), F.col("after"))).alias("g"), F.when(F.col("after").isNotNull(), F.lit(BIGRAM_WEIGHT)).alias("w")))).alias("x"))
    counts = grams.where("x.w is not null").groupBy(key, F.col("x.g").alias("gram")).agg(F.sum("x.w").alias("n"))
    h, s = fnv(F.regexp_replace("gram", "[^\\x00-\\x7f]", "?")), fnv(F.regexp_replace("gram", "[^\\x00-\\x7f]", "?"), SIGN_SEED)
    cells = counts.select(key, F.pmod(h, F.lit(dim)).cast("int").alias("idx"), (F.when(s.bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0) * (1 + F.log("n"))).alias("v"))
    summed = cells.groupBy(key, "idx").agg(F.sum("v").alias("v"))
    n = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    return summed.select(key, "idx", (F.col("v") / F.when(n == 0, 1.0).otherwise(n)).alias("value"))


def cosine_top_k(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vec: str = "embedding", k: int = 10, block: int = 2048) -> DataFrame:
    """(query, near, cosine, rank): the stated queries against all vectors, in blocks.

    Queries are grouped in blocks of ``block`` and every block is paired with every slice of the vectors; each task scores a
    block by one matrix product and keeps its k best, so what is merged is k rows a query and slice.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, qv, keys, v = (b.column(i) for i in range(4))
            for at in range(b.num_rows):
                ask = np.array(q[at].as_py())
                left = _unit(np.array(qv[at].as_py(), np.float64))
                near = np.array(keys[at].as_py())
                right = _unit(np.array(v[at].as_py(), np.float64))
                cos = np.round(left @ right.T, 6)
                cos[ask[:, None] == near[None, :]] = -2
                take = min(k, len(near))
                # ties in favour of the smaller key: order by (-cosine, key)
                order = np.stack([np.lexsort((near, -row))[:take] for row in cos])
                best = np.take_along_axis(cos, order, 1)
                ok = best > -2
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ask, take).reshape(best.shape)[ok]), pa.array(near[order][ok]), pa.array(best[ok])], ["query", "near", "cosine"])

    slot = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    rows = vectors.where(F.col(vec).isNotNull() & (F.size(vec) > 0))
    slices = rows.select(F.spark_partition_id().alias("p"), F.floor(F.monotonically_increasing_id() % F.lit(1 << 33) / block).alias("s"), F.col(key).cast("long").alias("key"), F.col(vec).alias("v"))
    slices = slices.groupBy("p", "s").agg(F.collect_list("key").alias("keys"), F.collect_list("v").alias("vs"))
    asked = queries.where(F.col(vec).isNotNull() & (F.size(vec) > 0)).select(F.col(key).cast("long").alias("key"), F.col(vec).alias("v"))
    n_blocks = max(1, -(-asked.count() // block))
    blocks = asked.groupBy(slot("key", n_blocks).alias("b")).agg(F.collect_list("key").alias("q"), F.collect_list("v").alias("qv"))
    pairs = blocks.crossJoin(slices).select("q", "qv", "keys", "vs")  # a stated query set, in blocks, against all rows
    found = pairs.mapInArrow(score, "query long, near long, cosine double")
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), "near")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(n == 0, 1, n)


def sparse_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "chunk_no", qid: str = "qid") -> DataFrame:
    """(qid, key, rank, score): the k best of sparse unit vectors (key, idx, value) for sparse unit queries (qid, idx, value); only cells that a query has meet."""
    asked = queries.select(qid, "idx", F.col("value").alias("asked"))
    scores = vectors.join(asked, "idx").groupBy(qid, key).agg(F.round(F.sum(F.col("value") * F.col("asked")), 6).alias("score"))
    order = Window.partitionBy(qid).orderBy(F.desc("score"), key)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def in_batches(texts: Iterator[list[str]], encoder, size: int = 48, most: int = 6000) -> Iterator[list[list[float]]]:
    """Vectors of a remote encoder for lists of texts: at most ``size`` texts a call, each cut at ``most`` characters (the encoder's own limit), unit length."""
    for part in texts:
        out: list[list[float]] = []
        for at in range(0, len(part), size):
            got = np.asarray(encoder([t[:most] for t in part[at : at + size]]), float)
            out += _unit(got).tolist()
        yield out


def encode_missing(df: DataFrame, vec: str, encoder) -> DataFrame:
    """Stored vectors, encoded only where missing; ``encoder`` maps a text column to a vector column."""
    return df.withColumn(vec, F.coalesce(F.col(vec), F.when(F.col(vec).isNull(), encoder(F.col("text")))))


def same_encoder(df: DataFrame, column: str = "encoder") -> None:
    """Refuse to mix vectors of two encoders."""
    if df.select(column).distinct().limit(2).count() > 1:
        raise ValueError("vectors of different encoders can't be compared")
