import duckdb
import pytest

import __spark_entry__ as entry
from lexmill.plans import registry

DATA = "/root/testdata/sf0.001"


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["extract_refs", "pii_redact", "input_verdict", "citation_check", "quantize_vectors", "rate_limit", "recent_chats", "page_plan", "bm25_topk", "score_floor"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("chunks", "messages", "embeddings", "events", "extracted_pages", "goldset"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.queries()[name](spark, DATA)
    cur = con.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = sorted(map(repr, (tuple(r[cols.index(c)] for c in sorted(cols)) for r in cur.fetchall())))
    assert sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect()))) == want


def test_stream_equals_batch(spark, tmp_path):
    from lexmill.streaming import metering

    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = metering.daily_usage(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("usage").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.start, r.user_id): round(r.used, 2) for r in spark.table("usage").collect()}
    want = {(r.start, r.user_id): round(r.used, 2) for r in metering.daily_usage(events).collect()}
    assert len(got) > 100 and got == want


def test_late_calls_do_not_reset_the_limit(spark, tmp_path):
    from lexmill.streaming import metering

    schema = "event_id long, user_id long, ts timestamp"
    q = None
    for n, rows in enumerate([[(1, 7, "2024-01-01 10:00:10"), (2, 7, "2024-01-01 10:01:00"), (3, 7, "2024-01-01 10:01:10")], [(4, 7, "2024-01-01 10:00:50")], [(5, 7, "2024-01-01 10:01:20"), (6, 8, "2024-01-01 10:01:20")]]):
        spark.createDataFrame(rows, "event_id long, user_id long, ts string").selectExpr("event_id", "user_id", "timestamp(ts) AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if q is None:
            stream = metering.rate_limited(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 2)
            q = stream.writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "ck")).start()
        q.processAllAvailable()
    q.stop()
    # a late call of 10:00 is the second of its minute; 10:01 has had its two
    assert sorted(r.key for r in spark.table("admitted").collect()) == [1, 2, 3, 4, 6]


def test_stored_index_scores_alike(spark, tmp_path):
    from lexmill.operators import lexical
    from lexmill.plans import queries

    p, q = queries._passages(spark, DATA), queries._questions(spark, DATA)
    plain = lexical.bm25(lexical.Index(p, heading_weight=3), q)
    kept = lexical.StoredIndex.cached(p, str(tmp_path), heading_weight=3)
    again = lexical.StoredIndex.cached(p, str(tmp_path), heading_weight=3)
    assert kept.path == again.path != lexical.StoredIndex.cached(p, str(tmp_path)).path
    want = sorted(map(tuple, plain.collect()))
    assert len(want) > 50 and sorted(map(tuple, lexical.bm25(again, q).collect())) == want
    again.LITERALS = 3  # larger question batches are joined
    assert sorted(map(tuple, lexical.bm25(again, q).collect())) == want


def test_sweep_covers_the_grid(spark):
    from lexmill.operators import evaluation, lexical
    from lexmill.params import GRID
    from lexmill.plans import queries

    got = {(r.k1, r.b): (r.hit, r.rr, r.ndcg, r.objective) for r in queries.param_sweep(spark, DATA).collect()}
    assert set(got) == {(k1, b) for k1 in GRID["bm25_k1"] for b in GRID["bm25_b"]}
    # a trial of the pass is the trial by itself
    index = lexical.Index(queries._passages(spark, DATA), heading_weight=3)
    hits = lexical.top_k(lexical.bm25(index, queries._questions(spark, DATA), k1=2.0, b=0.9), 12)
    alone = evaluation.means(queries._judge(spark, DATA, hits, 12)).first()
    assert got[2.0, 0.9] == pytest.approx((alone.hit, alone.rr, alone.ndcg, alone.objective))
