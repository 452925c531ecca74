import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions import guard, text
from lexmill.operators import agents, chunking, corpus, dense, evaluation, fusion, metering
from lexmill.params import DEFAULT
from lexmill.sources import files


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"type": "act", "name": "A", "text": "t"}\n\n{"type": "act", "na\n{"type": "bill", "name": "B", "text": "t"}\n{"type": "act", "name": "C", "text": ""}\n')
    rows, skipped = files.json_lines(spark, str(tmp_path / "a.jsonl"), "type string, name string, text string")
    assert rows.count() == 3 and skipped.first().skipped == 1
    assert [r.name for r in files.acts_of(rows).collect()] == ["A"]
    assert files.acts_of(rows, spark.createDataFrame([("Z",)], "name string")).count() == 0


def test_act_gold_and_rewrite_files(spark, tmp_path):
    (tmp_path / "acts").mkdir()
    (tmp_path / "acts/a.json").write_text(json.dumps({"name": "A", "sections": [{"section": "1", "text": "x"}, {"section": "", "text": "y"}]}))
    acts = files.act_files(spark, str(tmp_path / "acts"))
    assert [(r.name, r.section) for r in corpus.exploded(acts).orderBy("pos").collect()] == [("A", "1"), ("A", "")]
    assert [(r.doc_id, r.text) for r in corpus.section_pages(acts).orderBy("unit").collect()] == [("A", "Section 1. x"), ("A", "y")]
    (tmp_path / "gold.json").write_text(json.dumps({"name": "g", "purpose": "p", "batch": [{"id": "1", "query": "q", "relevant": [{"act": "A", "refs": ["S. 1"]}]}]}))
    assert files.gold_file(spark, str(tmp_path / "gold.json")).first().relevant[0].refs == ["S. 1"]
    (tmp_path / "rw.json").write_text(json.dumps({"1": {"queries": ["q", "r"], "terms": ["t"], "clarified": "c"}, "2": {"queries": [], "terms": [], "clarified": ""}}))
    got = {r.qid: r for r in files.rewrite_file(spark, str(tmp_path / "rw.json")).collect()}
    assert got["1"].queries == ["q", "r"] and got["2"].terms == []


def test_document_files(spark, tmp_path):
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body><w:p><w:r><w:t>One </w:t><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(raw.getvalue())
    (tmp_path / "b.TXT").write_bytes("né\n".encode() + b"\xff")
    (tmp_path / "c.exe").write_bytes(b"x")
    (tmp_path / "d.md").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.texts(files.files(spark, str(tmp_path))).collect()}
    assert got == {"a.docx": "One two\n\nthree", "b.TXT": "né\n�"}
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in files.refused(spark, str(tmp_path)).collect()} == {"c.exe": "unknown kind"}


def test_stitched_pieces(spark):
    rows = [("d", 1, 2, "b", True), ("d", 1, 1, "a", False), ("d", 1, 3, "c ", False), ("d", 1, 4, "e", False)]
    assert files.stitched(spark.createDataFrame(rows, "doc_id string, page int, pos int, str string, eol boolean")).first().text == "a b\nc e"


def test_corpus_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"A{i % 3}", "té" * (i + 1)) for i in range(50)], "chunk_no long, title string, text string")
    m = {(r.part, r["name"]): (r.passages, r.chars, r.bytes) for r in files.manifest_rows(rows, 20).collect()}
    assert m["total", None] == (50, 2 * 1275, 3 * 1275) and m["shard", "2"][0] == 10 and m["act", "A0"][0] == 17
    files.write_corpus(rows, str(tmp_path), "2025-01-01", "900/180")
    again, fresh = files.read_corpus(spark, str(tmp_path))
    assert not fresh and sorted(map(tuple, again.select("chunk_no", "title", "text").collect())) == sorted(map(tuple, rows.collect()))
    assert files.read_corpus(spark, str(tmp_path), rows, "2025-01-01")[1]
    assert not files.read_corpus(spark, str(tmp_path), rows, "2024-01-01")[1] and not files.read_corpus(spark, str(tmp_path), rows.limit(3), "2025-01-01")[1]
    files.write_acts(spark.createDataFrame([("An Act, 1950", "x")], "name string, text string"), str(tmp_path / "acts"))
    assert spark.read.json(str(tmp_path / "acts")).first().act == "an-act-1950"


def test_keyed_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, t string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "doc_id int, t string")
    assert sorted(map(tuple, files.upserted(old, new, "doc_id").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    passages = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "chunk_no int, doc_id int")
    docs, left = files.without_documents(old, passages, spark.createDataFrame([(1,)], "doc_id int"))
    assert [r.doc_id for r in docs.collect()] == [2] and [r.chunk_no for r in left.collect()] == [3]


def test_merges(spark):
    local = spark.createDataFrame([("a", 5, 1), ("b", 5, 1)], "chat string, updated int, n int")
    server = spark.createDataFrame([("b", 5, 2), ("c", 1, 2)], "chat string, updated int, n int")
    assert sorted((r.chat, r.n) for r in metering.merged(local, server, "chat").collect()) == [("a", 1), ("b", 2), ("c", 2)]
    newer = spark.createDataFrame([("b", 4, 2), ("c", 1, 2)], "chat string, updated int, n int")
    assert sorted((r.chat, r.n, r.origin) for r in metering.opened(local, newer, "chat", "updated").collect()) == [("a", 1, "local"), ("b", 1, "local"), ("c", 2, "server")]
    assert sorted((r.chat, r.origin) for r in metering.opened(local, server, "chat", "updated").collect())[1] == ("b", "server")
    one = spark.createDataFrame([(3, None)], "p int, c int")
    assert one.select(metering.total_tokens(F.col("p"), F.col("c")).alias("t")).first().t == 3


def test_model_orders(spark):
    hits = spark.createDataFrame([("q", n, n, 1.0 / n) for n in range(1, 6)], "qid string, chunk_no long, rank int, score double")
    order = spark.createDataFrame([("q", p, i) for i, p in enumerate([3, 99, 3, 1, 0])], "qid string, place int, pos int")
    assert [r.chunk_no for r in fusion.apply_order(hits, order).orderBy("rank").collect()] == [3, 1, 2, 4, 5]
    assert [r.chunk_no for r in agents.reranked(hits, order, 3).orderBy("rank").collect()] == [3, 1, 2]
    assert agents.reranked(hits, None, 3).count() == 5
    keep = lambda *p: spark.createDataFrame([("q", x) for x in p], "qid string, place int")
    assert sorted(r.chunk_no for r in agents.graded(hits, keep(2, 4, 4)).collect()) == [2, 4]
    assert agents.graded(hits, keep(77)).count() == 5 and agents.graded(hits.where("rank < 3"), keep(2)).count() == 2


def test_query_lists(spark):
    row = spark.createDataFrame([(["ab", "abc", "abc", " ", "long one", "more"],)], "q array<string>")
    assert row.select(fusion.query_list(F.col("q"), 1).alias("x")).first().x == ["abc", "long one"]
    assert spark.createDataFrame([([" a fact ", "no", "two facts", "3333", "4444", "5555"],)], "f array<string>").select(agents.memory_facts(F.col("f")).alias("x")).first().x == ["a fact", "two facts", "3333", "4444"]


def test_channels_and_collapse(spark):
    a = spark.createDataFrame([("q", 0, 1, 1, 9.0), ("q", 0, 2, 2, 8.0), ("q", 1, 2, 1, 7.0)], "qid string, list_no int, chunk_no long, rank int, score double")
    b = spark.createDataFrame([("q", 0, 3, 1, 0.9)], "qid string, list_no int, chunk_no long, rank int, score double")
    assert {r.chunk_no for r in fusion.channels(a, b, 1.0).collect()} == {1, 2} and {r.chunk_no for r in fusion.channels(a, b, 0.0).collect()} == {3}
    got = {r.chunk_no: r.score for r in fusion.channels(a, b, 0.25).collect()}
    assert got[3] == pytest.approx(0.75 / 61) and got[1] == pytest.approx(0.25 / 61)
    assert fusion.collapse(a, "rrf").count() == 3 and fusion.collapse(a, "best").count() == 2


def test_sweep_and_samples(spark):
    seen = []

    def score(p):
        seen.append(p)
        return 0.5 + 0.1 * (p.top_k == 12) + 0.001 * (p.rrf_k == 10)

    best, steps = evaluation.coordinate_ascent(score, DEFAULT, {"top_k": (4, 8, 12), "rrf_k": (10, 60)})
    assert best.top_k == 12 and best.rrf_k == 60 and steps == [("top_k", 12, pytest.approx(0.6))]
    assert "top_k = 12: 0.6000" in evaluation.report(steps, best, 0.5, 0.6)
    assert evaluation.worth_reranking(0.5, 0.52) and not evaluation.worth_reranking(0.5, 0.505)
    each = spark.createDataFrame([(s, q, h, 1.0 * h, 0.0, 0.0, 0.0, 100, 1) for s, q, h in [(0, "a", 1), (0, "b", 0), (1, "a", 0), (1, "b", 0)]], "sample int, qid string, hit int, rr double, ndcg double, precision double, coverage double, chars long, returned long")
    r = evaluation.over_samples(each).first()
    assert (r.hit, r.hit_spread, r.any_hit) == (0.25, 0.5, 0.5)
    assert evaluation.means(each.withColumn("ms", F.lit(500.0))).first().objective == pytest.approx(evaluation.means(each).first().objective - 0.01)


def test_encoder_helpers(spark):
    got = list(dense.in_batches(iter([["a" * 9, "bb", "c"]]), lambda t: [[len(x), 0] for x in t], size=2, most=4))
    assert got == [[[1.0, 0.0], [1.0, 0.0], [1.0, 0.0]]]
    df = spark.createDataFrame([("a", [1.0]), ("b", None)], "text string, vec array<double>")
    assert sorted(r.vec for r in dense.encode_missing(df, "vec", lambda c: F.array(F.lit(2.0))).collect()) == [[1.0], [2.0]]
    with pytest.raises(ValueError):
        dense.same_encoder(spark.createDataFrame([("a",), ("b",)], "encoder string"))


def test_chunkers(spark):
    long = "Section 1. First rule. " + "words and more words here. " * 60
    assert chunking.windows("x" * 100, 600, 100) == ["x" * 100]
    parts = chunking.windows(long, 600, 100, lossless=True)
    assert all(len(p) <= 600 for p in parts) and all(p in long for p in parts)
    at = [long.index(p) for p in parts]
    assert all(b <= a + len(p) + 1 for a, b, p in zip(at, at[1:], parts))  # nothing is left out between pieces
    blocks = chunking.structure_blocks("Section 1. " + "a" * 130 + "\nSection 2. short\n2. Another one\n")
    assert len(blocks) == 2 and blocks[1].startswith("Section 2.")


def test_acts_are_repaired(spark):
    body = "The rent shall be paid in time and no more than that. "
    joined = f"{body} 6. Return of deposit.-— The deposit shall be returned."
    acts = spark.createDataFrame([("A", [("5", joined), ("7", "x"), ("8", body), ("8", body + body)])], "name string, sections array<struct<section:string,text:string>>")
    rows = corpus.ordered(corpus.longest(corpus.repaired(corpus.exploded(acts)))).orderBy("place").collect()
    assert [r.section for r in rows][:2] == ["5", "6"] and [len(r.text) for r in rows if r.section == "8"] == [len((body + body).strip())]
    assert corpus.recovered(corpus.exploded(acts), spark.createDataFrame([("A",)], "name string")).first().recovered == -3


def test_text_labels(spark):
    row = lambda v, f: spark.createDataFrame([(v,)], "t string").select(f(F.col("t")).alias("x")).first().x
    assert row("The Act, 1950 (X)", text.slug) == "the-act-1950-x-" or row("The Act, 1950 (X)", text.slug) == "the-act-1950-x"
    assert row(" Ab.C!d_ ", text.user_name) == "abcd_" and row("a", text.user_name) is None
    assert row("x" * 60, text.chat_title) == "x" * 52 + "..." and row("  ", text.chat_title) == "New chat"
    assert row("Lease.v2.pdf", text.file_title) == "Lease.v2" and row("Rent Act, 1999", text.act_display) == "Rent Act"
    assert row("12A", text.leading_int) == 12 and row("A", text.leading_int) is None
    assert row("1[Short title.— This", text.looks_like_section) and not row("short", text.looks_like_section)
    assert row('{"k": 1', text.salvaged_json) is None and row('x {"k": {"a": 1}} y', text.salvaged_json) == '{"k": {"a": 1}}'
    assert len(row("x" * 500_000, text.capped)) == 400_000


def test_prompts_and_gates(spark):
    df = spark.createDataFrame([("q", "", None, "ctx")], "question string, history string, memory string, context string")
    got = df.select(agents.prompt_blocks([("M", F.col("memory")), ("H", F.col("history")), ("C", F.col("context")), ("Q", F.col("question"))]).alias("p")).first().p
    assert got == "C:\nctx\n\nQ:\nq"
    one = spark.createDataFrame([("x" * 130, 40.0, [])], "t string, f double, j array<string>")
    assert one.select(guard.wants_simpler(F.col("t"), F.col("f"), F.col("j")).alias("x")).first().x
    assert not one.select(guard.wants_simpler(F.left("t", F.lit(100)), F.col("f"), F.col("j")).alias("x")).first().x
    keeps = lambda new, after: one.select(guard.keeps_simpler(F.col("t"), F.lit(new), F.col("f"), F.lit(after)).alias("x")).first().x
    assert keeps("y" * 70, 44.0) and not keeps("y" * 60, 44.0) and not keeps("y" * 70, 43.0) and not keeps("", 90.0)


def test_hashed_vectors_are_unit(spark):
    v = dense.hashed_sparse(spark.createDataFrame([(1, "rent deposit rent"), (2, None), (3, "")], "k int, t string"), "t", "k").collect()
    assert {r.k for r in v} == {1} and np.isclose(sum(r.value**2 for r in v), 1)
