"""DuckDB SQL of the queries around retrieval, and of core queries that lacked it."""

from __future__ import annotations

from lexmill.plans import sql as s

_FNV = "list_reduce(list_prepend(CAST({seed} AS BIGINT), list_transform(range(1, length(g) + 1), lambda i: CAST(ascii(substring(g, CAST(i AS INT), 1)) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


def _sparse(name: str, table: str, expr: str, key: str) -> str:
    """CTEs up to name(key, idx, value): unit vectors of hashed words and word pairs."""
    n = name
    raw = s._raw(expr)
    stem = s._stem("w")
    return f"""{n}_t AS (SELECT {key}, pos, {stem} AS term FROM (SELECT {key}, unnest(raw) AS w, generate_subscripts(raw, 1) AS pos FROM (SELECT {key}, {raw} AS raw FROM {table})) WHERE length(w) >= 2 AND w NOT IN ({s._STOP})),
    {n}_p AS (SELECT {key}, term, lead(term) OVER (PARTITION BY {key} ORDER BY pos) AS nxt FROM {n}_t),
    {n}_c AS (SELECT {key}, g, sum(w) AS n FROM (SELECT {key}, term AS g, CAST(1.0 AS DOUBLE) AS w FROM {n}_p UNION ALL SELECT {key}, term || '_' || nxt, CAST(0.6 AS DOUBLE) FROM {n}_p WHERE nxt IS NOT NULL) GROUP BY 1, 2),
    {n}_h AS (SELECT gram, {_FNV.format(seed=2166136261)} % 512 AS idx, {_FNV.format(seed=5381)} & 1 AS sign FROM (SELECT gram, regexp_replace(gram, '[^\\x00-\\x7f]', '?', 'g') AS g FROM (SELECT DISTINCT g AS gram FROM {n}_c))),
    {n}_v AS (SELECT {key}, idx, sum(CASE WHEN sign = 1 THEN 1.0 ELSE -1.0 END * (1 + ln(n))) AS v FROM {n}_c JOIN {n}_h ON g = gram GROUP BY 1, 2),
    {n} AS (SELECT {key}, idx, v / CASE WHEN norm = 0 THEN 1 ELSE norm END AS value FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY {key})) AS norm FROM {n}_v))"""


def _dense(k: int) -> str:
    return f"{_sparse('cv', 'chunks', 'text', 'chunk_no')}, {_sparse('qv', '(SELECT id AS qid, query FROM goldset)', 'query', 'qid')}, dots AS (SELECT qid, chunk_no, round(sum(cv.value * qv.value), 6) AS score FROM cv JOIN qv USING (idx) GROUP BY 1, 2), dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_no) AS rank FROM dots) WHERE rank <= {k})"


def _readable(table: str) -> str:
    """CTEs up to rd(doc_id, flesch) of a table with doc_id and text."""
    whole = s.oracle_sql()["readability_scores"].replace("FROM documents WHERE", f"FROM {table} WHERE")
    return f"(SELECT doc_id AS msg_no, flesch FROM ({whole}))"


_ANSWERS = f"(SELECT msg_no AS doc_id, content AS text FROM {s._LATEST} WHERE role = 'assistant' AND content IS NOT NULL)"


# The SQL's own rules: weight, label, pattern.
_RISKS = (
    (3, "money can be kept", r"(?i)\b(forfeit|forfeited|retain\s+the\s+entire|confiscate)\b"), (3, "no warning needed", r"(?i)\bwithout\s+(any\s+)?(prior\s+)?notice\b"), (3, "one-sided decision power", r"(?i)\b(sole|absolute)\s+discretion\b"),
    (3, "you pay for their losses", r"(?i)\b(indemnify|indemnification|hold\s+harmless)\b"), (4, "no cap on what you owe", r"(?i)\b(unlimited\s+liability|liable\s+for\s+all)\b"), (3, "you give up a right", r"(?i)\b(waive|waiver)\b[^.]{0,40}\b(right|claim|notice)\b"),
    (2, "money is not coming back", r"(?i)\b(no\s+refund(s|able)?|non-?refundable)\b"), (2, "fixed penalty", r"(?i)\b(liquidated\s+damages|penalt(y|ies))\b"), (3, "lasts forever", r"(?i)\b(in\s+perpetuity|never\s+expires?)\b"),
    (2, "limits your next job", r"(?i)\b(non-?compete|non-?solicit(ation)?)\b"), (2, "you must go to their city to fight", r"\b(exclusive\s+jurisdiction|courts?\s+(at|of|in)\s+[A-Z][a-z]+\s+(alone|only))"), (2, "no court, no appeal", r"(?i)\b(binding\s+arbitration|final\s+and\s+binding)\b"),
    (2, "renews by itself", r"(?i)\bautomatic(ally)?\s+renew(al|ed|s)?\b"), (3, "they can walk away anytime", r"(?i)\bterminate\b[^.]{0,50}\bfor\s+convenience\b"), (2, "transfer restrictions", r"(?i)\b(sub-?let|assign)\b[^.]{0,40}\bwithout\b[^.]{0,20}\bconsent\b"),
    (3, "high interest rate", r"(?i)\binterest\s+@?\s*[0-9]{2,}\s*%"), (2, "you are locked in", r"(?i)\block-?in\s+period\b"), (1, "large deposit", r"(?i)\bsecurity\s+deposit\b[^.]{0,80}\b(months?|times)\b"),
)


def _risks() -> str:
    """CTEs up to risks(doc_id, pos, clause, score, severity, reasons)."""
    w = s._WS2
    cut = rf"regexp_replace(regexp_replace(regexp_replace(text, '(\n{w}*[0-9]+(\.[0-9]+)*{w})', chr(31) || '\1', 'g'), '\n{{2,}}', chr(31), 'g'), '([.;]){w}+([A-Z(])', '\1' || chr(31) || '\2', 'g')"
    base = " + ".join(f"CASE WHEN regexp_matches(clause, '{s.re2(p)}') THEN {n} ELSE 0 END" for n, _, p in _RISKS)
    why = ", ".join(f"CASE WHEN regexp_matches(clause, '{s.re2(p)}') THEN '{label}' END" for _, label, p in _RISKS)
    amount = s.re2(r"(?i)(₹|rs\.?|inr)\s?[0-9,]{4,}")
    return f"""parts AS (SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS pos FROM (SELECT doc_id, string_split({cut}, chr(31)) AS p FROM documents WHERE text IS NOT NULL)),
        cl AS (SELECT doc_id, pos, trim(regexp_replace(part, '{w}+', ' ', 'g')) AS clause FROM parts), sc AS (SELECT *, {base} AS base FROM cl WHERE length(clause) > 30 AND length(clause) < 1200),
        st AS (SELECT doc_id, pos, clause, base + CASE WHEN regexp_matches(clause, '{amount}') THEN 1 ELSE 0 END AS score, concat_ws('|', {why}) AS reasons FROM sc WHERE base > 0),
        risks AS (SELECT *, CASE WHEN score >= 6 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS severity FROM st)"""


def oracle_sql() -> dict[str, str]:
    masked, found = s._masked()
    trim = s._TRIM % "coalesce(content, '')"
    core = s.oracle_sql()
    jargon = core["jargon_flags"].replace("FROM documents", f"FROM {_ANSWERS}")
    plain = f"(SELECT doc_id, {s._plain()} AS text FROM {_ANSWERS})"
    verdict = core["input_verdict"].split("SELECT msg_no, ")[1].split(" AS category")[0]
    eval_m = core["eval_metrics"]
    one = lambda sample: eval_m.replace(s._GOLD, f"SELECT split_part(qid, '/', 1) AS qid, query FROM ({s._HALVES}) WHERE qid LIKE '%/{sample}'")
    chars = lambda sample: (one(sample).split(", r AS (SELECT id AS qid")[0] + " SELECT qid, sum(length(text)) AS chars FROM hits JOIN chunks USING (chunk_no) GROUP BY 1")
    means = "avg(hit) AS hit, avg(rr) AS rr, avg(ndcg) AS ndcg, avg(coverage) AS coverage, 0.6 * avg(hit) + 0.4 * avg(rr) - 0.08 * avg(coalesce(chars, 0)) / 24000 AS objective"
    return {
        "lexical_index": " UNION ALL ".join(f"SELECT * FROM (WITH {s._bm25(s._GOLD, hw)} SELECT CAST({hw} AS BIGINT) AS heading_weight, count(*) AS docs, CAST(sum(len) AS BIGINT) AS terms, max(len) AS longest FROM lens)" for hw in (1, 3)),
        "dense_topk": f"WITH {_dense(10)} SELECT qid, chunk_no, rank, round(score, 4) AS score FROM dn",
        "hybrid_topk": f"{s._top(20)}, {_dense(20)}, rrf AS (SELECT qid, chunk_no, round(sum(0.5 / (60 + rank)), 9) AS score FROM (SELECT qid, chunk_no, rank FROM hits UNION ALL SELECT qid, chunk_no, rank FROM dn) GROUP BY 1, 2)" + s._rank10("rrf", "score DESC, chunk_no"),
        "hashed_vectors": f"WITH {_sparse('dv', 'documents', 'text', 'doc_id')} SELECT doc_id, count(*) AS cells, round(max(value), 5) AS top, round(sum(value * value), 5) AS norm FROM dv GROUP BY 1",
        "rewrite_expansion": f"""WITH h AS ({s._HALVES}), a AS (SELECT split_part(qid, '/', 1) AS qid, CAST(split_part(qid, '/', 2) AS BIGINT) AS n, query FROM h),
            rw AS (SELECT x.qid, y.query AS half FROM a x JOIN a y ON x.qid = y.qid AND x.n = 0 AND y.n = 1 WHERE contains(x.query, 'the')),
            topic AS ({s._terms("(SELECT qid, query || ' security deposit' AS query FROM a WHERE n = 0)", 'query', 'qid')}), ht AS ({s._terms('rw', 'half', 'qid')}),
            kept AS (SELECT qid, half FROM rw WHERE trim(half) <> '' AND EXISTS (SELECT 1 FROM ht JOIN topic USING (qid, term) WHERE ht.qid = rw.qid))
            SELECT qid, CAST(0 AS BIGINT) AS list_no, query FROM a WHERE n = 0 UNION ALL SELECT qid, 1, half FROM kept UNION ALL SELECT qid, CASE WHEN qid IN (SELECT qid FROM kept) THEN 2 ELSE 1 END, 'security deposit' FROM rw""",
        "reranked_hits": s._top(12) + """, o AS (SELECT qid, chunk_no, hits.rank, row_number() OVER (PARTITION BY qid ORDER BY length(text) DESC, hits.rank) AS pos FROM hits JOIN chunks USING (chunk_no) WHERE hits.rank <= 6)
            SELECT qid, chunk_no, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN pos <= 4 THEN pos ELSE 1000000 + rank END, rank) AS rank FROM o""",
        "graded_hits": s._top(8) + """, g AS (SELECT qid, chunk_no, hits.rank, source <> 'user' AND ref IS NOT NULL AS ok FROM hits JOIN chunks USING (chunk_no)), n AS (SELECT qid, count(*) AS n, count(*) FILTER (ok) AS k FROM g GROUP BY 1)
            SELECT qid, chunk_no, rank FROM g JOIN n USING (qid) WHERE n < 3 OR k = 0 OR ok""",
        "retrieval_stats": s._LISTS + s._RRF + """, fl AS (SELECT qid, chunk_no, score FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS best FROM rrf) WHERE score >= best * 0.45),
            rt AS (SELECT qid, length(text) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_no) AS n FROM fl) JOIN chunks USING (chunk_no) WHERE n <= 8)
            SELECT id AS qid, (SELECT count(*) FROM chunks) AS indexed, (SELECT count(DISTINCT chunk_no) FROM lists WHERE qid = id) AS lexical, CAST(0 AS BIGINT) AS dense, (SELECT count(*) FROM rrf WHERE qid = id) AS fused,
              (SELECT count(*) FROM fl WHERE qid = id) AS after_floor, (SELECT count(*) FROM rt WHERE qid = id) AS returned, (SELECT CAST(coalesce(sum(chars), 0) AS BIGINT) FROM rt WHERE qid = id) AS chars FROM goldset""",
        "quick_routes": f"""WITH r AS (SELECT msg_no, lower({trim}) AS t, intent AS said, coalesce(needs_retrieval, false) AS docs, language, reason FROM {s._LATEST} JOIN route_results USING (msg_no) WHERE role = 'user'),
            k AS (SELECT *, length(t) <= 24 AND regexp_matches(t, '^(hi|hey|hello|namaste|yo|thanks|thank you|ok|okay|bye|good (morning|evening))\\b') AS hello, docs AND regexp_matches(t, '\\b(risk|risky|unfair|trap|catch|danger|problem|red flag)\\b') AS risky,
              coalesce(said IN ('law_question', 'doc_question', 'risk_scan', 'summarise', 'followup', 'smalltalk', 'out_of_scope'), false) AS valid FROM r)
            SELECT msg_no, CASE WHEN hello THEN 'smalltalk' WHEN risky THEN 'risk_scan' WHEN valid THEN said WHEN docs THEN 'doc_question' ELSE 'law_question' END AS intent,
              CASE WHEN hello THEN false WHEN risky THEN true WHEN valid THEN said NOT IN ('smalltalk', 'out_of_scope') ELSE true END AS needs_retrieval,
              CASE WHEN NOT hello AND NOT risky AND valid AND coalesce(language, '') <> '' THEN language ELSE 'en' END AS route_language,
              CASE WHEN hello THEN 'greeting' WHEN risky THEN 'risk keywords' WHEN valid THEN coalesce(reason, '') ELSE 'fallback' END AS route_reason FROM k""",
        "full_verdicts": f"""WITH v AS (SELECT msg_no, received_at, {verdict} AS category, {trim} AS content FROM messages WHERE role = 'user'), m AS (SELECT *, {masked} AS masked, {found} AS found FROM v)
            SELECT msg_no, received_at, category = 'ok' AS ok, category, md5(CASE WHEN category = 'ok' THEN masked ELSE content END) AS sanitised, CASE WHEN category = 'ok' THEN found ELSE '' END AS redactions,
              CASE WHEN category = 'ok' AND found <> '' THEN 'Personal details (' || replace(found, ',', ', ') || ') were masked before processing.' ELSE '' END AS notices FROM m""",
        "readability_gate": f"""WITH a AS (SELECT doc_id AS msg_no, text FROM {_ANSWERS}), f AS (SELECT * FROM {_readable(_ANSWERS)}), j AS (SELECT doc_id AS msg_no, jargon FROM ({jargon})), p AS (SELECT doc_id AS msg_no, text AS plain FROM {plain}), pf AS (SELECT msg_no, flesch AS after FROM {_readable(plain)}),
            h AS (SELECT msg_no, flesch, (flesch < 45 OR jargon <> '') AND length(text) > 120 AND length(text) < 9000 AS hard, plain <> '' AND after > flesch + 3 AND length(plain) > length(text) * 0.5 AS better FROM a JOIN f USING (msg_no) JOIN j USING (msg_no) JOIN p USING (msg_no) JOIN pf USING (msg_no))
            SELECT msg_no, flesch, hard, hard AND better AS taken FROM h""",
        "run_summary": f"""WITH r AS (SELECT msg_no, flesch, content, epoch_us(received_at) - epoch_us(created_at) AS us FROM {s._LATEST} JOIN {_readable(_ANSWERS)} USING (msg_no)), o AS (SELECT flesch, row_number() OVER (ORDER BY flesch) AS n, count(*) OVER () AS c FROM r)
            SELECT count(*) AS answered, CAST(0 AS BIGINT) AS blocked, count(*) FILTER (content = '') AS failed, CAST(floor(avg(us / 1000.0) + 0.5) AS BIGINT) AS mean_ms, count(*) FILTER (regexp_matches(content, '[–—]')) AS dashes, (SELECT max(flesch) FROM o WHERE n = c // 2 + 1) AS median FROM r""",
        "chat_store": f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY turn DESC, msg_no) AS back FROM {s._LATEST}), u AS (SELECT user_id, chat_id, max(created_at) AS at_ FROM m GROUP BY 1, 2),
            k AS (SELECT * FROM (SELECT user_id, chat_id, row_number() OVER (PARTITION BY user_id ORDER BY at_ DESC, chat_id) AS rank FROM u) WHERE rank <= 40)
            SELECT k.user_id, k.chat_id, any_value(k.rank) AS rank, count(*) AS kept, md5(string_agg(m.role || ':' || coalesce(m.content, ''), chr(10) ORDER BY m.turn, m.msg_no)) AS history FROM k JOIN m ON k.user_id = m.user_id AND k.chat_id = m.chat_id WHERE m.back <= 60 GROUP BY 1, 2""",
        "open_chats": f"""WITH l AS (SELECT chat_id, max(created_at) AS u, count(*) AS n FROM {s._LATEST} WHERE turn <= 4 GROUP BY 1), v AS (SELECT chat_id, max(created_at) AS u, count(*) AS n FROM {s._LATEST} WHERE role = 'assistant' GROUP BY 1)
            SELECT chat_id, CASE WHEN srv THEN vu ELSE lu END AS updated, CASE WHEN srv THEN vn ELSE ln END AS messages, CASE WHEN srv THEN 'server' ELSE 'local' END AS origin
            FROM (SELECT chat_id, l.u AS lu, l.n AS ln, v.u AS vu, v.n AS vn, v.n IS NOT NULL AND (l.n IS NULL OR coalesce(v.u >= l.u, true)) AS srv FROM l FULL JOIN v USING (chat_id))""",
        "prompt_texts": f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY chat_id, role ORDER BY turn DESC, msg_no) AS k FROM {s._LATEST}), a AS (SELECT chat_id, content AS question FROM m WHERE role = 'user' AND k = 1), h AS (SELECT chat_id, content AS history FROM m WHERE role = 'assistant' AND k = 1)
            SELECT chat_id, md5(concat_ws(chr(10) || chr(10), 'Earlier:' || chr(10) || nullif(history, ''), 'Question:' || chr(10) || nullif(question, ''))) AS prompt FROM a LEFT JOIN h USING (chat_id)""",
        "manifest_rows": """WITH c AS (SELECT title, text, CAST((row_number() OVER (ORDER BY chunk_no) - 1) // 900 AS VARCHAR) AS shard FROM chunks)
            SELECT 'act' AS part, title AS name, count(*) AS passages, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes FROM c GROUP BY title
            UNION ALL SELECT 'shard', shard, count(*), CAST(coalesce(sum(length(text)), 0) AS BIGINT), CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) FROM c GROUP BY shard
            UNION ALL SELECT 'total', NULL, count(*), CAST(coalesce(sum(length(text)), 0) AS BIGINT), CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) FROM c""",
        "usage_resets": """WITH l AS (SELECT strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d') AS day, max(ts) AS at_ FROM events GROUP BY 1), r AS (SELECT day, at_, CAST(CAST(at_ + INTERVAL 330 MINUTE AS DATE) + 1 AS TIMESTAMP) - INTERVAL 330 MINUTE AS reset_at FROM l),
            h AS (SELECT day, reset_at, CAST(greatest(1, floor((epoch_us(reset_at) // 1000000 - epoch_us(at_) // 1000000) / 3600 + 0.5)) AS INT) AS n FROM r)
            SELECT day, reset_at, 'Your allowance is used up; it returns in about ' || n || CASE WHEN n = 1 THEN ' hour.' ELSE ' hours.' END AS message FROM h""",
        "text_marks": """WITH m AS (SELECT DISTINCT doc_id, name, created_at FROM doc_meta), a AS (SELECT *, epoch_us(TIMESTAMP '2025-06-01') // 1000000 - epoch_us(created_at) // 1000000 AS sec FROM m)
            SELECT doc_id, coalesce(name, '') AS name, regexp_replace(name, '\\.[^.]+$', '') AS title, trim(regexp_replace(' ' || name || '  x', '\\s+', ' ', 'g')) AS flat, CASE WHEN 2 * length(name) > 20 THEN 20 ELSE 2 * length(name) END AS capped,
              TRY_CAST(nullif(regexp_extract(regexp_extract(name, '([0-9]+[^0-9]*)$', 1), '^([0-9]+)', 1), '') AS BIGINT) AS number, left(regexp_replace(name || '#é_1', '[^A-Za-z0-9_-]', '', 'g'), 40) AS device,
              CASE WHEN sec < 60 THEN 'now' WHEN sec < 3600 THEN (sec // 60) || 'm' WHEN sec < 86400 THEN (sec // 3600) || 'h' WHEN sec < 604800 THEN (sec // 86400) || 'd' ELSE strftime(created_at, '%Y-%m-%d') END AS age FROM a""",
        "source_overview": s._top(6) + " SELECT qid, count(*) FILTER (source = 'user') AS own, count(*) FILTER (source <> 'user') AS law FROM hits JOIN chunks USING (chunk_no) GROUP BY 1",
        "rewrite_samples": f"""WITH e AS (SELECT 0 AS sample, * FROM ({one(0)}) LEFT JOIN ({chars(0)}) USING (qid) UNION ALL SELECT 1, * FROM ({one(1)}) LEFT JOIN ({chars(1)}) USING (qid)), m AS (SELECT sample, {means} FROM e GROUP BY 1), a AS (SELECT avg(h) AS any_hit FROM (SELECT qid, max(hit) AS h FROM e GROUP BY 1))
            SELECT round(avg(hit), 6) AS hit, round(avg(rr), 6) AS rr, round(avg(ndcg), 6) AS ndcg, round(avg(coverage), 6) AS coverage, round(avg(objective), 6) AS objective, round(max(hit) - min(hit), 6) AS hit_spread, any_value(round(any_hit, 6)) AS any_hit FROM m, a""",
        # core queries
        "risk_clauses": f"WITH {_risks()} SELECT severity, count(*) AS clauses, CAST(sum(score) AS BIGINT) AS score, count(DISTINCT doc_id) AS docs FROM risks GROUP BY 1",
        "risk_findings": f"""WITH {_risks()}, rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, pos) AS rank FROM risks)
            SELECT doc_id, rank, severity, CAST(score AS BIGINT) AS score, CASE WHEN length(clause) > 420 THEN left(clause, 420) || '...' ELSE clause END AS clause, reasons FROM rk WHERE rank <= 12""",
        "quantize_loss": """WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) AS m FROM embeddings), z AS (SELECT vec_id, v, list_transform(v, lambda x: floor(x / CASE WHEN m = 0 THEN 1 ELSE m END * 127 + 0.5)) AS q FROM q),
            n AS (SELECT vec_id, list_sum(list_transform(list_zip(v, q), lambda p: p[1] * p[2])) AS vq, list_sum(list_transform(v, lambda x: x * x)) AS vv, list_sum(list_transform(q, lambda x: x * x)) AS qq FROM z)
            SELECT vec_id, round(vq / CASE WHEN sqrt(vv * qq) = 0 THEN 1 ELSE sqrt(vv * qq) END, 4) AS cosine FROM n""",
        "contexts": s._top(8) + """, l AS (SELECT qid, hits.rank, '[' || hits.rank || '] (' || CASE WHEN source = 'user' THEN 'YOUR DOCUMENT' ELSE 'LAW' END || ') ' || concat_ws(' - ', title, ref, 'p.' || page) AS label, text FROM hits JOIN chunks USING (chunk_no)),
            u AS (SELECT *, sum(length(label) + 1 + length(text)) OVER (PARTITION BY qid ORDER BY rank) AS used FROM l) SELECT qid, string_agg(concat_ws(chr(10), label, text), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM u WHERE used <= 24000 OR rank = 1 GROUP BY 1""",
        "rewrite_guard": f"""WITH h AS ({s._HALVES}), t AS ({s._terms('h', 'query', 'qid')}), g AS ({s._terms('(SELECT id AS qid, query FROM goldset)', 'query', 'qid')}), a AS (SELECT DISTINCT split_part(qid, '/', 1) AS qid, CAST(split_part(qid, '/', 2) AS INT) AS list_no, term FROM t)
            SELECT DISTINCT a.qid, list_no FROM a JOIN g ON a.qid = g.qid AND a.term = g.term""",
        "memory_merge": f"""WITH m AS (SELECT user_id AS "user", content AS text, created_at, turn FROM {s._LATEST} WHERE role = 'user'), st AS (SELECT "user", text, created_at FROM m WHERE turn = 1), f AS (SELECT "user", trim(text, ' ') AS text, created_at FROM m WHERE turn > 1),
            n AS (SELECT * FROM f WHERE length(text) BETWEEN 4 AND 239 AND NOT EXISTS (SELECT 1 FROM st WHERE st."user" = f."user" AND lower(st.text) = lower(f.text))), u AS (SELECT * FROM st UNION ALL SELECT * FROM n)
            SELECT "user", least(count(*), 20) AS facts FROM u GROUP BY 1""",
        "eval_summary": f"WITH e AS (SELECT * FROM ({eval_m}) LEFT JOIN ({s._top(12, 3)} SELECT qid, sum(length(text)) AS chars FROM hits JOIN chunks USING (chunk_no) GROUP BY 1) USING (qid)) SELECT round(avg(hit), 5) AS hit, round(avg(rr), 5) AS rr, round(avg(ndcg), 5) AS ndcg, round(avg(precision), 5) AS precision, round(avg(coverage), 5) AS coverage, round(avg(coalesce(chars, 0)), 5) AS chars, round(avg(returned), 5) AS returned, round(0.6 * avg(hit) + 0.4 * avg(rr) - 0.08 * avg(coalesce(chars, 0)) / 24000, 5) AS objective FROM e",
        "text_labels": f"""SELECT name, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, regexp_replace(name, ',?\\s*[0-9]{{4}}$', '') AS display,
            CASE WHEN length(t) = 0 THEN 'New chat' WHEN length(t) > 52 THEN left(t, 52) || '...' ELSE t END AS title, CASE WHEN length(u) >= 2 THEN u END AS "user" FROM (SELECT name, trim(regexp_replace(name || '  ' || name, '\\s+', ' ', 'g')) AS t, left(regexp_replace(lower({s._TRIM % 'name'}), '[^a-z0-9_-]', '', 'g'), 32) AS u FROM acts)""",
    }
