"""DuckDB SQL of the core queries."""

from __future__ import annotations

from lexmill.functions.risk import KEYWORDS
from lexmill.functions.text import FILLERS, STOP_WORDS, SUFFIXES

_WS2 = r"[\t\n\x0b\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def re2(pattern: str) -> str:
    """A pattern in this dialect (its boundaries are ASCII, its white space isn't all), quoted for SQL."""
    return pattern.replace(r"\s", _WS2).replace("'", "''")


# The SQL's own fixed values; nothing here is taken from the columns it checks.
_PERSONAL = (("Aadhaar", r"\b[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}\b", "[AADHAAR]"), ("PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", "[PAN]"), ("phone", r"\b(\+91[ -]?)?[6-9][0-9]{9}\b", "[PHONE]"), ("email", r"\b[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]{2,}\b", "[EMAIL]"), ("account", r"\b[0-9]{11,18}\b", "[ACCOUNT]"))
_CRISIS = r"\b(kill|hurt|harm)\s+my\s*self\b|\bsuicid(e|al)\b|\bend\s+my\s+life\b|\bi\s+(want|am\s+going)\s+to\s+die\b"
_INJECTION = r"ignore\s+(all\s+)?(the\s+)?(previous|prior|above)\s+instruction|disregard\s+(your|the)\s+(system\s+)?(prompt|instruction|rule)|(reveal|print|show|repeat)\s+(your|the)\s+(system\s+)?prompt|you\s+are\s+now\s+(a|an|in)\s+(developer|dan|jailbreak|god)\s*mode|pretend\s+(you\s+)?(are|to\s+be)\s+(not\s+)?(an?\s+)?(ai|assistant|lawyer)\b.*\b(no\s+rules|without\s+restrictions)|\bsystem\s*:\s*you\s+must\b"
_HARMFUL = r"\b(forge|fabricate|falsify|backdate)\b[^.?!]{0,40}\b(signature|document|affidavit|stamp|evidence|receipt|will)\b|\bhow\s+(do\s+i|to)\b[^.?!]{0,40}\b(bribe|pay\s+off)\b[^.?!]{0,30}\b(judge|officer|official|police|clerk)\b|\b(destroy|shred|delete|hide)\b[^.?!]{0,30}\b(evidence|records?)\b[^.?!]{0,30}\b(before|from)\b[^.?!]{0,30}\b(court|police|audit|investigat)|\blaunder(ing)?\b[^.?!]{0,25}\bmoney\b|\bhelp\s+me\b[^.?!]{0,30}\b(evade|dodge)\b[^.?!]{0,20}\b(tax|taxes|summons|arrest)\b|\b(threaten|intimidate)\b[^.?!]{0,30}\b(witness|tenant|complainant)\b"
_CLAIMS = ((r"\byou\s+will\s+(definitely\s+)?win\b", "you may have a case"), (r"\byou\s+are\s+guaranteed\b", "you may be entitled"), (r"\bthis\s+is\s+100%\s+(legal|illegal)\b", "this appears to be"), (r"\bi\s+guarantee\b", "based on the text"), (r"\byou\s+should\s+sue\b", "one option is to take legal action"))
_TERMS = "hereinafter,heretofore,thereof,therein,hereby,whereas,aforesaid,notwithstanding,indemnify,indemnification,estoppel,force majeure,lien,covenant,sine die,prima facie,ultra vires,ex parte,mutatis mutandis,inter alia,pursuant to,liquidated damages,subrogation,novation,arbitration,jurisdiction,injunction".split(",")


def _stem(w: str) -> str:
    whens = " ".join(f"WHEN {w} LIKE '%{s}' AND length({w}) >= {len(s) + 4} THEN left({w}, length({w}) - {len(s)}) || '{'y' if s == 'ies' else ''}'" for s in SUFFIXES)
    return f"CASE WHEN length({w}) <= 4 THEN {w} {whens} ELSE {w} END"


def _raw(expr: str) -> str:
    s = f"lower({expr})"
    for pattern, new in ((rf"\bsec(?:tion)?s?\.?{_WS2}*([0-9]+[a-z]*)", r" section\1 "), (rf"\bart(?:icle)?s?\.?{_WS2}*([0-9]+[a-z]*)", r" article\1 "), (rf"\bcl(?:ause)?\.?{_WS2}*([0-9]+(?:\.[0-9]+)*)", r" clause\1 ")):
        s = f"regexp_replace({s}, '{pattern}', '{new}', 'g')"
    return f"regexp_extract_all({s}, '[a-z0-9$₹]+')"


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS + FILLERS)


def _terms(table: str, expr: str, key: str) -> str:
    return f"SELECT {key}, {_stem('w')} AS term FROM (SELECT {key}, unnest({_raw(expr)}) AS w FROM {table}) WHERE length(w) >= 2 AND w NOT IN ({_STOP})"


def _bm25(questions: str, hw: int = 1, k1: float = 1.2, b: float = 0.75) -> str:
    """CTEs up to scored(qid, chunk_no, score)."""
    heads = "".join(f" UNION ALL ({_terms('(SELECT * FROM chunks WHERE heading IS NOT NULL)', 'heading', 'chunk_no')})" for _ in range(hw - 1))
    body = "concat_ws(' ', title, ref, text)"
    return f"""
    questions AS ({questions}),
    terms AS ({_terms('chunks', body, 'chunk_no')}{heads}),
    lens AS (SELECT c.chunk_no, coalesce(n, 0) AS len FROM chunks c LEFT JOIN (SELECT chunk_no, count(*) AS n FROM terms GROUP BY 1) USING (chunk_no)),
    totals AS (SELECT count(*) AS docs, avg(len) AS mean FROM lens),
    asked AS (SELECT DISTINCT qid, term FROM ({_terms('questions', 'query', 'qid')})),
    post AS (SELECT term, chunk_no, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
    dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
    scored AS (SELECT qid, chunk_no, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * len / mean))), 6) AS score
      FROM asked JOIN post USING (term) JOIN dfs USING (term) JOIN lens USING (chunk_no) CROSS JOIN totals GROUP BY 1, 2)"""


_GOLD = "SELECT id AS qid, query FROM goldset"
_HALVES = """SELECT id || '/0' AS qid, query FROM goldset UNION ALL
  SELECT id || '/1', array_to_string(list_slice(string_split(query, ' '), len(string_split(query, ' ')) // 2 + 1, len(string_split(query, ' '))), ' ') FROM goldset"""


def _top(k: int, hw: int = 1) -> str:
    return f"WITH {_bm25(_GOLD, hw)}, hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_no) AS rank FROM scored) WHERE rank <= {k})"


_LISTS = f"""WITH {_bm25(_HALVES)}, lists AS (SELECT split_part(qid, '/', 1) AS qid, CAST(split_part(qid, '/', 2) AS INT) AS list_no, chunk_no, score, rank
  FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_no) AS rank FROM scored) WHERE rank <= 20)"""
_RRF = ", rrf AS (SELECT qid, chunk_no, round(sum(1.0 / (60 + rank)), 9) AS score FROM lists GROUP BY 1, 2)"
_TRIM = f"regexp_replace(%s, '^{_WS2}+|{_WS2}+$', '', 'g')"
_LATEST = "(SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY msg_no ORDER BY received_at) AS n FROM messages) WHERE n = 1)"


def _rank10(source: str, order: str) -> str:
    return f" SELECT qid, chunk_no, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}) AS rank FROM {source}) WHERE rank <= 10"


def _masked() -> tuple[str, str]:
    s, found = "content", []
    for label, pattern, mark in _PERSONAL:
        found.append(f"CASE WHEN regexp_matches({s}, '{re2(pattern)}') THEN '{label}' END")
        s = f"regexp_replace({s}, '{re2(pattern)}', '{mark}', 'g')"
    return s, "concat_ws(',', " + ", ".join(found) + ")"


def _any(pattern: str, text: str = "content") -> str:
    return f"regexp_matches({text}, '(?i){re2(pattern)}')"


def _softened(s: str) -> str:
    for pattern, new in ((f"{_WS2}*—{_WS2}*", ", "), (rf"([A-Za-z0-9_]){_WS2}*–{_WS2}*([A-Za-z0-9_])", r"\1 to \2"), (f"{_WS2}*–{_WS2}*", ", "), (f",{_WS2}*,", ","), (rf",{_WS2}*\.", ".")):
        s = f"regexp_replace({s}, '{pattern}', '{new}', 'g')"
    for pattern, new in _CLAIMS:
        s = f"regexp_replace({s}, '(?i){re2(pattern)}', '{new}', 'g')"
    return s


def _plain() -> str:
    s = "left(text, 4000)"
    for old, new in (("hereinafter", "from now on"), ("heretofore", "before now"), ("whereas", "because"), ("notwithstanding", "despite"), ("shall", "must"), ("thereof", "of that"), ("party of the first part", "the first party"), ("party of the second part", "the second party")):
        s = f"regexp_replace({s}, '(?i)\\b{old}\\b', '{new}', 'g')"
    s = f"regexp_replace(regexp_replace({s}, '\\n{{2,}}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')"
    return _TRIM % s


def oracle_sql() -> dict[str, str]:
    masked, found = _masked()
    norm = "regexp_replace(text, '\\r\\n?', chr(10), 'g')"
    norm = f"translate({norm}, chr(173) || chr(8203), '')"
    norm = f"regexp_replace(regexp_replace({norm}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    norm = _TRIM % f"regexp_replace({norm}, '([A-Za-z0-9_])-\\n([A-Za-z0-9_])', '\\1\\2', 'g')"
    ref = lambda p, label: f"CASE WHEN regexp_matches(text, '{p}') THEN '{label}' || regexp_extract(text, '{p}', 1) END"
    heading = "|".join((rf"^{_WS2}*(?:Section|Sec\.|S\.){_WS2}*\d+[A-Z]{{0,2}}(?:[.—-]|{_WS2})", rf"^{_WS2}*Article{_WS2}*\d+[A-Z]{{0,2}}(?:[.—-]|{_WS2})", rf"^{_WS2}*\d+[A-Z]?\.{_WS2}+[A-Z\"''(]", rf"^{_WS2}*\(\d+\){_WS2}", rf"^{_WS2}*(?:CHAPTER|PART){_WS2}+[IVXLC\d]+", rf"^{_WS2}*\d+(?:\.\d+){{1,3}}{_WS2}+[^\t\n\x0b\f\r \x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{feff}}]"))
    note_body = f"regexp_replace(regexp_replace(text, '(?i)^{_WS2}*Section{_WS2}+[0-9A-Z]+\\.{_WS2}*', ''), '^{_WS2}+', '')"
    syl = "CASE WHEN length(z) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(regexp_replace(z, '(?:es|ed|[^laeiouy]e)$', ''), '[aeiouy]{1,2}'))) END"
    clean = f"trim(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '[#*_>\\[\\]()-]', ' ', 'g'), '{_WS2}+', ' ', 'g'))"
    told = f"means|meaning|that is|i\\.e\\.|in simple|in plain|— |- |\\(|\"|''"
    jargon = ", ".join(f"CASE WHEN contains(lower(text), '{t}') AND NOT regexp_matches(substring(lower(text), CAST(strpos(lower(text), '{t}') AS INT), 160), '{told}') THEN '{t}' END" for t in _TERMS)
    hits = " + ".join("(length(low) - length(replace(low, '{0}', ''))) // {1}".format(k.replace("'", "''"), len(k)) for k in KEYWORDS)
    fnv = lambda seed: f"list_reduce(list_prepend(CAST({seed} AS BIGINT), list_transform(range(1, length(term) + 1), lambda i: CAST(ascii(substring(term, CAST(i AS INT), 1)) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
    bigcols = "CAST(sum(length(text)) AS BIGINT)"
    q = {
        "normalize_text": f"SELECT chunk_no, md5({norm}) AS md5 FROM chunks",
        "term_df": f"WITH t AS ({_terms('chunks', 'text', 'chunk_no')}) SELECT term, count(DISTINCT chunk_no) AS df, count(*) AS cf FROM t GROUP BY 1",
        "doc_length_stats": f"WITH {_bm25(_GOLD, 3)} SELECT count(*) AS docs, CAST(sum(len) AS BIGINT) AS terms, max(len) AS longest FROM lens",
        "extract_refs": f"SELECT chunk_no, coalesce({ref(rf'(?i)\b(?:Section|Sec\.?|S\.){_WS2}*([0-9]+[A-Z]{{0,2}})', 'S. ')}, {ref(rf'(?i)\bArticle{_WS2}*([0-9]+[A-Z]{{0,2}})', 'Art. ')}, {ref(rf'(?i)\bClause{_WS2}*([0-9]+(?:\.[0-9]+)*)', 'Cl. ')}) AS ref FROM chunks",
        "heading_lines": f"SELECT doc_id, count(*) FILTER (regexp_matches(line, '(?i){heading}')) AS headings FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1",
        "marginal_notes": f"SELECT chunk_no, CASE WHEN length(h) BETWEEN 4 AND 140 AND length({_TRIM % 'h'}) > 3 THEN {_TRIM % 'h'} END AS note FROM (SELECT chunk_no, regexp_extract({note_body}, '^([^.—]*)[.—]', 1) AS h FROM chunks)",
        "bm25_topk": _top(10) + " SELECT qid, chunk_no, score, rank FROM hits",
        "bm25_heading_boost": _top(10, 3) + " SELECT qid, chunk_no, score, rank FROM hits",
        "fnv_hash_buckets": f"SELECT term, {fnv(2166136261)} AS hash, {fnv(2166136261)} % 512 AS idx, {fnv(5381)} & 1 = 1 AS positive FROM (SELECT DISTINCT term FROM ({_terms('documents', 'text', 'doc_id')}) WHERE regexp_matches(term, '^[a-z0-9]+$'))",
        "quantize_vectors": "SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) / m * 127 + 0.5) AS TINYINT)), ',') AS q FROM (SELECT vec_id, embedding, CASE WHEN m = 0 THEN 1 ELSE m END AS m FROM (SELECT *, list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) AS m FROM embeddings))",
        "cosine_topk": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), s AS (SELECT a.vec_id, b.vec_id AS near, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, near) AS rank FROM s) WHERE rank <= 10",
        "rrf_fuse": _LISTS + _RRF + _rank10("rrf", "score DESC, chunk_no"),
        "fuse_best_rank": _LISTS + ", best AS (SELECT qid, chunk_no, score, best_rank FROM (SELECT qid, chunk_no, score, rank AS best_rank, row_number() OVER (PARTITION BY qid, chunk_no ORDER BY rank, list_no) AS n FROM lists) WHERE n = 1)" + _rank10("best", "best_rank, score DESC, chunk_no"),
        "fuse_best_score": _LISTS + ", best AS (SELECT qid, chunk_no, max(score) AS score FROM lists GROUP BY 1, 2)" + _rank10("best", "score DESC, chunk_no"),
        "fuse_weighted": _LISTS + ", w AS (SELECT qid, chunk_no, round(sum(pow(0.7, list_no) / (60 + rank)), 9) AS score FROM lists GROUP BY 1, 2)" + _rank10("w", "score DESC, chunk_no"),
        "source_boost": _LISTS + _RRF + ", w AS (SELECT qid, chunk_no, round(CASE WHEN source = 'user' THEN score * 1.15 ELSE score END, 9) AS score FROM rrf JOIN chunks USING (chunk_no))" + _rank10("w", "score DESC, chunk_no"),
        "score_floor": _LISTS + _RRF + " SELECT qid, chunk_no, round(score, 6) AS score FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS best FROM rrf) WHERE score >= best * 0.45",
        "neighbor_expand": _top(3) + """, near AS (SELECT h.qid, c2.chunk_no, h.rank, x.side FROM hits h JOIN chunks c USING (chunk_no) CROSS JOIN (VALUES (0, -1), (1, 1)) AS x(side, shift)
            JOIN chunks c2 ON c2.doc_id = c.doc_id AND c2.ordinal = c.ordinal + x.shift WHERE NOT EXISTS (SELECT 1 FROM hits w WHERE w.qid = h.qid AND w.chunk_no = c2.chunk_no)),
            once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, chunk_no ORDER BY rank, side) AS n FROM near) WHERE n = 1)
            SELECT qid, chunk_no, rank, false AS neighbour FROM hits UNION ALL
            SELECT qid, chunk_no, last + row_number() OVER (PARTITION BY qid ORDER BY rank, side, chunk_no), true FROM once JOIN (SELECT qid, max(rank) AS last FROM hits GROUP BY 1) USING (qid)""",
        "context_budget": _top(12) + """, l AS (SELECT qid, chunk_no, rank, length('[' || rank || '] (' || CASE WHEN source = 'user' THEN 'YOUR DOCUMENT' ELSE 'LAW' END || ') ' || concat_ws(' - ', title, ref, 'p.' || page)) + 1 + length(text) AS size FROM hits JOIN chunks USING (chunk_no)),
            u AS (SELECT *, CAST(sum(size) OVER (PARTITION BY qid ORDER BY rank) AS BIGINT) AS used FROM l) SELECT qid, chunk_no, rank, used FROM u WHERE used <= 6000 OR rank = 1""",
        "citations": _top(6) + " SELECT qid, rank AS n, chunk_no, title, ref, md5(left(text, 320)) AS snippet, floor(score * 10000 + 0.5) / 10000 AS score FROM hits JOIN chunks USING (chunk_no)",
        "jaccard_repeats": f"""WITH m AS (SELECT msg_no, content, lag(content) OVER (PARTITION BY chat_id ORDER BY turn, msg_no) AS before FROM {_LATEST}),
            w AS (SELECT msg_no, list_distinct(list_filter(string_split_regex(lower(content), '[^A-Za-z0-9_]+'), lambda x: length(x) > 3)) AS a, list_distinct(list_filter(string_split_regex(lower(before), '[^A-Za-z0-9_]+'), lambda x: length(x) > 3)) AS b FROM m WHERE before IS NOT NULL)
            SELECT msg_no, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END AS overlap FROM w""",
        "pii_redact": f"SELECT msg_no, md5({masked}) AS masked, {found} AS found FROM messages",
        "input_verdict": f"SELECT msg_no, CASE WHEN content IS NULL OR {_TRIM % 'content'} = '' THEN 'empty' WHEN length({_TRIM % 'content'}) > 4000 THEN 'too_long' WHEN {_any(_CRISIS)} THEN 'crisis' WHEN {_any(_INJECTION)} THEN 'prompt_injection' WHEN {_any(_HARMFUL)} THEN 'harmful_legal' ELSE 'ok' END AS category FROM messages WHERE role = 'user'",
        "output_guard": f"SELECT msg_no, md5({_TRIM % f"regexp_replace({_softened('content')}, '\\[(?:0?[03-9]|00|[1-9][0-9])\\]', '', 'g')"}) AS text FROM messages WHERE role = 'assistant'",
        "citation_check": "SELECT msg_no, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(content, '\\[([0-9]{1,2})\\]', 1), lambda x: CAST(x AS INT)), lambda n: n < 1 OR n > 2))), ',') AS invalid FROM messages WHERE role = 'assistant'",
        "readability_scores": f"""WITH c AS (SELECT doc_id, {clean} AS t FROM documents WHERE text IS NOT NULL),
            w AS (SELECT doc_id, list_filter(string_split(t, ' '), lambda x: regexp_matches(x, '[A-Za-z]')) AS ws, len(list_filter(string_split_regex(t, '[.!?]+(?:{_WS2}|$)'), lambda s: length({_TRIM % 's'}) > 2)) AS ns FROM c),
            s AS (SELECT doc_id, CAST(sum({syl}) AS BIGINT) AS y FROM (SELECT doc_id, regexp_replace(lower(unnest(ws)), '[^a-z]', '', 'g') AS z FROM w) GROUP BY 1),
            m AS (SELECT doc_id, greatest(1, len(ws)) AS words, greatest(1, ns) AS sentences, coalesce(y, 0) AS syllables, len(list_filter(ws, lambda x: length(x) > 12)) AS long_words FROM w LEFT JOIN s USING (doc_id))
            SELECT doc_id, words, sentences, syllables, long_words, round(floor((CAST(206.835 AS DOUBLE) - CAST(1.015 AS DOUBLE) * (words / sentences) - CAST(84.6 AS DOUBLE) * (syllables / words)) * 10 + 0.5) / 10, 1) AS flesch,
              round(floor((CAST(0.39 AS DOUBLE) * (words / sentences) + CAST(11.8 AS DOUBLE) * (syllables / words) - CAST(15.59 AS DOUBLE)) * 10 + 0.5) / 10, 1) AS grade FROM m""",
        "jargon_flags": f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN concat_ws(',', {jargon}) ELSE '' END AS jargon FROM documents",
        "risk_keywords": f"""WITH c AS (SELECT chunk_no, unnest(string_split_regex(regexp_replace(regexp_replace(text, '\\n+', chr(31), 'g'), '([.?!])[\\t-\\r ]+', '\\1' || chr(31), 'g'), chr(31) || '+')) AS clause FROM chunks),
            s AS (SELECT chunk_no, 2 * ({hits}) + CASE WHEN regexp_matches(clause, '(?i)\\b(?:retain|forfeit|confiscate)\\b') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(clause, '(?i)\\b(?:\\$|rs\\.|inr){_WS2}*[0-9]{{3,}}') THEN 1 ELSE 0 END AS score FROM (SELECT *, lower(clause) AS low FROM c) WHERE clause <> '')
            SELECT chunk_no, CASE WHEN score >= 4 THEN 'high' WHEN score >= 2 THEN 'medium' ELSE 'low' END AS severity, count(*) AS clauses, CAST(sum(score) AS BIGINT) AS score FROM s WHERE score > 0 GROUP BY 1, 2""",
        "chunk_percentiles": """WITH l AS (SELECT length(text) AS chars, row_number() OVER (ORDER BY length(text)) AS r, count(*) OVER () AS n FROM chunks WHERE text IS NOT NULL)
            SELECT CAST(max(chars) FILTER (r = floor(n * 0.1) + 1) AS INT) AS p10, CAST(max(chars) FILTER (r = floor(n * 0.5) + 1) AS INT) AS p50, CAST(max(chars) FILTER (r = floor(n * 0.9) + 1) AS INT) AS p90, CAST(max(chars) AS INT) AS longest FROM l""",
        "shard_manifest": f"SELECT shard, count(*) AS passages, {bigcols} AS chars FROM (SELECT text, (row_number() OVER (ORDER BY chunk_no) - 1) // 900 AS shard FROM chunks) GROUP BY 1",
        "corpus_manifest": f"SELECT title, count(*) AS passages, {bigcols} AS chars FROM chunks GROUP BY ROLLUP (title)",
        "dedupe_longest": """WITH s AS (SELECT name, unnest(sections, recursive := true), generate_subscripts(sections, 1) - 1 AS pos FROM acts)
            SELECT name, section, CAST(pos AS INT) AS pos, length(text) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY name, section ORDER BY length(text) DESC, pos) AS n FROM s WHERE section <> '') WHERE n = 1
            UNION ALL SELECT name, section, CAST(pos AS INT), length(text) FROM s WHERE section = '' OR section IS NULL""",
        "acts_without_passages": "SELECT name FROM acts WHERE name NOT IN (SELECT title FROM chunks WHERE title IS NOT NULL)",
        "page_plan": f"""WITH p AS (SELECT doc_id, page, page_no, coalesce(length({_TRIM % 'text'}), 0) < 90 AS scan FROM extracted_pages),
            n AS (SELECT *, sum(CAST(scan AS INT)) OVER (PARTITION BY doc_id ORDER BY page, page_no) AS nth FROM p)
            SELECT doc_id, CASE WHEN NOT scan THEN 'text' WHEN nth <= 20 THEN 'vision' ELSE 'skipped' END AS plan, count(*) AS pages FROM n GROUP BY 1, 2""",
        "extraction_label": "SELECT doc_id, CASE WHEN min(via) = max(via) THEN min(via) ELSE 'mixed' END AS extraction FROM extracted_pages WHERE via IS NOT NULL GROUP BY 1",
        "eval_metrics": _top(12, 3) + """, r AS (SELECT id AS qid, unnest(relevant, recursive := true) FROM goldset), tg AS (SELECT qid, act, unnest(CASE WHEN len(refs) > 0 THEN refs ELSE [NULL] END) AS want FROM r),
            w AS (SELECT qid, count(DISTINCT act || '|' || coalesce(want, '*')) AS wanted FROM tg GROUP BY 1),
            j AS (SELECT h.qid, h.rank, act, want, act IS NOT NULL AND (want IS NULL OR want IS NOT DISTINCT FROM c.ref) AS rel FROM hits h JOIN chunks c USING (chunk_no) LEFT JOIN tg ON tg.qid = h.qid AND tg.act = c.title),
            f AS (SELECT qid, count(DISTINCT act || '|' || coalesce(want, '*')) AS found FROM j WHERE rel GROUP BY 1),
            k AS (SELECT qid, rank, bool_or(rel) AS rel FROM j GROUP BY 1, 2),
            m AS (SELECT qid, min(rank) FILTER (rel) AS first, sum(CASE WHEN rel THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, avg(CAST(rel AS INT)) AS precision, count(*) AS returned FROM k GROUP BY 1)
            SELECT q.qid, CAST(first IS NOT NULL AS BIGINT) AS hit, round(coalesce(1.0 / first, 0), 6) AS rr, round(CASE WHEN wanted > 0 THEN coalesce(dcg, 0) / list_sum(list_transform(range(1, CAST(greatest(1, least(wanted, 12)) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg,
              round(coalesce(precision, 0), 6) AS precision, round(CASE WHEN wanted > 0 THEN coalesce(found, 0) / wanted ELSE 0 END, 6) AS coverage, coalesce(returned, 0) AS returned
            FROM questions q LEFT JOIN w USING (qid) LEFT JOIN m USING (qid) LEFT JOIN f USING (qid)""",
        "daily_usage": """WITH e AS (SELECT strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d') AS day, CAST(user_id AS VARCHAR) AS u, json_extract_string(props, '$.k') AS dev, value FROM events WHERE value > 0)
            SELECT day, 'user' AS scope, u AS who, round(sum(value), 2) AS used FROM e GROUP BY day, u UNION ALL SELECT day, 'device', dev, round(sum(value), 2) FROM e GROUP BY day, dev UNION ALL SELECT day, 'global', '*', round(sum(value), 2) FROM e GROUP BY day""",
        "usage_tightest": """WITH e AS (SELECT strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d') AS day, CAST(user_id AS VARCHAR) AS u, value FROM events WHERE value > 0),
            a AS (SELECT day, u, round(sum(value), 2) AS used FROM e GROUP BY 1, 2), g AS (SELECT day, round(sum(value), 2) AS used FROM e GROUP BY 1),
            s AS (SELECT a.day, a.u, greatest(0, 300.0 - a.used) AS ru, greatest(0, 20000.0 - g.used) AS rg, a.used < 300 AND g.used < 20000 AS ok FROM a JOIN g USING (day))
            SELECT day, u AS "user", ok, CAST(round(least(ru, rg), 2) AS DOUBLE) AS remaining, CASE WHEN ru <= rg THEN 'user' ELSE 'global' END AS scope FROM s""",
        "rate_limit": "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) AS n FROM events) WHERE n <= 1",
        "recent_chats": f"WITH c AS (SELECT user_id, chat_id, max(created_at) AS at_, count(*) AS messages FROM {_LATEST} GROUP BY 1, 2) SELECT user_id, chat_id, rank, messages FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at_ DESC, chat_id) AS rank FROM c) WHERE rank <= 40",
        "history_text": f"""WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY turn DESC, msg_no) AS k FROM {_LATEST}) WHERE k <= 6)
            SELECT chat_id, md5(string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || left(content, 400), chr(10) ORDER BY turn, msg_no)) AS history FROM r GROUP BY 1""",
        "json_salvage": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
        "latest_messages": f"SELECT role, count(*) AS messages, CAST(sum(length(content)) AS BIGINT) AS chars FROM {_LATEST} GROUP BY 1",
        "document_sources": "SELECT source, count(DISTINCT doc_id) AS docs FROM doc_meta GROUP BY 1",
        "plain_language": f"SELECT doc_id, md5({_plain()}) AS plain FROM documents",
    }
    return q
