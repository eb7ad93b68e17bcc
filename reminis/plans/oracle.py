"""DuckDB SQL that states the results of the registered queries, over the driver's tables."""

from __future__ import annotations

import re

from reminis.functions.text import RERANK_STOP_WORDS, STOP_WORDS

AS_OF = "TIMESTAMP '2024-12-31 00:00:00'"
_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_RERANK_STOP = "[" + ", ".join(f"'{w}'" for w in RERANK_STOP_WORDS) + "]"
_BLANK = r"[\s\x{00A0}\x{FEFF}]"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


def _raw(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '\b[a-z0-9]+\b')"


def _tokens(x: str, stop: str = _STOP) -> str:
    return f"list_filter({_raw(x)}, lambda t: NOT list_contains({stop}, t))"


def _intent(x: str) -> str:
    return (
        rf"CASE WHEN regexp_matches({x}, '\b(current|now|latest|recently|today)\b', 'i') THEN 'recency' "
        rf"WHEN regexp_matches({x}, '\b(first|originally|ever|history|used\s+to)\b', 'i') THEN 'historical' ELSE 'default' END"
    )


def _age(created: str, as_of: str = AS_OF) -> str:
    return f"(date_diff('microsecond', {created}, {as_of}) / 8.64e10::DOUBLE)"


def _age_label(days: str) -> str:
    return (
        f"CASE WHEN {days} < 1 THEN 'today' WHEN {days} < 2 THEN 'yesterday' WHEN {days} < 7 THEN floor({days})::BIGINT || ' days ago' "
        f"WHEN {days} < 14 THEN '1 week ago' WHEN {days} < 30 THEN floor({days} / 7)::BIGINT || ' weeks ago' WHEN {days} < 60 THEN '1 month ago' "
        f"WHEN {days} < 365 THEN floor({days} / 30)::BIGINT || ' months ago' WHEN {days} < 730 THEN '1 year ago' "
        f"ELSE floor({days} / 365)::BIGINT || ' years ago' END"
    )


_LAMBDA = "CASE decay_rate WHEN 'slow' THEN 0.005::DOUBLE WHEN 'medium' THEN 0.05::DOUBLE WHEN 'fast' THEN 0.1::DOUBLE ELSE 0.005::DOUBLE END"
_LABEL = "coalesce(source_session_label, source_session_id)"
_TIER = "CASE WHEN {0} >= 0.062 THEN '[HIGH]' WHEN {0} >= 0.054 THEN '[MED] ' ELSE '[LOW] ' END"
_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


def _distance(a: str, b: str) -> str:
    return f"round(coalesce(1 - {_DOT.format(a, b)} / nullif(sqrt({_DOT.format(a, a)}) * sqrt({_DOT.format(b, b)}), 0), 'NaN'::DOUBLE), 9) + 0::DOUBLE"


#: Named parts; a part may use those before it.
PARTS = {
    "facts": f"""
SELECT d.doc_id AS fact_id, 'u' || (d.doc_id % 3) AS user_id, d.text AS content,
  CASE WHEN l.quality = 1 THEN 0.95::DOUBLE WHEN l.quality = 0 THEN 0.5::DOUBLE ELSE 0.75::DOUBLE END AS confidence,
  CASE (d.doc_id // 3) % 4 WHEN 0 THEN 'slow' WHEN 1 THEN 'medium' WHEN 2 THEN 'fast' ELSE 'other' END AS decay_rate,
  d.source AS source_session_id, CASE WHEN d.doc_id % 7 = 0 THEN d.lang END AS source_session_label,
  CASE WHEN d.doc_id % 5 <> 0 THEN [d.lang, d.source] END AS tags,
  {AS_OF} - to_days(((d.doc_id * 7) % 800)::INTEGER) AS created_at,
  CASE WHEN d.doc_id % 10 = 9 THEN {AS_OF} END AS deleted_at,
  CASE WHEN d.doc_id % 17 = 0 THEN 'failed' WHEN e.vec_id IS NOT NULL THEN 'done' ELSE 'pending' END AS embed_status,
  CASE WHEN d.doc_id % 17 = 0 THEN 'embedding failed' END AS embed_error,
  CASE WHEN d.doc_id % 17 <> 0 AND e.vec_id IS NOT NULL THEN 'hashing-64' END AS embed_model,
  CASE WHEN d.doc_id % 17 <> 0 THEN e.vec_id END AS vec_rowid
FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "mine": "SELECT * FROM facts WHERE user_id = 'u0'",
    "alive": "SELECT * FROM facts WHERE deleted_at IS NULL",
    "live": "SELECT * FROM mine WHERE deleted_at IS NULL",
    "queries": f"""
SELECT item_id AS query_id, 'u0' AS user_id, array_to_string({_raw('text')}[1:5], ' ') || '@SUFFIX@' AS text, e.embedding
FROM benchmark b LEFT JOIN embeddings e ON b.item_id = e.vec_id WHERE item_id < @ITEMS@""",
    "docs": f"SELECT user_id, fact_id, created_at, {_tokens('content')} AS tokens, len({_tokens('content')}) AS dl FROM live",
    "stats": "SELECT count(*) AS n, sum(dl)::DOUBLE / count(*) AS avgdl FROM docs",
    "terms": f"SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_tokens('text')}) AS term FROM queries) GROUP BY ALL",
    "hits": """
SELECT fact_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT fact_id, dl, unnest(tokens) AS term FROM docs)
WHERE term IN (SELECT term FROM terms) GROUP BY fact_id, term""",
    "idfs": "SELECT term, count(*) AS df, ln((n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1) AS idf FROM hits, stats GROUP BY term, n",
    "scores": """
SELECT q.query_id, d.fact_id, d.created_at, coalesce(round(s.bm25, 9), 0::DOUBLE) AS bm25 FROM docs d CROSS JOIN queries q LEFT JOIN (
  SELECT query_id, fact_id,
    sum(qtf * idf * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS bm25
  FROM hits JOIN terms USING (term) JOIN idfs USING (term), stats GROUP BY ALL) s ON s.query_id = q.query_id AND s.fact_id = d.fact_id""",
    "words": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, created_at DESC, fact_id) AS rank FROM scores",
    "near_all": f"""
SELECT q.query_id, f.fact_id, v.vec_id, {_distance('v.embedding', 'q.embedding')} AS distance
FROM live f JOIN embeddings v ON f.vec_rowid = v.vec_id CROSS JOIN queries q""",
    "near": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM near_all) WHERE rank <= @REACH@",
    "rrf": """
SELECT query_id, fact_id, w.rank AS bm25_rank, n.rank AS vec_rank,
  coalesce(1.0::DOUBLE / (30 + w.rank), 0) + coalesce(1.0::DOUBLE / (30 + n.rank), 0) AS rrf
FROM words w FULL JOIN near n USING (query_id, fact_id)""",
    "boosted": f"""
SELECT r.*, f.created_at, round(rrf * 2 * exp(-(CASE {_intent('q.text')} WHEN 'recency' THEN 0.05::DOUBLE WHEN 'historical' THEN 0::DOUBLE ELSE {_LAMBDA} END)
  * {_age('f.created_at')}), 9) AS score
FROM rrf r JOIN live f USING (fact_id) JOIN queries q USING (query_id)""",
    "fused": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_rank NULLS LAST, bm25_rank, fact_id) AS before FROM boosted",
    "shares": f"""
SELECT r.query_id, r.fact_id, r.before, r.score,
  len(list_filter(u.w, lambda x: contains(lower(f.content), x)))::DOUBLE / nullif(len(u.w), 0) AS share
FROM fused r JOIN live f USING (fact_id)
JOIN (SELECT query_id, list_distinct({_tokens('text', _RERANK_STOP)}) AS w FROM queries) u USING (query_id) WHERE before <= 100 + @LIMIT@""",
    "finals": """
SELECT query_id, fact_id, before, CASE WHEN before <= 100 AND share IS NOT NULL THEN round(0.7::DOUBLE * score + 0.3::DOUBLE * share, 9) ELSE score END AS final_score
FROM shares""",
    "found": """
SELECT * FROM (SELECT p.query_id, row_number() OVER (PARTITION BY p.query_id ORDER BY p.before > 100, p.final_score DESC, p.before) AS rank, f.*, p.final_score
FROM finals p JOIN live f USING (fact_id)) WHERE rank <= @LIMIT@""",
    "exchanges_all": f"""
SELECT 'u' || (conv_id % 3) AS user_id, conv_id AS session_id, turn, {AS_OF} + to_minutes((turn - conv_id * 60)::INTEGER) AS timestamp,
  'User: ' || text || chr(10) || 'Assistant: ' || next_text AS chunk_text,
  sha256('User: ' || text || chr(10) || 'Assistant: ' || next_text) AS content_hash, embedding
FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) c
LEFT JOIN embeddings e ON c.conv_id = e.vec_id WHERE role = 'user' AND next_role = 'assistant'""",
    "exchanges": "SELECT * FROM exchanges_all WHERE user_id = 'u0'",
    "ex_docs": f"SELECT session_id, turn, timestamp, {_tokens('chunk_text')} AS tokens, len({_tokens('chunk_text')}) AS dl FROM exchanges",
    "ex_stats": "SELECT count(*) AS n, sum(dl)::DOUBLE / count(*) AS avgdl FROM ex_docs",
    "ex_hits": """
SELECT session_id, turn, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT session_id, turn, dl, unnest(tokens) AS term FROM ex_docs)
WHERE term IN (SELECT term FROM terms) GROUP BY ALL""",
    "ex_idfs": "SELECT term, ln((n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1) AS idf FROM ex_hits, ex_stats GROUP BY term, n",
    "ex_scores": """
SELECT d.session_id, d.turn, d.timestamp, coalesce(round(s.bm25, 9), 0::DOUBLE) AS bm25 FROM ex_docs d LEFT JOIN (
  SELECT session_id, turn, sum(qtf * idf * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS bm25
  FROM ex_hits JOIN terms USING (term) JOIN ex_idfs USING (term), ex_stats GROUP BY ALL) s USING (session_id, turn)""",
    "ex_words": "SELECT *, row_number() OVER (ORDER BY bm25 DESC, timestamp DESC, session_id, turn) AS rank FROM ex_scores",
    "ex_near": f"""
SELECT * FROM (SELECT x.session_id, x.turn, {_distance('x.embedding', 'q.embedding')} AS distance,
  row_number() OVER (ORDER BY {_distance('x.embedding', 'q.embedding')}, x.session_id, x.turn) AS rank
FROM exchanges x, queries q WHERE x.embedding IS NOT NULL) WHERE rank <= 50""",
    "wrapped": """
SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN '[MEMORY]' || chr(10) || 'old' || chr(10) || '[/MEMORY]' || chr(10) || ' ' || chr(9) || text
  || ' [MEMORY]x[/MEMORY]' || chr(10) ELSE text END AS text FROM conversations""",
}


def sql(body: str, limit: int = 10, suffix: str = "", items: int | None = 1) -> str:
    """``body`` with the parts it needs before it."""
    needed: set[str] = set()

    def need(text: str) -> None:
        for name in PARTS:
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                needed.add(name)
                need(PARTS[name])

    need(body)
    whole = ",\n".join(f"{name} AS ({PARTS[name]})" for name in PARTS if name in needed)
    whole = f"WITH {whole}\n{body}" if whole else body
    values = {"@LIMIT@": str(limit), "@REACH@": str(max(3 * limit, 50)), "@SUFFIX@": suffix, "@ITEMS@": str(2**63 - 1 if items is None else items)}
    for mark, value in values.items():
        whole = whole.replace(mark, value)
    return whole


def sql_of_users(body: str, limit: int = 10) -> str:
    """``body`` for all items, of which item i asks as user i % 3: the parts of one user, with the user beside each fact,
    term and count."""
    changes = {
        "FROM facts WHERE user_id = 'u0'": "FROM facts",
        "'u0' AS user_id": "'u' || (item_id % 3) AS user_id",
        "SELECT count(*) AS n, sum(dl)::DOUBLE / count(*) AS avgdl FROM docs": "SELECT user_id, count(*) AS n, sum(dl)::DOUBLE / count(*) AS avgdl FROM docs GROUP BY user_id",
        "SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id,": "SELECT query_id, user_id, term, count(*) AS qtf FROM (SELECT query_id, user_id,",
        "SELECT fact_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT fact_id, dl,": "SELECT user_id, fact_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT user_id, fact_id, dl,",
        "GROUP BY fact_id, term": "GROUP BY user_id, fact_id, term",
        "SELECT term, count(*) AS df, ln(": "SELECT user_id, term, count(*) AS df, ln(",
        "FROM hits, stats GROUP BY term, n": "FROM hits JOIN stats USING (user_id) GROUP BY user_id, term, n",
        "FROM docs d CROSS JOIN queries q LEFT JOIN": "FROM docs d JOIN queries q ON d.user_id = q.user_id LEFT JOIN",
        "FROM hits JOIN terms USING (term) JOIN idfs USING (term), stats GROUP BY ALL": "FROM hits JOIN terms USING (user_id, term) JOIN idfs USING (user_id, term) JOIN stats USING (user_id) GROUP BY ALL",
        "ON f.vec_rowid = v.vec_id CROSS JOIN queries q": "ON f.vec_rowid = v.vec_id JOIN queries q ON f.user_id = q.user_id",
    }
    whole = sql(body, limit, items=None)
    for one, many in changes.items():
        whole = whole.replace(one, many)
    return whole


_RESULT = (
    "SELECT rank, fact_id, source_session_id, source_session_label, created_at, CAST(to_json(tags) AS VARCHAR) AS tags_json, "
    "round(final_score, 6) AS final_score FROM found"
)
_LINE = f"{_TIER.format('final_score')} || ' [' || {_LABEL} || '] ' || {_age_label(_age('created_at'))} || ': \"' || content || '\"'"
_BLOCK = (
    f"'[MEMORY]' || chr(10) || chr(10) || '## Remembered facts' || chr(10) || string_agg({_LINE}, chr(10) ORDER BY rank) || chr(10) || chr(10) || "
    "'## Memory tools available' || chr(10) || '- `memory_search` — search for specific subtopics not covered above' || chr(10) || "
    "'- `memory_store` — store a new fact for future sessions'"
)
_STRIPPED = rf"regexp_replace(x, '\[MEMORY\][\s\S]*?\[/MEMORY\]', '', 'g')"
_ENVELOPE = rf"regexp_replace(x, '^Sender\s*\(untrusted metadata\)\s*:\s*```json[\s\S]*?```\s*', '', 'i')"
_CHANNEL = rf"regexp_replace(x, '^\[.*?\]\s*\[.*?\]\s*\n?', '')"


def _strip_blocks(x: str) -> str:
    return _trim(_STRIPPED.replace("(x,", f"({x},"))


def _strip_envelope(x: str) -> str:
    inner = _trim(_ENVELOPE.replace("(x,", f"({x},"))
    return f"nullif({_trim(_CHANNEL.replace('(x,', f'({inner},'))}, '')"


_BYTES = "octet_length(encode(text)) * CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1000000 END"
_SECONDS = "greatest(date_diff('microsecond', ts, TIMESTAMP '2024-01-30 12:00:00') // 1000000, 0)"
_PAGE = "'## A' || chr(10) || text || chr(10) || '### sub' || chr(10)"

ORACLE_SQL: dict[str, str] = {
    "live_facts": sql("SELECT fact_id, source_session_id, source_session_label, created_at, decay_rate, vec_rowid FROM alive"),
    "embedded_vectors": sql("SELECT vec_id, len(embedding)::BIGINT AS dim FROM embeddings WHERE vec_id IN (SELECT vec_rowid FROM alive)"),
    "pending_batch": sql("SELECT fact_id, length(content)::BIGINT AS content_chars FROM facts WHERE embed_status = 'pending' ORDER BY fact_id LIMIT 8"),
    "ingest_defaults": """
SELECT length(text)::BIGINT AS content_chars, CASE WHEN doc_id % 2 = 0 THEN 0.5::DOUBLE ELSE 0.95::DOUBLE END AS confidence,
  CASE WHEN doc_id % 3 = 0 THEN 'fast' ELSE 'slow' END AS decay_rate, 'pending' AS embed_status, count(*) AS n FROM documents GROUP BY ALL""",
    "soft_delete": sql("""
SELECT f.fact_id, coalesce(d.at, f.deleted_at) AS deleted_at, coalesce(d.at, f.deleted_at) IS NULL AS is_live
FROM facts f LEFT JOIN (SELECT 'u' || (event_id % 3) AS user_id, user_id AS fact_id, max(ts) AS at FROM events WHERE event_type = 'error' GROUP BY ALL) d
USING (user_id, fact_id)"""),
    "embed_commit": sql("""
SELECT fact_id, CASE WHEN embed_status <> 'pending' THEN embed_status WHEN fact_id % 4 = 0 THEN 'failed' ELSE 'done' END AS embed_status,
  CASE WHEN embed_status = 'pending' THEN CASE WHEN fact_id % 4 = 0 THEN 'no model' END ELSE embed_error END AS embed_error,
  CASE WHEN embed_status = 'pending' AND fact_id % 4 <> 0 THEN 'hashing-64' ELSE embed_model END AS embed_model,
  CASE WHEN embed_status = 'pending' AND fact_id % 4 <> 0 THEN fact_id + 1000000 ELSE vec_rowid END AS vec_rowid FROM facts"""),
    "schema_evolve": """
SELECT doc_id AS fact_id, 0.9::DOUBLE AS confidence, 'slow' AS decay_rate, NULL::VARCHAR AS source_session_label, NULL::TIMESTAMP AS deleted_at FROM documents""",
    "export_facts": sql(f"""
SELECT fact_id, user_id, content, source_session_id, source_session_label, confidence, decay_rate, CAST(to_json(tags) AS VARCHAR) AS tags_json,
  {_ISO.format('created_at')} AS created_at, NULL::VARCHAR AS deleted_at FROM alive"""),
    "api_key_lookup": """
SELECT CAST(c_custkey AS VARCHAR) AS id, 'u' || (c_custkey % 3) AS user_id FROM customer
WHERE sha256('key_' || c_custkey) IN (sha256('key_7'), sha256('key_8')) AND c_custkey % 2 <> 0""",
    "nudge_fired": """
SELECT event_type AS trigger_type, bool_or(value > 0) AS fired FROM events GROUP BY 1 UNION ALL SELECT 'first_activation', false""",
    "tokenize": sql(f"SELECT fact_id, len({_tokens('content')})::BIGINT AS n_tokens, {_tokens('content')}[1] AS first_token FROM alive"),
    "term_freq": sql("SELECT fact_id, term, tf FROM hits"),
    "doc_freq": sql("SELECT term, df FROM idfs"),
    "idf": sql("SELECT term, round(idf, 6) AS idf FROM idfs"),
    "corpus_stats": sql(f"""
SELECT user_id, count(*) AS n_docs, sum(dl)::BIGINT AS total_len, round(sum(dl)::DOUBLE / count(*), 6) AS avgdl
FROM (SELECT user_id, len({_tokens('content')}) AS dl FROM facts WHERE deleted_at IS NULL) GROUP BY user_id"""),
    "bm25_scores": sql("SELECT fact_id, round(bm25, 6) AS bm25 FROM scores"),
    "bm25_rank": sql("SELECT fact_id, round(bm25, 6) AS bm25, rank FROM words"),
    "cosine_distance": sql(f"SELECT v.vec_id, round({_distance('v.embedding', 'q.embedding')}, 6) AS distance FROM embeddings v, queries q"),
    "vector_rank": sql("SELECT fact_id, round(distance, 6) AS distance, rank FROM near"),
    "vector_rank_bounded": sql_of_users("SELECT query_id, fact_id, round(distance, 6) AS distance, rank FROM near"),
    "vector_roundtrip": "SELECT vec_id, CAST(CAST(to_json(embedding) AS VARCHAR)::JSON AS FLOAT[]) = embedding AS ok FROM embeddings",
    "rrf_fuse": sql("SELECT fact_id, bm25_rank, vec_rank, round(rrf, 6) AS rrf FROM rrf"),
    "query_intent": f"""
SELECT query_id, {_intent('text')} AS intent FROM (SELECT item_id AS query_id, text || CASE item_id % 5 WHEN 1 THEN ' latest news'
  WHEN 2 THEN ' we Used  to know' WHEN 3 THEN ' currently' WHEN 4 THEN ' now, historically and ever' ELSE '' END AS text FROM benchmark)""",
    "decay_lambda": sql(f"SELECT decay_rate, {_LAMBDA} AS per_day, count(*) AS n FROM facts GROUP BY ALL"),
    "decay_curve": sql(f"SELECT fact_id, round({_age('created_at')}, 6) AS age_days, round(exp(-({_LAMBDA}) * {_age('created_at')}), 6) AS decay FROM alive"),
    "fused_rank": sql("SELECT fact_id, round(score, 6) AS score, before AS rank FROM fused"),
    "overlap_score": sql(f"""
SELECT f.fact_id, round(len(list_filter(u.w, lambda x: contains(lower(f.content), x)))::DOUBLE / nullif(len(u.w), 0), 6) AS overlap
FROM live f, (SELECT list_distinct({_tokens('text', _RERANK_STOP)}) AS w FROM queries) u"""),
    "hybrid_search": sql(_RESULT),
    "hybrid_search_recency": sql(_RESULT, suffix=" current"),
    "hybrid_search_historical": sql(_RESULT, suffix=" history"),
    "bm25_only_search": sql(f"""
SELECT rank, fact_id, source_session_id, source_session_label, f.created_at, CAST(to_json(tags) AS VARCHAR) AS tags_json,
  round(round(bm25 * 2 * exp(-({_LAMBDA}) * {_age('f.created_at')}), 9), 6) AS final_score
FROM words w JOIN live f USING (fact_id) WHERE rank <= 10"""),
    "multi_query_search": sql_of_users("SELECT query_id, rank, fact_id, round(final_score, 6) AS final_score FROM found"),
    "memory_context": sql(f"SELECT rank, fact_id, {_LABEL} AS session_label, created_at, round(final_score, 6) AS score FROM found WHERE rank <= 8", limit=16),
    "tool_search": sql(f"""
SELECT rank, fact_id, round(final_score, 6) AS score, floor({_age('created_at')} * 10 + 0.5::DOUBLE) / 10 AS age_in_days, {_LABEL} AS session_label FROM found""", limit=20),
    "context_lines": sql(f"SELECT rank, {_LINE} AS line FROM found WHERE rank <= 8", limit=16),
    "context_block": sql(f"SELECT {_BLOCK} AS block FROM found WHERE rank <= 8", limit=16),
    "injection_block": sql(f"SELECT '[MEMORY]' || chr(10) || {_BLOCK} || chr(10) || '[/MEMORY]' AS block FROM found WHERE rank <= 8", limit=16),
    "search_report": sql(f"""
SELECT 'Search results from memory:' || chr(10) || chr(10) || string_agg('- [' || {_LABEL} || ']' || CASE WHEN len(tags) > 0
  THEN ' [' || array_to_string(tags, ', ') || ']' ELSE '' END || ' ' || {_ISO.format('created_at')} || ':' || chr(10) || '  "' || substring(content, 1, 200)
  || '"' || chr(10), chr(10) ORDER BY rank) AS report FROM found""", limit=5),
    "tier_counts": sql(f"SELECT trim({_TIER.format('score')}) AS tier, count(*) AS n FROM fused GROUP BY 1"),
    "format_age": sql(f"SELECT fact_id, {_age_label(_age('created_at'))} AS age_label FROM facts"),
    "format_age_cli": f"""
SELECT event_id, CASE WHEN s >= 86400 THEN (s // 86400) || CASE WHEN s // 86400 > 1 THEN ' days ago' ELSE ' day ago' END
  WHEN s >= 3600 THEN (s // 3600) || CASE WHEN s // 3600 > 1 THEN ' hours ago' ELSE ' hour ago' END
  WHEN s >= 60 THEN (s // 60) || CASE WHEN s // 60 > 1 THEN ' minutes ago' ELSE ' minute ago' END
  ELSE s || CASE WHEN s = 1 THEN ' second ago' ELSE ' seconds ago' END END AS age_label
FROM (SELECT event_id, {_SECONDS} AS s FROM events)""",
    "format_bytes": f"""
SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', floor(b / 1024.0::DOUBLE * 10 + 0.5::DOUBLE) / 10)
  WHEN b < 1073741824 THEN printf('%.1f MB', floor(b / 1048576.0::DOUBLE * 10 + 0.5::DOUBLE) / 10) ELSE printf('%.1f GB', floor(b / 1073741824.0::DOUBLE * 10 + 0.5::DOUBLE) / 10) END AS size_label
FROM (SELECT doc_id, {_BYTES} AS b FROM documents)""",
    "confidence_map": """
SELECT level, CASE level WHEN 'high' THEN 0.95::DOUBLE WHEN 'medium' THEN 0.75::DOUBLE WHEN 'low' THEN 0.5::DOUBLE ELSE 0.95::DOUBLE END AS confidence, count(*) AS n
FROM (SELECT CASE WHEN quality = 1 THEN 'high' WHEN toxic = 1 THEN 'low' ELSE 'none' END AS level FROM labels) GROUP BY level""",
    "tags_parse": sql("SELECT fact_id, len(tags)::BIGINT AS n_tags, tags[1] AS first_tag FROM facts"),
    "excerpts": sql("""
SELECT fact_id, CASE WHEN length(content) > 80 THEN substring(content, 1, 80) || '...' ELSE content END AS excerpt80,
  least(length(content), 200)::BIGINT AS excerpt200_chars FROM facts"""),
    "status": sql("SELECT user_id, count(*) FILTER (deleted_at IS NULL) AS fact_count, max(created_at) AS last_ingestion FROM facts GROUP BY user_id"),
    "health_status_counts": sql("""
SELECT user_id, count(*) FILTER (embed_status = 'done') AS done, count(*) FILTER (embed_status = 'pending') AS pending,
  count(*) FILTER (embed_status = 'failed') AS failed, count(*) FILTER (embed_status = 'no_embed') AS no_embed FROM facts GROUP BY user_id"""),
    "health_models": sql("SELECT embed_model, count(*) AS n FROM facts WHERE embed_model IS NOT NULL GROUP BY 1"),
    "health_zero_vectors": "SELECT count(*) FILTER (embedding[1] = 0 AND embedding[-1] = 0) AS zero_vectors FROM embeddings",
    "health": sql("""
SELECT user_id, pending, failed, zero_vectors, pending = 0 AND failed = 0 AND zero_vectors = 0 AS healthy FROM (
  SELECT user_id, count(*) FILTER (embed_status = 'pending') AS pending, count(*) FILTER (embed_status = 'failed') AS failed FROM facts GROUP BY user_id),
  (SELECT count(*) FILTER (embedding[1] = 0 AND embedding[-1] = 0) AS zero_vectors FROM embeddings)"""),
    "markdown_sections": f"""
SELECT doc_id, section_no, section_chars FROM (
  SELECT doc_id, n AS section_no, length({_trim('s')})::BIGINT AS section_chars FROM (
    SELECT doc_id, 0::BIGINT AS n, text AS s FROM documents WHERE doc_id % 4 = 0
    UNION ALL SELECT doc_id, 0::BIGINT, {_PAGE} FROM documents WHERE doc_id % 4 <> 0
    UNION ALL SELECT doc_id, 1::BIGINT, '## B' || chr(10) || '  short ' || chr(10) FROM documents WHERE doc_id % 4 <> 0
    UNION ALL SELECT doc_id, 2::BIGINT, '## C' || chr(10) || 'end of ' || source || ' ................' || chr(10) FROM documents WHERE doc_id % 4 <> 0))
WHERE section_chars >= 20""",
    "exchange_scan": sql("SELECT session_id, turn, timestamp FROM exchanges_all"),
    "format_exchange": sql("SELECT session_id, turn, content_hash FROM exchanges_all"),
    "ingest_dedup": sql("""
SELECT session_id, turn, content_hash, row_number() OVER (PARTITION BY user_id, content_hash ORDER BY session_id, turn) > 1
  OR EXISTS (SELECT 1 FROM exchanges_all k WHERE k.session_id % 5 = 1 AND k.user_id = x.user_id AND k.content_hash = x.content_hash) AS skipped
FROM (SELECT user_id, session_id, turn, content_hash FROM exchanges_all UNION ALL
      SELECT user_id, session_id, turn + 1000, content_hash FROM exchanges_all WHERE session_id % 3 = 0) x"""),
    "exchange_status": sql("SELECT user_id, count(*) AS n, max(timestamp) AS last_ingestion FROM exchanges_all GROUP BY user_id"),
    "exchange_search": sql(f"""
SELECT rank, session_id, turn, round(final_score, 6) AS final_score FROM (
  SELECT *, row_number() OVER (ORDER BY final_score DESC, vec_rank NULLS LAST, bm25_rank, session_id, turn) AS rank FROM (
    SELECT session_id, turn, w.rank AS bm25_rank, n.rank AS vec_rank,
      round((coalesce(1.0::DOUBLE / (60 + w.rank), 0) + coalesce(1.0::DOUBLE / (60 + n.rank), 0)) * exp(-0.012::DOUBLE * {_age('w.timestamp')}), 9) AS final_score
    FROM ex_words w LEFT JOIN ex_near n USING (session_id, turn))) WHERE rank <= 10"""),
    "pgvector_knn": sql("SELECT session_id, turn, round(distance, 6) AS distance, rank FROM ex_near"),
    "last_user_message": sql(f"""
SELECT conv_id, turn, sha256(m) AS text_hash FROM (
  SELECT conv_id, turn, m, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n
  FROM (SELECT conv_id, turn, {_strip_blocks('text')} AS m FROM wrapped WHERE role = 'user') WHERE m <> '') WHERE n = 1"""),
    "resolve_query": f"""
WITH prompts AS (
  SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'text only' WHEN 1 THEN 'Sender (untrusted metadata):' || chr(10) || '```json' || chr(10) || '{{"id": 1}}' || chr(10)
    || '```' || chr(10) || chr(10) || '[10:00] [chat] ' || text ELSE text END AS prompt
  FROM (SELECT conv_id, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id)
), last AS (
  SELECT conv_id, arg_max(m, turn) AS m FROM (SELECT conv_id, turn, {_strip_blocks('text')} AS m FROM conversations WHERE role = 'user' AND conv_id % 2 = 0)
  WHERE m <> '' GROUP BY conv_id
)
SELECT conv_id, sha256(coalesce(m, {_strip_envelope('prompt')}, prompt)) AS query_hash,
  CASE WHEN m IS NOT NULL THEN 'message' WHEN {_strip_envelope('prompt')} IS NOT NULL THEN 'envelope' ELSE 'prompt' END AS source_step
FROM prompts LEFT JOIN last USING (conv_id)""",
    "strip_blocks": sql(f"SELECT conv_id, turn, sha256({_strip_blocks('text')}) AS stripped_hash FROM wrapped"),
    "strip_envelope": f"""
SELECT conv_id, turn, sha256({_strip_envelope('p')}) AS stripped_hash FROM (
  SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'SENDER (untrusted metadata) :' || chr(10) || '```json' || chr(10) || '{{"a": [1]}}' || chr(10) || '```' || chr(10)
    ELSE '' END || '[12:01] [general]' || chr(10) || text AS p FROM conversations)""",
}
