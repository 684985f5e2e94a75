"""Independent SQL oracles (DuckDB dialect) for the registered queries.

Written from the operator semantics, not from the Spark code: where Spark
uses a fold or a lookahead split, the SQL uses a recursive CTE, sentinel
characters or gaps-and-islands.
"""

from __future__ import annotations

from .. import constants as C

ORACLE: dict[str, str] = {}


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# white space of Unicode and the four information separators
SPACE = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]"
# a greedy run up to the last place where a sentence ends
SENTENCE_END = "(?s)^(.*)(?:[.!?] |\\.\\n)"
DOLLAR_OR_BRACKET_MATH = "(?s)\\$\\$.*?\\$\\$|\\$.*?\\$|\\\\\\[.*?\\\\\\]|\\\\\\(.*?\\\\\\)"


def strip(e: str) -> str:
    return f"regexp_replace({e}, {lit('^' + SPACE + '+|' + SPACE + '+$')}, '', 'g')"


def clean(e: str) -> str:
    x = f"coalesce({e}, '')"
    x = f"regexp_replace({x}, '\\r\\n', chr(10), 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({x}, '(\\$[^$]*\\$)|( ) +', '\\1\\2', 'g')"


def absent(e: str) -> str:
    return f"(coalesce({e}, '') = '')"


def chat(q: str, r: str, system: str = C.SYSTEM_PROMPT_VI) -> str:
    return f"({lit('[SYS]' + system + '[/SYS][USR]')} || {q} || '[/USR][AST]' || {r} || '[/AST][EOS]')"


def infer_prompt(q: str, system: str = C.SYSTEM_PROMPT_VI) -> str:
    return f"({lit('[SYS]' + system + '[/SYS][USR]')} || {q} || '[/USR][AST]')"


def tags_ok(e: str) -> str:
    return "(" + " AND ".join(f"coalesce(contains({e}, {lit(t)}), false)" for t in C.TEMPLATE_REQUIRED) + ")"


QA_CTE = """
qa_base AS (
  SELECT doc_id AS sample_id, source AS math_type,
         split_part(text, chr(10), 1) AS q0,
         CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS r0
  FROM documents),
qa AS (
  SELECT sample_id, q0 AS original_question_vi,
    CASE WHEN sample_id % 13 = 0 THEN ''
         WHEN sample_id % 17 = 0 THEN NULL
         WHEN sample_id % 5 = 0 THEN q0 || '  $a   b$   $$c   d$$  end'
         ELSE q0 END AS query_vi,
    CASE WHEN sample_id % 19 = 0 THEN NULL
         WHEN sample_id % 11 = 0 THEN replace(r0, chr(10), chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10))
         WHEN sample_id % 7 = 0 THEN replace(r0, '. ', '.  ')
         WHEN sample_id % 2 = 0 THEN replace(r0, chr(10), chr(10) || 'Vậy ')
         WHEN sample_id % 3 = 0 THEN 'Bước 1: ' || replace(r0, chr(10), chr(10) || '2. ')
         ELSE r0 END AS response_vi,
    q0 AS original_question_en, q0 AS query_en, r0 AS response_en, math_type AS type
  FROM qa_base),
qa_vi AS (
  SELECT sample_id, original_question_vi AS original_question, query_vi AS query,
         response_vi AS response, type AS math_type FROM qa)"""


def with_qa(body: str, *extra_ctes: str) -> str:
    ctes = [QA_CTE.strip()] + [c.strip() for c in extra_ctes]
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


CLEAN_CTE = f"""
cleaned AS (
  SELECT sample_id, {clean('query')} AS query, {clean('response')} AS response FROM qa_vi)"""

ORACLE["scan_qa"] = with_qa("SELECT * FROM qa")

ORACLE["project_lang"] = with_qa("""
SELECT sample_id, original_question_vi AS original_question, query_vi AS query, response_vi AS response,
       type AS math_type, 'vi' AS lang FROM qa
UNION ALL
SELECT sample_id, original_question_en, query_en, response_en, type, 'en' FROM qa""")

ORACLE["slice_rows"] = with_qa(f"""
SELECT sample_id, query, response, {chat('query', 'response')} AS chat_text
FROM cleaned WHERE sample_id BETWEEN 0 AND 2""", CLEAN_CTE)

ORACLE["corpus_counts"] = with_qa(f"""
SELECT count(*) AS n_samples,
       count(*) FILTER (WHERE NOT {absent('query')}) AS n_with_query,
       count(*) FILTER (WHERE NOT {absent('response')}) AS n_with_response,
       count(*) FILTER (WHERE {absent('query')} AND {absent('response')}) AS n_empty
FROM qa_vi""")

ORACLE["clean_text"] = with_qa("SELECT * FROM cleaned", CLEAN_CTE)

ORACLE["accepted_pairs"] = with_qa(
    "SELECT * FROM cleaned WHERE length(query) > 2 AND length(response) > 2", CLEAN_CTE)

ORACLE["acceptance_report"] = with_qa("""
SELECT count(*) AS total,
       count(*) FILTER (WHERE length(query) > 2 AND length(response) > 2) AS accepted,
       count(*) FILTER (WHERE NOT (length(query) > 2 AND length(response) > 2)) AS skipped
FROM cleaned""", CLEAN_CTE)

ORACLE["chat_text"] = with_qa(f"""
SELECT sample_id, 'vi' AS lang, {chat(clean('query_vi'), clean('response_vi'))} AS text FROM qa
UNION ALL
SELECT sample_id, 'en', {chat(clean('query_en'), clean('response_en'), C.SYSTEM_PROMPT_EN)} FROM qa""")

TRAINING_CTE = f"""
training AS (
  SELECT sample_id, {chat('query', 'response')} AS text FROM cleaned
  WHERE length(query) > 2 AND length(response) > 2)"""

ORACLE["training_texts"] = with_qa("SELECT * FROM training", CLEAN_CTE, TRAINING_CTE)

ORACLE["inference_prompts"] = with_qa(f"SELECT sample_id, {infer_prompt(clean('query'))} AS prompt FROM qa_vi")

ORACLE["validate_prompts"] = with_qa(f"""
SELECT sample_id, kind, {tags_ok('text')} AS valid FROM (
  SELECT sample_id, 'train' AS kind, text FROM training
  UNION ALL SELECT sample_id, 'inference', {infer_prompt(clean('query'))} FROM qa_vi
  UNION ALL SELECT sample_id, 'raw', query FROM qa_vi)""", CLEAN_CTE, TRAINING_CTE)

ORACLE["math_spans"] = with_qa(f"""
SELECT sample_id, field, pos, span FROM (
  SELECT sample_id, field, unnest(range(0, len(spans))) AS pos, unnest(spans) AS span FROM (
    SELECT sample_id, 'query' AS field, regexp_extract_all(query, {lit(DOLLAR_OR_BRACKET_MATH)}) AS spans FROM qa_vi
    UNION ALL
    SELECT sample_id, 'response', regexp_extract_all(response, {lit(DOLLAR_OR_BRACKET_MATH)}) FROM qa_vi))
WHERE span IS NOT NULL""")

ORACLE["valid_messages"] = f"""
SELECT conv_id, turn, role, text FROM conversations WHERE coalesce({strip('text')}, '') <> ''"""


# --- chunking ---------------------------------------------------------------------

WS2 = SPACE[:-1] + r"\x02]"          # whitespace or the newline guard
WS12 = SPACE[:-1] + r"\x01\x02]"     # ... or a split sentinel


def split_parts(e: str) -> str:
    """Marker split without lookahead: put a guard (chr 2) before every
    newline so that a marker ending in whitespace cannot swallow the newline
    that starts the next marker, mark every split point with chr 1, then split
    on chr 1, strip, and drop empty parts."""
    g = f"replace(coalesce({e}, ''), chr(10), chr(2) || chr(10))"
    line_markers = (r"(\n(?:Vậy|Do đó|Ta có|Thay)" + WS2 + r"|\nGiải:|\n" + WS2 + r"*\d+[.)]" + WS2 + ")")
    g = f"regexp_replace({g}, {lit(line_markers)}, chr(1) || '\\1', 'g')"
    g = f"regexp_replace({g}, {lit('(Bước' + WS12 + r'*\d)')}, chr(1) || '\\1', 'g')"
    g = f"replace({g}, chr(2), '')"
    return (f"list_filter(list_transform(string_split({g}, chr(1)), lambda x: {strip('x')}), "
            f"lambda x: x <> '')")


def windows_cte(name: str, source_sql: str, size: int = C.WINDOW, overlap: int = C.OVERLAP) -> str:
    """Recursive windows of (k, text) rows: one row per window with its start."""
    half = size // 2
    return f"""
{name}(k, text, n, idx, start, win, nxt) AS (
  SELECT k, text, length(text), CAST(-1 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT)
  FROM ({source_sql}) src
  UNION ALL
  SELECT k, text, n, idx + 1, nxt,
         CASE WHEN cut > {half} THEN substr(c, 1, cut + 1) ELSE c END,
         CASE WHEN cut > {half} THEN nxt + cut + 1 - {overlap} ELSE nxt + {size} - {overlap} END
  FROM (SELECT k, text, n, idx, nxt, substr(text, nxt + 1, {size}) AS c,
               CASE WHEN nxt + {size} < n
                    THEN length(regexp_extract(substr(text, nxt + 1, {size}), {lit(SENTENCE_END)}, 1))
                    ELSE -1 END AS cut
        FROM {name} WHERE nxt < n) t)"""


STEPS_CTES = [f"""
split_raw AS (
  SELECT sample_id, response, {split_parts('response')} AS parts FROM qa_vi WHERE NOT {absent('response')})""",
windows_cte("resp_windows", "SELECT sample_id AS k, response AS text FROM split_raw WHERE len(parts) <= 1"),
f"""
parts_final AS (
  SELECT sample_id, unnest(range(0, len(parts))) AS part_idx, unnest(parts) AS part
  FROM split_raw WHERE len(parts) > 1
  UNION ALL
  SELECT k, idx, {strip('win')} FROM resp_windows WHERE idx >= 0)""",
"""
islands AS (
  SELECT sample_id, part_idx, part,
         sum(CASE WHEN part_idx = 0 OR length(part) >= 30 THEN 1 ELSE 0 END)
           OVER (PARTITION BY sample_id ORDER BY part_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp
  FROM parts_final)""",
"""
steps AS (
  SELECT sample_id, CAST(grp - 1 AS BIGINT) AS step_idx, string_agg(part, ' ' ORDER BY part_idx) AS step
  FROM islands GROUP BY sample_id, grp)""",
"""
step_counts AS (SELECT sample_id, count(*) AS n_steps FROM steps GROUP BY sample_id)""",
]

CHUNKS_CTE = f"""
chunks AS (
  SELECT sample_id, CAST(0 AS INTEGER) AS chunk_pos, 'question' AS chunk_type, CAST(NULL AS INTEGER) AS step_idx,
         {lit(C.QUESTION_PREFIX)} || query AS text, math_type, left(query, {C.QUERY_REF_MAX}) AS query_ref
  FROM qa_vi WHERE NOT {absent('query')}
  UNION ALL
  SELECT s.sample_id, CAST((CASE WHEN {absent('q.query')} THEN 0 ELSE 1 END) + s.step_idx AS INTEGER),
         'solution', CAST(s.step_idx AS INTEGER),
         {lit(C.SOLUTION_PREFIX)} || (s.step_idx + 1) || '/' || c.n_steps || '] ' || s.step,
         q.math_type, left(coalesce(q.query, ''), {C.QUERY_REF_MAX})
  FROM steps s JOIN step_counts c ON s.sample_id = c.sample_id JOIN qa_vi q ON s.sample_id = q.sample_id
  UNION ALL
  SELECT sample_id, CAST(1 + n_steps AS INTEGER), 'full', CAST(NULL AS INTEGER),
         CASE WHEN length(f) > {C.FULL_MAX} THEN left(f, {C.FULL_MAX - 3}) || '...' ELSE f END,
         math_type, left(query, {C.QUERY_REF_MAX})
  FROM (SELECT q.*, {lit(C.FULL_PREFIX)} || q.query || {lit(C.FULL_SEPARATOR)} || q.response AS f, c.n_steps
        FROM qa_vi q JOIN step_counts c ON q.sample_id = c.sample_id
        WHERE NOT {absent('q.query')} AND NOT {absent('q.response')}) fq)"""

CHUNK_IDS_CTE = """
chunk_ids AS (
  SELECT row_number() OVER (ORDER BY sample_id, chunk_pos) - 1 AS chunk_id, * FROM chunks)"""


def with_chunks(body: str, *extra: str) -> str:
    return with_qa(body, *STEPS_CTES, CHUNKS_CTE, *extra)


ORACLE["solution_steps"] = with_qa(f"""
SELECT sample_id, unnest(range(0, len(parts))) AS part_idx, unnest(parts) AS part
FROM (SELECT sample_id, {split_parts('response')} AS parts FROM qa_vi)""")

ORACLE["sliding_windows"] = ("WITH RECURSIVE " + windows_cte("w", "SELECT doc_id AS k, text FROM documents").strip()
                             + "\nSELECT k AS doc_id, idx, start, win AS window FROM w WHERE idx >= 0")

ORACLE["merged_steps"] = with_qa("SELECT sample_id, step_idx, step FROM steps", *STEPS_CTES)

ORACLE["chunks"] = with_chunks("SELECT * FROM chunks")

ORACLE["chunk_type_counts"] = with_chunks("SELECT chunk_type, count(*) AS n_chunks FROM chunks GROUP BY chunk_type")

ORACLE["chunk_ids"] = with_chunks("SELECT chunk_id, sample_id, chunk_pos, chunk_type FROM chunk_ids", CHUNK_IDS_CTE)

ORACLE["batch_manifest"] = with_chunks(f"""
SELECT chunk_id // {C.INDEX_BATCH} AS batch_id, count(*) AS n_chunks, min(chunk_id) AS first_id, max(chunk_id) AS last_id
FROM chunk_ids GROUP BY 1""", CHUNK_IDS_CTE)


# --- vectors and retrieval ------------------------------------------------------------

def hash_vec_ctes(name: str, source_sql: str, dim: int = C.HASH_DIM) -> list[str]:
    """Sparse hashed vectors (k, bucket, w) of (k, text) rows."""
    return [rf"""
{name}_tok AS (
  SELECT k, unnest(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+')) AS t FROM ({source_sql}) s)""",
            f"""
{name}_cnt AS (
  SELECT k, (('0x' || substr(md5(t), 1, 8))::BIGINT) % {dim} AS bucket, count(*)::DOUBLE AS c
  FROM {name}_tok WHERE t <> '' GROUP BY 1, 2)""",
            f"""
{name} AS (SELECT k, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY k)) AS w FROM {name}_cnt)"""]


HITS_CTES = [CHUNK_IDS_CTE,
             *hash_vec_ctes("pv", "SELECT chunk_id AS k, text FROM chunk_ids"),
             *hash_vec_ctes("qv", "SELECT item_id AS k, text FROM benchmark"),
             f"""
scores AS (
  SELECT q.k AS query_id, p.k AS id, round(sum(q.w * p.w), 6) AS score
  FROM qv q JOIN pv p ON q.bucket = p.bucket GROUP BY 1, 2)""",
             f"""
hits AS (
  SELECT r.query_id, r.rank, r.id, r.score, c.sample_id, c.chunk_type, c.text
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scores) r
  JOIN chunk_ids c ON c.chunk_id = r.id
  WHERE r.rank <= {C.TOP_K} AND r.score >= {C.FLOOR})""",
             """
dedup AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(sample_id, -1) ORDER BY score DESC, rank) AS rr
    FROM hits) WHERE rr = 1)"""]


def type_rank_sql(e: str) -> str:
    whens = " ".join(f"WHEN {e} = {lit(k)} THEN {v}" for k, v in C.TYPE_RANK.items())
    return f"(CASE WHEN {e} IS NULL THEN {C.MISSING_TYPE_RANK} {whens} ELSE {C.UNKNOWN_TYPE_RANK} END)"


def type_label_sql(e: str) -> str:
    whens = " ".join(f"WHEN {e} = {lit(k)} THEN {lit(v)}" for k, v in C.TYPE_LABEL.items())
    return f"(CASE {whens} ELSE {lit(C.DEFAULT_LABEL)} END)"


CONTEXT_CTE = f"""
context AS (
  SELECT query_id, CASE WHEN length(ctx) > {C.CONTEXT_MAX} THEN left(ctx, {C.CONTEXT_MAX}) || '...' ELSE ctx END AS context
  FROM (
    SELECT query_id, string_agg(
        {type_label_sql('chunk_type')} || ' (score=' ||
        CAST(CAST(round(CAST(score AS DECIMAL(10,6)), 2) AS DECIMAL(10,2)) AS VARCHAR) || '):' || chr(10) || coalesce(text, ''),
        {lit(C.CONTEXT_SEPARATOR)} ORDER BY {type_rank_sql('chunk_type')}, score DESC, rank) AS ctx
    FROM dedup GROUP BY query_id))"""

ROUTE_CTE = f"""
route AS (
  SELECT b.item_id AS query_id, coalesce(a.best, 0.0) AS best_score, coalesce(a.n, 0) AS n_hits,
         (coalesce(a.best, 0.0) < {C.GATE} OR coalesce(a.n, 0) < {C.MIN_HITS}) AS use_web
  FROM benchmark b LEFT JOIN (SELECT query_id, max(score) AS best, count(*) AS n FROM hits GROUP BY 1) a
  ON a.query_id = b.item_id)"""

ANSWERED_CTE = """
answered AS (
  SELECT r.query_id, b.text AS question, coalesce(c.context, '') AS context, r.use_web
  FROM route r JOIN benchmark b ON b.item_id = r.query_id LEFT JOIN context c ON c.query_id = r.query_id)"""


def with_hits(body: str, *extra: str) -> str:
    return with_chunks(body, *HITS_CTES, *extra)


ORACLE["hash_embed"] = ("WITH " + ",\n".join(c.strip() for c in hash_vec_ctes("hv", "SELECT doc_id AS k, text FROM documents"))
                        + "\nSELECT k AS doc_id, bucket, round(w, 6) AS weight FROM hv")

ORACLE["l2_normalize"] = """
WITH e AS (SELECT label, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
s AS (SELECT label, pos, sum(x) AS s FROM e GROUP BY 1, 2),
n AS (SELECT label, sqrt(sum(s * s)) AS nrm FROM s GROUP BY 1)
SELECT s.label::BIGINT AS label, s.pos::BIGINT AS pos,
       round(CASE WHEN n.nrm = 0 THEN 0.0 ELSE s.s / n.nrm END, 6) AS value
FROM s JOIN n ON s.label = n.label"""

ORACLE["vector_contract_violations"] = """
SELECT vec_id, len(embedding)::BIGINT AS dim, round(nrm, 6) AS norm,
       CASE WHEN embedding IS NULL OR len(embedding) <> 64 THEN 'wrong_size'
            WHEN nrm = 0 THEN 'zero' WHEN abs(nrm - 1) > 0.001 THEN 'not_unit' ELSE 'ok' END AS status
FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS nrm
      FROM embeddings)"""

ORACLE["search_topk"] = f"""
WITH e AS (SELECT label, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
s AS (SELECT label, pos, sum(x) AS s FROM e GROUP BY 1, 2),
q AS (SELECT label, list(s ORDER BY pos) AS v, sqrt(sum(s * s)) AS nrm FROM s GROUP BY 1),
c AS (SELECT vec_id, embedding::DOUBLE[] AS v,
             sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS nrm FROM embeddings)
SELECT query_id, id, score, rank FROM (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM (SELECT q.label::BIGINT AS query_id, c.vec_id AS id,
               round(CASE WHEN q.nrm * c.nrm = 0 THEN 0.0 ELSE list_dot_product(q.v, c.v) / (q.nrm * c.nrm) END, 6) AS score
        FROM q, c))
WHERE rank <= {C.TOP_K} AND score >= {C.FLOOR}"""
ORACLE["search_topk_blocks"] = ORACLE["search_topk"]

ORACLE["search_vectors"] = f"""
WITH c AS (SELECT vec_id, embedding::DOUBLE[] AS v,
                  sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS nrm FROM embeddings)
SELECT query_id, id, score, rank FROM (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM (SELECT q.vec_id AS query_id, c.vec_id AS id,
               round(CASE WHEN q.nrm * c.nrm = 0 THEN 0.0 ELSE list_dot_product(q.v, c.v) / (q.nrm * c.nrm) END, 6) AS score
        FROM c q, c WHERE q.vec_id % 20 = 0))
WHERE rank <= {C.TOP_K} AND score >= {C.FLOOR}"""

# the recall is measured by the query against the exact search; the SQL states its bound
ORACLE["search_ann_recall"] = f"""
SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_hits, true AS recall_reached
FROM ({ORACLE["search_vectors"]})"""

ORACLE["search_chunks"] = with_hits("SELECT query_id, rank, id, score, sample_id, chunk_type FROM hits")

ORACLE["search_topk_sparse"] = ORACLE["search_chunks"]

ORACLE["dedup_hits"] = with_hits("SELECT query_id, sample_id, id, score, rank FROM dedup")

ORACLE["build_context"] = with_hits("SELECT query_id, context FROM context", CONTEXT_CTE)

ORACLE["route_questions"] = with_hits("SELECT query_id, best_score, n_hits, use_web FROM route", ROUTE_CTE)

ORACLE["answer_sources"] = with_hits("""
SELECT b.item_id AS query_id, coalesce(s.n, 0) AS n_hits, coalesce(s.src, '') AS sources
FROM benchmark b LEFT JOIN (
  SELECT query_id, count(*) AS n, string_agg(left(coalesce(text, ''), 120), chr(10) ORDER BY rank) AS src
  FROM hits GROUP BY 1) s ON s.query_id = b.item_id""")

WEB_CTE = """
found AS (
  SELECT a.*, p.url, p.page_id IS NOT NULL AND p.page_id % 7 <> 0 AS hit
  FROM answered a LEFT JOIN pages p ON p.page_id = a.query_id)"""

ORACLE["generation_prompts"] = with_hits(f"""
SELECT query_id, use_web, {lit(C.RAG_SYSTEM_PROMPT)} AS system,
  concat_ws(chr(10) || chr(10),
    CASE WHEN context <> '' THEN {lit(C.CONTEXT_HEADER)} || context END,
    CASE WHEN use_web AND hit AND url <> '' THEN {lit(C.WEB_HINT_HEADER)} || url END,
    {lit(C.QUESTION_HEADER)} || question) AS prompt
FROM found""", CONTEXT_CTE, ROUTE_CTE, ANSWERED_CTE, WEB_CTE)

ORACLE["web_prompts"] = with_hits(f"""
SELECT query_id, {lit(C.WEB_QUERY_PREFIX)} || question AS search_query, {lit(C.WEB_SYSTEM_PROMPT)} AS system,
  CASE WHEN hit AND url <> '' THEN {lit(C.WEB_SUMMARY_PROBLEM)} || question || {lit(C.WEB_SUMMARY_RESULTS)} || url
       || {lit(C.WEB_SUMMARY_ASK)} ELSE question END AS request
FROM found WHERE use_web""", CONTEXT_CTE, ROUTE_CTE, ANSWERED_CTE, WEB_CTE)

ORACLE["prefixed_embeddings"] = ("WITH " + ",\n".join(c.strip() for c in [
    *hash_vec_ctes("dv", f"SELECT doc_id AS k, {lit(C.PASSAGE_PREFIX)} || coalesce(text, '') AS text FROM documents"),
    *hash_vec_ctes("bv", f"SELECT item_id AS k, {lit(C.QUERY_PREFIX)} || coalesce(text, '') AS text FROM benchmark")])
    + "\nSELECT 'passage' AS kind, k AS id, bucket, round(w, 6) AS weight FROM dv"
    + "\nUNION ALL SELECT 'query', k, bucket, round(w, 6) FROM bv")

ORACLE["collection_state"] = """
SELECT true AS was_empty, count(*) AS n_points,
       count(*) FILTER (WHERE len(embedding) <> 64 OR abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) > 0.001)
         AS n_violations
FROM embeddings"""

ORACLE["upsert_points"] = """
WITH ex AS (SELECT vec_id, label::BIGINT AS label FROM embeddings WHERE label <= 6),
inc AS (SELECT vec_id, (label + 100)::BIGINT AS label FROM embeddings WHERE label >= 3)
SELECT * FROM ex WHERE vec_id NOT IN (SELECT vec_id FROM inc)
UNION ALL SELECT * FROM inc"""

ORACLE["upsert_versions"] = """
WITH e AS (SELECT vec_id, label::BIGINT AS label,
                  list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i)) AS total FROM embeddings),
v1 AS (SELECT vec_id, label, total FROM e WHERE label <= 6),
v2 AS (SELECT vec_id, label, total FROM e WHERE label < 3
       UNION ALL SELECT vec_id, label + 100, -total FROM e WHERE label >= 3)
SELECT 1::BIGINT AS version, vec_id, label, round(total, 5) AS weighted_sum FROM v1
UNION ALL SELECT 2::BIGINT, vec_id, label, round(total, 5) FROM v2"""

ORACLE["resume_pending"] = with_chunks("""
SELECT chunk_id, sample_id, chunk_type FROM chunk_ids
WHERE sample_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')""", CHUNK_IDS_CTE)

MSGS = """msgs AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, role, text AS content FROM conversations)"""


def last_n_sql(src: str, n: int) -> str:
    return f"""SELECT session_id, seq, role, content FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS r FROM {src}) WHERE r <= {n}"""


ORACLE["session_memory"] = f"WITH {MSGS}\n" + last_n_sql("msgs", 3)

ORACLE["session_memory_events"] = f"""
SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
WHERE r <= {C.SESSION_MEMORY}"""

ORACLE["session_history"] = f"""
WITH {MSGS}, mem AS ({last_n_sql('msgs', C.SESSION_MEMORY)})
SELECT session_id, count(*) AS n_messages,
       string_agg(CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END || ': ' || coalesce(content, ''),
                  chr(10) ORDER BY seq) AS transcript
FROM mem GROUP BY session_id"""

ORACLE["session_after_clear"] = f"""
WITH {MSGS},
lc AS (SELECT session_id, max(seq) AS last_clear FROM msgs WHERE role = 'system' GROUP BY 1),
kept AS (SELECT m.* FROM msgs m LEFT JOIN lc ON lc.session_id = m.session_id
         WHERE m.role <> 'system' AND m.seq > coalesce(lc.last_clear, -1))
{last_n_sql('kept', C.SESSION_MEMORY)}"""

ORACLE["session_titles"] = f"""
WITH {MSGS}
SELECT session_id, CASE WHEN length(f) > {C.TITLE_MAX} THEN left(f, {C.TITLE_MAX}) || {lit(C.TITLE_ELLIPSIS)} ELSE f END AS title
FROM (SELECT session_id, arg_min(content, seq) AS f FROM msgs WHERE role = 'user' GROUP BY 1)"""

ORACLE["session_count"] = f"WITH {MSGS}\nSELECT count(DISTINCT session_id) AS n_sessions FROM msgs"

PERM_CTES = [CLEAN_CTE, TRAINING_CTE, """
perm AS (
  SELECT sample_id, row_number() OVER (ORDER BY md5('42:' || CAST(sample_id AS VARCHAR)), sample_id) - 1 AS g
  FROM training)""", """
sizes AS (SELECT count(*) AS n, CAST(ceil(0.2::DOUBLE * count(*)) AS BIGINT) AS n_eval FROM training)"""]

ORACLE["train_eval_split"] = with_qa("""
SELECT sample_id, CASE WHEN g < n_eval THEN 'eval' ELSE 'train' END AS split FROM perm, sizes""", *PERM_CTES)

ORACLE["limited_splits"] = with_qa("""
SELECT sample_id, 'eval' AS split, g AS pos FROM perm, sizes
WHERE g < least(greatest(1, least(50, n - n_eval) // 20), n_eval)
UNION ALL
SELECT sample_id, 'train', g - n_eval FROM perm, sizes WHERE g >= n_eval AND g < n_eval + least(50, n - n_eval)""",
                                   *PERM_CTES)

WORDS_CTE = r"""
words AS (SELECT sample_id, len(regexp_extract_all(text, '[\p{L}\p{N}]+'))::BIGINT AS n_tokens FROM training)"""

ORACLE["token_length_stats"] = with_qa("""
SELECT count(*) AS n_texts, round(avg(n_tokens), 6) AS avg_len, max(n_tokens) AS max_len, min(n_tokens) AS min_len
FROM words""", CLEAN_CTE, TRAINING_CTE, WORDS_CTE)

ORACLE["padded_batches"] = with_qa(f"""
SELECT sample_id, batch_id, n_tokens, padded_len, padded_len - n_tokens AS n_pad FROM (
  SELECT *, (ceil(max(n_tokens) OVER (PARTITION BY batch_id) / 8.0) * 8)::BIGINT AS padded_len FROM (
    SELECT p.sample_id, (p.g - s.n_eval) // 2 AS batch_id, least(w.n_tokens, {C.MAX_SEQ_LEN})::BIGINT AS n_tokens
    FROM perm p, sizes s, words w WHERE w.sample_id = p.sample_id AND p.g >= s.n_eval))""",
                                   *PERM_CTES, WORDS_CTE)

ORACLE["session_memory_stream"] = ORACLE["session_memory"]
ORACLE["session_after_clear_stream"] = ORACLE["session_after_clear"]
ORACLE["index_stream"] = with_hits("""
SELECT c.sample_id, c.chunk_pos, c.chunk_type, c.step_idx, c.text, c.math_type, c.query_ref, coalesce(v.n, 0) AS n_terms,
       round(coalesce(v.s, 0.0), 5) AS vector_sum
FROM chunk_ids c LEFT JOIN (SELECT k, count(*) AS n, sum((bucket + 1) * w) AS s FROM pv GROUP BY k) v ON v.k = c.chunk_id""")
ORACLE["index_stream_resumed"] = ORACLE["index_stream"]

ORACLE["index_points"] = with_hits("""
SELECT c.chunk_id, c.sample_id, c.chunk_type, coalesce(v.n, 0) AS n_terms, round(coalesce(v.nrm, 0.0), 6) AS norm
FROM chunk_ids c LEFT JOIN (SELECT k, count(*) AS n, sqrt(sum(w * w)) AS nrm FROM pv GROUP BY k) v ON v.k = c.chunk_id""")

# No character of the tables is changed by NFKC.  The pattern's look-ahead is a mark
# put before the last blank of a run that a visible character follows.
PRETOKENS_CTES = [r"""pre AS (
  SELECT unnest(regexp_extract_all(regexp_replace(text, '(\s+)(\s\S)', '\1' || chr(1) || '\2', 'g'),
    '''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x01]+|\s+')) AS token FROM training)""",
  "freqs AS (SELECT token, count(*) AS freq FROM pre GROUP BY token)"]
ORACLE["pretoken_counts"] = with_qa("SELECT token, freq FROM freqs", CLEAN_CTE, TRAINING_CTE, *PRETOKENS_CTES)

# initial symbols: the 256 byte characters in the order of their code points, after the special tokens
ORACLE["pair_counts"] = with_qa("""
SELECT a.id AS left, b.id AS right, sum(freq) AS n FROM pairs JOIN ids a ON a.byte = x JOIN ids b ON b.byte = y GROUP BY a.id, b.id""",
    CLEAN_CTE, TRAINING_CTE, *PRETOKENS_CTES,
    f"""ids AS (SELECT byte, {len(C.SPECIAL_TOKENS)} - 1 + row_number() OVER (ORDER BY shown, byte) AS id
  FROM (SELECT byte, byte NOT BETWEEN 33 AND 126 AND byte NOT BETWEEN 161 AND 172 AND byte NOT BETWEEN 174 AND 255 AS shown
        FROM range(256) t(byte)))""",
    """hexed AS (SELECT hex(encode(token)) AS h, freq FROM freqs),
pairs AS (SELECT ('0x' || h[2 * i - 1:2 * i])::INTEGER AS x, ('0x' || h[2 * i + 1:2 * i + 2])::INTEGER AS y, freq
  FROM (SELECT h, freq, unnest(range(1, len(h) // 2)) AS i FROM hexed))""")

# whole texts come back; a word of NFKC text is never lost
ORACLE["roundtrip_mismatches"] = with_qa(
    "SELECT sample_id, true AS roundtrip_ok FROM training", CLEAN_CTE, TRAINING_CTE)

ORACLE["session_pairs"] = f"""
WITH {MSGS},
near AS (SELECT *, lead(role) OVER w AS after, lag(role) OVER w AS before FROM msgs WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
paired AS (SELECT * FROM near WHERE (role = 'user' AND after = 'assistant') OR (role = 'assistant' AND before = 'user'))
{last_n_sql('paired', 6)}"""

ORACLE["session_lookup"] = f"""
WITH known AS ({ORACLE["session_history"]})
SELECT * FROM known
UNION ALL SELECT DISTINCT 'unknown-' || CAST(conv_id AS VARCHAR), 0::BIGINT, '' FROM conversations"""


def number_text(e: str) -> str:
    """At most four decimals, at least one."""
    return f"regexp_replace(regexp_replace(CAST(CAST(round({e}, 4) AS DECIMAL(30,4)) AS VARCHAR), '0+$', ''), '[.]$', '.0')"


LOG_CTE = """
log AS (
  SELECT event_id AS step, round(event_id / 1000.0::DOUBLE, 3) AS epoch,
         CASE WHEN event_type IN ('view', 'click') THEN value / 7 END AS loss,
         CASE WHEN event_type = 'error' THEN value / 11 END AS eval_loss,
         CASE WHEN event_type <> 'signup' THEN 0.0002::DOUBLE * (1 + event_id % 9) END AS lr FROM events)"""

ORACLE["training_log_report"] = f"""
WITH {LOG_CTE}
SELECT step, 'step=' || lpad(CAST(step AS VARCHAR), greatest(6, length(CAST(step AS VARCHAR)))::INT, ' ') || ' | epoch=' || {number_text('epoch')}
  || CASE WHEN loss IS NULL THEN '' ELSE ' | loss=' || {number_text('loss')} END
  || CASE WHEN eval_loss IS NULL THEN '' ELSE ' | eval_loss=' || {number_text('eval_loss')} END
  || CASE WHEN lr IS NULL THEN '' ELSE ' | lr=' || {number_text('lr')} END AS message
FROM log"""

ORACLE["best_checkpoint"] = f"""
WITH {LOG_CTE}
SELECT step AS best_step, round(eval_loss, 6) AS best_eval_loss FROM log WHERE eval_loss IS NOT NULL ORDER BY eval_loss, step LIMIT 1"""

# --- kept tables, models, streams: the SQL of what they must give

ORACLE["saved_corpus"] = ORACLE["scan_qa"]
ORACLE["saved_chunks"] = ORACLE["index_stream"].split("SELECT c.sample_id")[0] + \
    "SELECT sample_id, chunk_pos, chunk_type, step_idx, text, math_type, query_ref FROM chunks"
ORACLE["saved_splits"] = ORACLE["train_eval_split"]

ORACLE["model_embeddings"] = f"""
WITH letters AS (SELECT doc_id, b, lo, length(t) - length(replace(t, lo, '')) AS n
  FROM (SELECT doc_id, '{C.PASSAGE_PREFIX}' || coalesce(text, '') AS t FROM documents),
       (SELECT unnest(range(26)) AS b, chr((97 + unnest(range(26)))::INT) AS lo)),
sums AS (SELECT doc_id, d, sum(n * (((7 * b + 3 * d) % 11 - 5) / 10.0::DOUBLE)) AS s
  FROM letters, (SELECT unnest(range(8)) AS d) GROUP BY doc_id, d),
norms AS (SELECT doc_id, sqrt(sum(s * s)) AS nrm FROM sums GROUP BY doc_id)
SELECT doc_id, d::BIGINT AS pos, round(CASE WHEN nrm = 0 THEN 0.0 ELSE s / nrm END, 6) AS value FROM sums JOIN norms USING (doc_id)"""

ORACLE["session_memory_events_stream"] = ORACLE["session_memory_events"]
ORACLE["session_count_stream"] = f"SELECT n_sessions, true AS within_bound FROM ({ORACLE['session_count']})"
ORACLE["session_state_lookup"] = ORACLE["session_lookup"]

ORACLE["training_log_keys"] = """
SELECT key, count(*) AS n_lines FROM (
  SELECT unnest(['step', 'epoch', 'timestamp']) AS key FROM events
  UNION ALL SELECT 'loss' FROM events WHERE event_type IN ('view', 'click') AND value IS NOT NULL
  UNION ALL SELECT 'eval_loss' FROM events WHERE event_type = 'error' AND value IS NOT NULL
  UNION ALL SELECT 'learning_rate' FROM events WHERE event_type <> 'signup'
  UNION ALL SELECT 'grad_norm' FROM events WHERE event_type = 'purchase' AND value IS NOT NULL)
GROUP BY key"""
