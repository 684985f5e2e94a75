"""DuckDB SQL for the queries of this subpackage that SQL can express.

Written from the contracts of the operators, over whole tables: plain grouping,
joins and recursion in place of runs, filters, signatures, cells and packages.
Token ids of tokenizer files (operators 2, 3 and 8) have no SQL form.
"""

from __future__ import annotations

from qaframe.llm.quality import BOILERPLATE, MENU_WORDS

SQL: dict[str, str] = {}

A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

def _strings(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


SQL["op1_quality_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, string_split(t, chr(10)) AS lines FROM d),
win AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
g AS (SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM win),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
line AS (SELECT r, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS x FROM w),
s AS (SELECT r, i, x, trim(x, {BLANKS}) AS s FROM line),
m AS (SELECT *, lower(s) AS low, len(regexp_extract_all(s, '[\x20\x09-\x0D]+')) + 1 AS n_words,
             len(regexp_extract_all(s, '[#*$%&|<>]')) AS symbols, len(regexp_extract_all(s, '[|»›•·]')) AS seps FROM s),
judged AS (SELECT r, i, x, s <> '' AND (
      symbols * 100 > length(s) * 10
   OR (seps >= 3 AND seps * 6 >= n_words)
   OR (n_words < 4 AND length(s) <= 40 AND NOT contains('.!?…:;。！？"”»' || chr(39) || ')]', right(s, 1)))
   OR low IN ({_strings(MENU_WORDS)})
   OR len(list_filter([{_strings(BOILERPLATE)}], lambda p: contains(low, p))) > 0
   OR (n_words >= 5 AND s = upper(s) AND s <> low)) AS fails FROM m),
per AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE fails) AS n_failed,
               coalesce(sum(length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))) FILTER (WHERE NOT fails), 0) AS kept_chars,
               count(*) FILTER (WHERE regexp_matches(x, '[^\x20\x09-\x0D]'))
               - count(DISTINCT x) FILTER (WHERE regexp_matches(x, '[^\x20\x09-\x0D]')) AS n_dup FROM judged GROUP BY r),
f AS (SELECT w.r, doc_id, len(words)::BIGINT AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, per.n_dup::BIGINT AS n_dup_lines,
             coalesce(covered.n, 0)::BIGINT AS n_repeat_words, per.n_lines, per.n_failed, per.kept_chars
      FROM w JOIN per ON per.r = w.r LEFT JOIN covered ON covered.r = w.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND kept_chars * 100 >= word_chars * 60 AS kept,
       n_lines::BIGINT AS n_lines, n_failed::BIGINT AS n_failed_lines,
       CASE WHEN word_chars > 0 THEN (kept_chars * 100 // word_chars)::BIGINT END AS kept_percent
FROM f"""

CLOSURE = """
walk AS (SELECT u AS node, v AS reached FROM links UNION SELECT v, u FROM links
         UNION SELECT walk.node, CASE WHEN links.u = walk.reached THEN links.v ELSE links.u END
         FROM walk JOIN links ON walk.reached IN (links.u, links.v)),
lowest AS (SELECT node, min(reached) AS reached FROM walk GROUP BY node)"""

SQL["op4_minhash_near_dedup"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {A_TO_Z}), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, words[i:i + 3] AS shingle
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id > b.doc_id
              GROUP BY 1, 2),
links AS (SELECT u, v FROM both_have JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v
          WHERE 100 * both_have.n >= 80 * (nu.n + nv.n - both_have.n)),
{CLOSURE}
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, lowest.reached) AS component_id,
       w.doc_id = least(w.doc_id, lowest.reached) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN lowest ON lowest.node = w.doc_id"""

SQL["op6_line_dedup"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT r, doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS x FROM d),
k AS (SELECT *, translate(trim(x, {BLANKS}), {A_TO_Z}) AS key FROM line),
held AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(held.key) FILTER (WHERE held.last <> k.doc_id)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE held.key IS NULL OR held.last = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN held ON held.key = k.key GROUP BY k.r, k.doc_id"""

CANON = r"""
 CASE WHEN {u} IS NOT NULL AND regexp_replace(regexp_replace({host}, '^www\.', ''), ':(80|443)?$', '') <> '' THEN
   regexp_replace(regexp_replace({host}, '^www\.', ''), ':(80|443)?$', '') || regexp_replace({path}, '/+$', '')
   || CASE WHEN len({params}) > 0 THEN '?' || array_to_string({params}, '&') ELSE '' END END"""
HOST = f"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {A_TO_Z})"
PATH = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
PARAMS = (r"list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'), "
          r"lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid|msclkid)(=|$)')))")

SQL["op7_url_filters"] = rf"""
WITH p AS (SELECT page_id, url, {HOST} AS host, {PATH} AS path, {PARAMS} AS params FROM pages),
c AS (SELECT *, {CANON.format(u='url', host='host', path='path', params='params')} AS canonical_url FROM p),
listed AS (SELECT DISTINCT canonical_url AS l FROM c WHERE canonical_url IS NOT NULL
           AND page_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
ruled AS (SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM c)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN l IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       canonical_url, rule IS NULL AND l IS NOT NULL AS listed
FROM ruled LEFT JOIN listed ON l = canonical_url"""

SQL["op9_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
firsts AS (SELECT h, min(page_id) AS page FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(p.h) AS payload_digest,
       CASE WHEN page <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page <> page_id THEN page END AS refers_to
FROM p LEFT JOIN firsts ON firsts.h = p.h"""

SQL["op10_embedding_near_dedup"] = f"""
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
ok AS (SELECT * FROM e WHERE n > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.vec_id > b.vec_id AND len(a.v) = len(b.v)
          AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.95),
{CLOSURE},
degree AS (SELECT x, count(*) AS n FROM (SELECT u AS x FROM links UNION ALL SELECT v FROM links) GROUP BY x)
SELECT vec_id, coalesce(degree.n, 0)::BIGINT AS n_links, least(vec_id, reached) AS component_id,
       vec_id = least(vec_id, reached) AS kept
FROM embeddings LEFT JOIN degree ON x = vec_id LEFT JOIN lowest ON node = vec_id"""

# the checksum is a fold over the bytes, with its table from the generator polynomial
SQL["op5_sharding"] = """
WITH RECURSIVE steps AS (
  SELECT b, 0 AS k, b::BIGINT AS c FROM range(256) r(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
poly AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
z AS (SELECT doc_id, (length(h) // 2 + 8)::BIGINT AS size,
             xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'),
                 lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]))) AS text_crc32
      FROM d, poly),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS start,
             sum(size) OVER () AS total FROM z),
s AS (SELECT *, least(23, ((2 * start + size) * 24 // (2 * total)))::INT AS shard FROM p)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY start) - 1)::BIGINT AS slot, NULL::INT AS grown_shard
FROM s"""


def _value(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_value, ["doc_id", "source", "lang", "n_chars", text])) + ")"


# crc32 of a decimal number, bit by bit over its digits
SQL["op13_merkle_manifest"] = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, {_leaf('text')}) AS r, *, {_leaf('text')} AS leaf FROM documents),
step(x, bit, c) AS (SELECT x, 0, x FROM range(256) t(x)
  UNION ALL SELECT x, bit + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE bit < 8),
crc(r, digits, c) AS (SELECT r, doc_id::VARCHAR, 4294967295 FROM d WHERE doc_id IS NOT NULL
  UNION ALL SELECT r, digits[2:], xor(crc.c >> 8, s.c) FROM crc JOIN step s ON s.bit = 8
    AND s.x = xor(crc.c, ascii(digits[1])) & 255 WHERE digits <> ''),
picked AS (SELECT r FROM crc WHERE digits = '' AND xor(c, 4294967295) % 2 = 0),
leaves AS (SELECT r, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g,
    row_number() OVER (PARTITION BY source ORDER BY r) - 1 AS pos, count(*) OVER (PARTITION BY source) AS cnt, leaf,
    CASE WHEN r IN (SELECT r FROM picked) THEN {_leaf("replace(text, chr(10), '')")} ELSE leaf END AS seen FROM d),
inner_tree(level, g, pos, cnt, h) AS (SELECT 0, g, pos, cnt, leaf FROM leaves
  UNION ALL SELECT any_value(level) + 1, g, pos // 3, (any_value(cnt) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos))
    FROM inner_tree WHERE cnt > 1 GROUP BY g, pos // 3),
subroots AS (SELECT g, h AS subroot, level AS height, count(*) OVER () AS n FROM inner_tree WHERE cnt = 1),
outer_tree(level, pos, cnt, h) AS (SELECT 0, g, n, subroot FROM subroots
  UNION ALL SELECT any_value(level) + 1, pos // 3, (any_value(cnt) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos))
    FROM outer_tree WHERE cnt > 1 GROUP BY pos // 3),
root AS (SELECT h AS root, level AS height FROM outer_tree WHERE cnt = 1),
nodes AS (SELECT level, g, pos, cnt, h, false AS above FROM inner_tree WHERE cnt > 1
  UNION ALL SELECT level, 0, pos, cnt, h, true FROM outer_tree WHERE cnt > 1),
siblings AS (SELECT a.level, a.g, a.pos, a.above, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.level = b.level AND a.g = b.g AND a.above = b.above AND a.pos // 3 = b.pos // 3
  GROUP BY a.level, a.g, a.pos, a.above),
walk(r, g, node, level, above, proof, h) AS (SELECT r, g, pos, 0, false, '', seen FROM leaves
  UNION ALL
  SELECT w.r, CASE WHEN s.level IS NULL THEN 0 ELSE w.g END, CASE WHEN s.level IS NULL THEN w.g ELSE w.node // 3 END,
    CASE WHEN s.level IS NULL THEN 0 ELSE w.level + 1 END, s.level IS NULL OR w.above,
    w.proof || coalesce(s.l || s.r, ''), CASE WHEN s.level IS NULL THEN w.h ELSE sha256(s.l || w.h || s.r) END
  FROM walk w LEFT JOIN siblings s ON s.level = w.level AND s.g = w.g AND s.pos = w.node AND s.above = w.above
  WHERE s.level IS NOT NULL OR NOT w.above),
done AS (SELECT r, proof, h FROM walk, root WHERE above AND level = root.height)
SELECT d.doc_id, d.leaf, s.subroot, root.root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = root.root AS verified
FROM d JOIN leaves USING (r) JOIN subroots s USING (g) JOIN done w USING (r), root
"""
