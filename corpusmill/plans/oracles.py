"""DuckDB SQL for the library's queries: other formulations of the same rules, for comparison."""

from __future__ import annotations

from ..config import SYSTEM_PROMPT
from .queries import CONVERSIONS, PARENS

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def body(x: str) -> str:
    lines = f"list_transform(string_split({x}, chr(10)), lambda x: {strip('x')})"
    short = f"CASE WHEN ends_with(x, '.') AND length(x) <= 30 THEN {strip(r"regexp_replace(x, '\.+$', '')")} ELSE x END"
    return f"array_to_string(list_filter(list_transform({lines}, lambda x: {short}), lambda x: x <> ''), chr(10) || chr(10))"


def size(x: str) -> str:
    return f"length(regexp_replace({x}, '{WS}', '', 'g'))"


INJECTED = """
  SELECT doc_id, lang, source, CASE doc_id % 10
    WHEN 0 THEN '#REDIRECT [[X]]' || chr(10) || text
    WHEN 1 THEN text || ' __NOTOC__'
    WHEN 2 THEN ' ' || chr(9) || chr(10) || ' '
    WHEN 3 THEN text || ' 可以指'
    WHEN 5 THEN '-{H|zh-cn:a;}-' || chr(10) || '#重定向 X' || chr(10) || text
    ELSE text END AS text
  FROM documents
"""
CLEANED = f"""
WITH i AS ({INJECTED}), b AS (
  SELECT *, {body(r"regexp_replace(text, '-\{[^{}|]*\|[^{}]*\}-', '', 'g')")} AS body FROM i
), c AS (
  SELECT doc_id, lang, source, body, CASE
    WHEN regexp_replace(text, '{WS}', '', 'g') = '' THEN 'empty'
    WHEN regexp_matches(text, '^{WS}*#(?i:REDIRECT|重定向)') THEN 'redirect'
    WHEN regexp_matches(body, '__[A-Z][A-Z0-9_]+__') THEN 'magic'
    WHEN regexp_matches(body, '^{WS}*#(?i:REDIRECT|重定向)') THEN 'late_redirect'
    WHEN contains(body, '可以指') AND {size("body")} < 200 THEN 'stub'
    WHEN {size("body")} < 50 THEN 'short'
    ELSE 'kept' END AS reason
  FROM b
)
"""
WIDE = "SELECT doc_id, source, lang, replace(translate(text, '.!?', '。！？'), chr(10), chr(10) || chr(10)) AS text FROM documents"
PARAS = """
  SELECT doc_id, source, unnest(list_filter(string_split(text, chr(10) || chr(10)), lambda x: x <> '')) AS para,
         generate_subscripts(list_filter(string_split(text, chr(10) || chr(10)), lambda x: x <> ''), 1) - 1 AS para_no
  FROM w
"""
SENTS = """
  SELECT doc_id, source, para_no, unnest(s) AS sent, generate_subscripts(s, 1) - 1 AS sent_no
  FROM (SELECT *, regexp_extract_all(para, '[^。！？]*[。！？]|[^。！？]+$') AS s FROM p)
"""


def chunked(source: str) -> str:
    """CTEs up to c(doc_id, source, chunk_index, overlap_len, text): packing as one recursion over pieces,
    assembly as another one over blocks."""
    return f"""
WITH RECURSIVE w AS ({source}), p AS ({PARAS}), s AS ({SENTS}), h AS (
  SELECT doc_id, source, para_no, sent_no, 0 AS part, sent AS piece, false AS hard FROM s WHERE length(sent) <= 550
  UNION ALL
  SELECT doc_id, source, para_no, sent_no, j AS part, substr(sent, (j * sz + 1)::BIGINT, sz::BIGINT), true
  FROM (SELECT *, ceil(length(sent) / ceil(length(sent) / 500.0))::INT AS sz, unnest(range(ceil(length(sent) / 500.0)::INT)) AS j
        FROM s WHERE length(sent) > 550)
), n AS (
  SELECT *, length(piece) AS len,
         row_number() OVER (PARTITION BY doc_id ORDER BY para_no, sent_no, part) AS k,
         coalesce(lead(para_no) OVER (PARTITION BY doc_id ORDER BY para_no, sent_no, part) <> para_no, true) AS para_end
  FROM h
), walk AS (
  SELECT doc_id, k, para_no, 0::BIGINT AS block, len AS size, NOT hard AND NOT (para_end AND len >= 450) AS open, hard FROM n WHERE k = 1
  UNION ALL
  SELECT n.doc_id, n.k, n.para_no,
         CASE WHEN n.hard OR NOT walk.open OR (walk.size >= 450 AND walk.size + (CASE WHEN n.para_no <> walk.para_no THEN 2 ELSE 0 END) + n.len > 550)
              THEN walk.block + 1 ELSE walk.block END,
         CASE WHEN n.hard OR NOT walk.open OR (walk.size >= 450 AND walk.size + (CASE WHEN n.para_no <> walk.para_no THEN 2 ELSE 0 END) + n.len > 550)
              THEN n.len ELSE walk.size + (CASE WHEN n.para_no <> walk.para_no THEN 2 ELSE 0 END) + n.len END AS size2,
         NOT n.hard AND NOT (n.para_end AND size2 >= 450), n.hard
  FROM walk JOIN n ON n.doc_id = walk.doc_id AND n.k = walk.k + 1
), last AS (
  SELECT doc_id, max(block) AS last_block FROM walk GROUP BY doc_id
), sized AS (
  SELECT doc_id, block, max(size) AS size, arg_max(open, k) AS open, arg_min(para_no, k) AS first_para, arg_max(para_no, k) AS last_para FROM walk GROUP BY doc_id, block
), tail AS (
  SELECT a.doc_id, a.block FROM sized a JOIN last l ON a.doc_id = l.doc_id AND a.block = l.last_block
  JOIN sized b ON b.doc_id = a.doc_id AND b.block = a.block - 1
  WHERE a.open AND a.size < 100 AND b.size + a.size + (CASE WHEN b.last_para <> a.first_para THEN 2 ELSE 0 END) <= 650
), placed AS (
  SELECT n.*, walk.block - (CASE WHEN tail.block IS NOT NULL THEN 1 ELSE 0 END) AS block
  FROM walk JOIN n USING (doc_id, k) LEFT JOIN tail ON tail.doc_id = walk.doc_id AND tail.block = walk.block
), para_text AS (
  SELECT doc_id, source, block, para_no, string_agg(piece, '' ORDER BY k) AS t FROM placed GROUP BY ALL
), bodies AS (
  SELECT doc_id, source, block, string_agg(t, chr(10) || chr(10) ORDER BY para_no) AS body, min(para_no) AS first_para, max(para_no) AS last_para
  FROM para_text GROUP BY ALL
), done AS (
  SELECT doc_id, source, block, last_para, 0::BIGINT AS overlap_len, body AS text FROM bodies WHERE block = 0
  UNION ALL
  SELECT b.doc_id, b.source, b.block, b.last_para,
         length(CASE WHEN length(d.text) <= 50 THEN ''
           WHEN length(regexp_extract(left(right(d.text, 101), length(right(d.text, 101)) - 50), '[^。！？\\n]*$')) < length(right(d.text, 101)) - 50
           THEN right(d.text, 50 + length(regexp_extract(left(right(d.text, 101), length(right(d.text, 101)) - 50), '[^。！？\\n]*$')))
           ELSE right(d.text, 50) END) AS o,
         (CASE WHEN o = 0 THEN '' ELSE right(d.text, o) END) || (CASE WHEN b.first_para <> d.last_para THEN chr(10) || chr(10) ELSE '' END) || b.body
  FROM done d JOIN bodies b ON b.doc_id = d.doc_id AND b.block = d.block + 1
), c AS (
  SELECT doc_id, source, block::INT AS chunk_index, overlap_len::INT AS overlap_len, text FROM done
)
"""


STATS = """
SELECT source AS {key}, count(*) FILTER (chunk_index = 0) AS docs, count(*) AS chunks, max(length(text))::BIGINT AS max_len,
       count(*) FILTER (length(text) > 550) AS over_max, round(count(*) / greatest(count(*) FILTER (chunk_index = 0), 1), 2) AS chunks_per_doc
FROM c GROUP BY source
"""
NORM = "sqrt(list_sum(list_transform({v}, lambda x: x::DOUBLE * x::DOUBLE)))"
SCORES = """
WITH q AS (SELECT vec_id AS query_id, embedding AS qv, label AS target_title FROM embeddings WHERE vec_id % 100 = 0),
s AS (
  SELECT query_id, target_title, vec_id, label, list_inner_product(qv::DOUBLE[], embedding::DOUBLE[]) AS score FROM q, embeddings
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
"""


def first(k: int, name: str) -> str:
    return f"""{name} AS (
  SELECT q.query_id, q.target_title, min(r.rank) AS first_rank
  FROM q LEFT JOIN r ON r.query_id = q.query_id AND r.rank <= {k + 1} AND r.vec_id <> r.query_id AND r.label = q.target_title
  GROUP BY ALL
)"""


METRICS = """count(*) AS n, round(avg(CASE WHEN first_rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_5,
  round(avg(CASE WHEN first_rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_10, round(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 6) AS mrr"""


def literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def cases(pairs) -> str:
    return "[" + ", ".join(literal(b) for _, b in pairs) + f"][(doc_id % {len(pairs)} + 1)::INT]"


LINES = """
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents
"""
KINDS = f"""
WITH l AS ({LINES}), t AS (
  SELECT doc_id AS page_id, pos, (doc_id + pos) % 6 AS k, CASE (doc_id + pos) % 6
    WHEN 0 THEN pos || '、' || line || '答案： yes' WHEN 1 THEN '答案:' || line
    WHEN 2 THEN '二、' || line WHEN 3 THEN '7. ' || line ELSE line END AS text
  FROM l
), q AS (
  SELECT *, regexp_matches(text, '^[0-9]+[、.]') AS is_q FROM t WHERE text <> ''
), k2 AS (
  SELECT *, CASE WHEN is_q THEN 'question' WHEN starts_with(text, '二、') THEN 'heading'
    WHEN starts_with(text, '答案:') AND coalesce(bool_or(is_q) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'answer'
    ELSE 'plain' END AS kind
  FROM q
)
SELECT page_id, pos::INT AS pos, kind,
  CASE WHEN is_q THEN regexp_extract(text, '^([0-9]+)', 1) END AS num,
  CASE WHEN is_q THEN {strip("string_split(regexp_replace(text, '^[0-9]+[、.]\\s*', ''), '答案：')[1]")} END AS question,
  CASE WHEN is_q THEN CASE WHEN contains(text, '答案：') THEN 'yes' ELSE '' END
       WHEN kind = 'answer' THEN {strip("substr(text, 4)")} END AS answer
FROM k2
"""

ORACLES = {
    "clean_lines": f"SELECT doc_id, {body('text')} AS body FROM documents",
    "eff_len": f"SELECT doc_id, {size('text')}::BIGINT AS eff_len FROM documents",
    "drop_reasons": CLEANED + "SELECT doc_id, reason FROM c",
    "drop_reason_counts": CLEANED + "SELECT reason, count(*) AS n FROM c GROUP BY reason",
    "clean_articles": CLEANED + f"SELECT doc_id::VARCHAR AS id, source AS title, {size('body')}::BIGINT AS n_chars, body AS text FROM c WHERE reason = 'kept'",
    "clean_stats": CLEANED + """SELECT lang, count(*) AS total, count(*) FILTER (reason = 'kept') AS kept, count(*) FILTER (reason <> 'kept') AS dropped,
      0::BIGINT AS badlines, round(count(*) FILTER (reason <> 'kept') / count(*), 6) AS drop_rate,
      count(*) FILTER (reason <> 'kept') / count(*) > 0.15 AS alarm FROM c GROUP BY lang""",
    "strip_tags": "SELECT page_id, regexp_replace(html, '<[^<>]{1,200}>', '', 'g') AS text FROM pages",
    "unescape_pages": """SELECT page_id, replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') AS html FROM pages""",
    "nfc_fold": "SELECT doc_id, nfc_normalize(replace(text, 'e', 'e' || chr(769))) || chr(10) || 'x' || chr(10) || 'y' AS text FROM documents",
    "conversion_markup": f"SELECT doc_id, {cases(CONVERSIONS)} || chr(10) || text AS text FROM documents",
    "invisible_parens": f"SELECT doc_id, {cases(PARENS)} || chr(10) || text AS text FROM documents",
    "truncate_long": f"""WITH r AS (SELECT doc_id, repeat(text, doc_id % 40 + 1) AS t FROM documents),
      c AS (SELECT doc_id, CASE WHEN length(t) > 50000 THEN regexp_replace(left(t, 50000), '{WS}+$', '') ELSE t END AS t FROM r)
      SELECT doc_id, length(t)::BIGINT AS n, md5(t) AS hash FROM c""",
    "paragraphs": f"WITH w AS ({WIDE}) SELECT doc_id, para_no::INT AS para_no, para FROM ({PARAS})",
    "sentences": f"WITH w AS ({WIDE}), p AS ({PARAS}) SELECT doc_id, para_no::INT AS para_no, sent_no::INT AS sent_no, sent FROM ({SENTS})",
    "hard_cut": """WITH n AS (SELECT doc_id, text, ceil(length(text) / 500.0)::INT AS n FROM documents WHERE length(text) > 0),
      s AS (SELECT *, ceil(length(text) / n::DOUBLE)::INT AS sz, unnest(range(n)) AS part FROM n)
      SELECT doc_id, part::INT AS part, substr(text, part * sz + 1, sz) AS piece FROM s""",
    "chunks": chunked(WIDE) + "SELECT 'wiki' || doc_id || '_c' || printf('%03d', chunk_index) AS chunk_id, doc_id::VARCHAR AS doc_id, source AS title, chunk_index, overlap_len, text FROM c",
    "chunk_stats": chunked(WIDE) + STATS.format(key="source"),
    "subset_first_n": "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 100",
    "l2_normalize": f"""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: (x * (vec_id % 7))::FLOAT) AS v FROM embeddings),
      n AS (SELECT vec_id, list_transform(v, lambda x: (x::DOUBLE / greatest({NORM.format(v="v")}, 1e-12))::FLOAT) AS u FROM s)
      SELECT vec_id, round({NORM.format(v="u")}, 4) AS norm FROM n""",
    "cosine_pairs": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "topk_single": "WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_inner_product(qv::DOUBLE[], embedding::DOUBLE[]), 4) AS score FROM q, embeddings ORDER BY list_inner_product(qv::DOUBLE[], embedding::DOUBLE[]) DESC, vec_id LIMIT 50",
    "topk_batch": SCORES + "SELECT query_id, vec_id, round(score, 4) AS score, rank FROM r WHERE rank <= 10",
    "reranked": SCORES + ", t AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY vec_id) AS rank FROM r WHERE rank <= 50) SELECT * FROM t WHERE rank <= 5",
    "self_check": """WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings ORDER BY vec_id LIMIT 3),
      s AS (SELECT query_id, vec_id, list_inner_product(qv::DOUBLE[], embedding::DOUBLE[]) AS score FROM q, embeddings)
      SELECT query_id, vec_id, round(score, 3) AS score, query_id = vec_id AND score > 0.999 AS passed FROM s
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) = 1""",
    "hit_mrr": SCORES + f", {first(50, 'f')} SELECT {METRICS} FROM f",
    "worst_cases": SCORES + f", {first(50, 'f')} SELECT query_id, target_title, first_rank FROM f ORDER BY first_rank DESC NULLS FIRST, query_id LIMIT 10",
    "ab_table": SCORES + f", {first(5, 'a')}, {first(50, 'b')} SELECT 'k5' AS variant, {METRICS} FROM a UNION ALL SELECT 'k50', {METRICS} FROM b",
    "eval_sample": "SELECT doc_id::VARCHAR AS id, source AS title FROM documents ORDER BY md5('0|' || doc_id), doc_id::VARCHAR LIMIT 60",
    "build_prompt": f"""WITH s AS (
        SELECT item_id, count(doc_id) AS n, string_agg('[来源' || (doc_id - item_id) || '] ' || source || chr(10) || left(d.text, 800), chr(10) || chr(10) ORDER BY doc_id) AS listed
        FROM benchmark b JOIN documents d ON d.doc_id BETWEEN b.item_id + 1 AND b.item_id + 5 GROUP BY item_id)
      SELECT b.item_id AS query_id, {literal(SYSTEM_PROMPT)} || chr(10) || chr(10) || coalesce(listed || chr(10) || chr(10), '') || '问题:' || b.text AS prompt, coalesce(n, 0) AS n_sources
      FROM benchmark b LEFT JOIN s USING (item_id)""",
    "token_counts": "SELECT doc_id, (4 + ceil(length(text) / 4.0))::BIGINT AS tokens FROM documents",
    "paragraph_kinds": KINDS,
    "image_urls": """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://img.example.com/' || page_id WHEN 1 THEN 'https://a.example/x.png'
      ELSE 'https://h.example/i/' || page_id || '.png' END AS url FROM pages""",
    "resume_antijoin": "SELECT doc_id::VARCHAR AS chunk_id FROM documents WHERE doc_id % 3 <> 0",
    "embed_documents": """WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents WHERE text <> ''),
      n AS (SELECT doc_id, unicode(c) % 64 AS k, count(*)::DOUBLE AS n FROM c GROUP BY ALL),
      v AS (SELECT doc_id, sum(n) / sqrt(sum(n * n)) AS total, max(n) / sqrt(sum(n * n)) AS peak FROM n GROUP BY doc_id)
      SELECT doc_id::VARCHAR AS chunk_id, 64::BIGINT AS dim, round(coalesce(total, 0), 3) AS total, round(coalesce(peak, 0), 3) AS peak FROM documents LEFT JOIN v USING (doc_id)""",
    "json_lines": "SELECT lang, count(*) AS total, count(*) FILTER (doc_id % 10 = 0) AS badlines, sum(CASE WHEN doc_id % 10 <> 0 THEN length(text) END)::BIGINT AS chars FROM documents GROUP BY lang",
    "text_hashes": "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents",
    "ordered_concat": f"SELECT doc_id, pos::INT AS pos, line FROM ({LINES}) WHERE trim(line) <> '' ORDER BY doc_id, pos",
    "clean_then_chunk": chunked(f"SELECT doc_id, lang AS source, body AS text FROM (SELECT doc_id, lang, {body("translate(text, '.!?', '。！？')")} AS body FROM documents) WHERE {size('body')} >= 50")
    + STATS.format(key="lang"),
    "human_sizes": """WITH n AS (SELECT doc_id, doc_id % 50 AS k, doc_id * 37 AS s FROM documents),
      u AS (SELECT *, ((k + 1) // 10)::INT AS i FROM n)
      SELECT doc_id, printf('%.1f ', 3 * pow(2, k - 10 * i)) || ['B', 'KiB', 'MiB', 'GiB', 'TiB', 'PiB'][i + 1] AS size,
        CASE WHEN s >= 3600 THEN printf('%dh%02dm%02ds', s // 3600, s % 3600 // 60, s % 60) WHEN s >= 60 THEN printf('%dm%02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS time FROM u""",
    "jsonl_round_trip": "SELECT doc_id::VARCHAR AS id, NULL::VARCHAR AS url, source AS title, md5(text) AS hash FROM documents",
    "merged_shards": "SELECT md5(line) AS line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '' GROUP BY line",
    "cleaned_shards": CLEANED + """, k AS (SELECT *, doc_id % 7 = 0 AS bad FROM c)
      SELECT count(*) AS total, count(*) FILTER (NOT bad AND reason = 'kept') AS kept, count(*) FILTER (NOT bad AND reason <> 'kept') AS dropped,
        count(*) FILTER (bad) AS badlines, sum(length(body)) FILTER (NOT bad AND reason = 'kept')::BIGINT AS chars FROM k""",
    "built_index": "SELECT vec_id, label::VARCHAR AS title, 'v' || vec_id AS text, len(embedding)::BIGINT AS width, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings",
    "row_counts": "SELECT count(*) FILTER (doc_id % 3 = 0) AS unwritten, count(*) FILTER (doc_id % 3 <> 0) AS lines FROM documents",
    "chunk_checks": chunked(WIDE) + """SELECT count(*) AS chunks, count(*) FILTER (overlap_len > 100) AS long_overlaps,
      count(*) FILTER (chunk_index = 0 AND overlap_len > 0) AS first_overlaps, 0::BIGINT AS lost FROM c""",
}
