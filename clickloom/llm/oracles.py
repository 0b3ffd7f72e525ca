"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = f"regexp_extract_all({_LOWER.format('coalesce(text, \'\')')}, '[^\\x20\\x09-\\x0D]+')"
_ALNUM = f"regexp_extract_all({_LOWER.format('coalesce(text, \'\')')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP1 = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_SPACED} AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach AS (SELECT a AS u, a AS v FROM links UNION SELECT r.u, l.b FROM reach r JOIN links l ON r.v = l.a),
least AS (SELECT u, min(v) AS c FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, coalesce(l.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l ON l.u = d.doc_id
"""

OP2 = f"""
WITH dw AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
bw AS (SELECT item_id, {_ALNUM} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k,
    unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i+least(13, len(w))-1], ' '))) AS s
  FROM bw WHERE len(w) > 0),
lengths AS (SELECT DISTINCT k FROM windows),
places AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, lengths WHERE len(w) >= k),
occur AS (SELECT doc_id, p.k, i, item_id FROM places p JOIN windows x ON x.k = p.k AND x.s = array_to_string(p.w[p.i:p.i+p.k-1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM occur) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occur) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit h USING (doc_id) LEFT JOIN items t USING (doc_id)
"""

# DuckDB has no crc32, so here it is, bit by bit over the id's digits.
_BIT = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
_BYTE = f"list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: {_BIT})"
_DIGITS = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
_CRC32 = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_DIGITS}), lambda h, b: {_BYTE}), 4294967295)"
OP4 = f"""
WITH words AS (SELECT doc_id, {_CRC32} % 5 = 1 AS held_out, list_append({_SPACED}, chr(10)) AS w FROM documents),
places AS (SELECT doc_id, held_out, unnest(w) AS t, unnest(list_prepend(chr(9), w)[:len(w)]) AS h FROM words),
uni AS (SELECT t, count(*) AS c FROM places WHERE NOT held_out GROUP BY 1),
totals AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM uni),
bi AS (SELECT h, t, count(*) AS c FROM places WHERE NOT held_out GROUP BY 1, 2),
states AS (SELECT h, sum(c) AS c, count(*) AS followers FROM bi GROUP BY 1),
scored AS (
  SELECT p.doc_id, p.held_out, u.c AS known, (coalesce(u.c, 0) + 0.5::DOUBLE) / (n + 0.5::DOUBLE * (v + 1)) AS base, b.c AS arc, s.c AS state, s.followers
  FROM places p CROSS JOIN totals LEFT JOIN uni u ON u.t = p.t LEFT JOIN states s ON s.h = p.h LEFT JOIN bi b ON b.h = p.h AND b.t = p.t)
SELECT doc_id, held_out, count(*) AS n_tokens, count(known) AS n_known, CAST((SELECT n FROM totals) AS BIGINT) AS train_tokens,
  sum(log10(base)) AS base_score,
  sum(log10(CASE WHEN state IS NULL THEN base ELSE (greatest(coalesce(arc, 0) - 0.75::DOUBLE, 0) + 0.75::DOUBLE * followers * base) / state END)) AS score
FROM scored GROUP BY 1, 2
"""

_BITS = "array_to_string(list_transform(string_split(sha1(coalesce(html, '')), ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', (instr('0123456789abcdef', c) - 1) * 4 + 1, 4)), '')"
_BASE32 = f"""array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(5), lambda j: CAST(substr({_BITS}, CAST(i * 5 + j + 1 AS INT), 1) AS INT) << CAST(4 - j AS INT)))::INT, 1)), '')"""
OP5 = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f,
    row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS k FROM pages)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN f END AS refers_to FROM p
"""

_ESCAPED = "text"
for _plain, _safe in [("\\", "\\\\"), ("<|", "<\\|"), ("<s>", "<\\s>"), ("</s>", "<\\/s>"), ("[INST]", "[\\INST]"), ("[/INST]", "[\\/INST]"),
                      ("<<SYS>>", "<\\<SYS>>"), ("<</SYS>>", "<\\</SYS>>")]:
    _ESCAPED = f"replace({_ESCAPED}, '{_plain}', '{_safe}')"
OP8 = f"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, ['user', 'assistant'][i + 1], '</s>[INST] ok [/INST]' FROM range(2) t(i)),
packed AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS learned,
    sum(length('<|im_start|>') + length(role) + 1 + length({_ESCAPED}) + length('<|im_end|>') + 1) AS formatted
  FROM turns GROUP BY 1)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
  CAST(formatted AS BIGINT) AS formatted_chars FROM packed
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": OP1, "op2_decontaminate": OP2, "op4_lm_scores": OP4, "op5_warc": OP5, "op8_chat_format": OP8}
