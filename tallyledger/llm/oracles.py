"""DuckDB SQL for the queries that SQL can express, each written from the definition and not from the Spark plan."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x20\x09-\x0D]+"

OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
       FROM b, range(1, len(w) - least(len(w), 13) + 2) AS t(i) WHERE len(w) > 0),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM d, (SELECT DISTINCT n FROM bw) AS lengths, range(1, len(w) - n + 2) AS t(i) WHERE len(w) >= n),
hits AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM hits, range(i, i + n) AS t(p) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items,
                 array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM d, range(1, len(w) - 3) AS x(i) WHERE len(w) >= 5),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
repeated AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM twice, range(i, i + 5) AS x(p) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d),
s AS (SELECT d.r, doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d JOIN lines ON d.r = lines.r LEFT JOIN repeated ON d.r = repeated.r),
f AS (SELECT r, source, unnest([struct_pack(rule := 1, bad := n_words < 10),
                                struct_pack(rule := 2, bad := 100 * n_repeat_words > 20 * n_words),
                                struct_pack(rule := 3, bad := 10 * n_symbols > n_words),
                                struct_pack(rule := 4, bad := 5 * n_dup_lines > n_words)], recursive := true) FROM s),
c AS (SELECT source, rule, count(*) AS n, sum(bad::INT) AS k FROM f GROUP BY source, rule),
p AS (SELECT rule, sum(k) / sum(n) AS m, greatest(var_pop(k / n) - avg(k / n * (1 - k / n) / n), 1e-6) AS v FROM c GROUP BY rule),
q AS (SELECT rule, m, greatest(m * (1 - m) / v - 1, 1) AS z FROM p),
h AS (SELECT source, bool_and((k + m * z) / (n + z) < 0.6) AS host_ok FROM c JOIN q USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND host_ok AS kept
FROM s JOIN h ON s.source IS NOT DISTINCT FROM h.source
"""

OP9 = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest AND n >= 100
"""

OP10 = r"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'),
                            (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
e AS (SELECT *, length(text) + (length(text) - length(replace(text, '\', '')))
              + (length(text) - length(replace(text, '<|', ''))) // 2 AS size FROM m)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(12 + length(role) + 1 + size + 11) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS w FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, w FROM (
          SELECT DISTINCT item_id, regexp_extract_all({_LOWER}, '{_TERM}') AS w FROM benchmark) WHERE len(w) > 0),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
t AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
wanted AS (SELECT q, t, count(*) AS times FROM (SELECT q, unnest(w) AS t FROM b) GROUP BY q, t),
f AS (SELECT w.t, CAST(floor(1000 * ln((2 * max(n_docs) + 2) / (2 * count(r) + 1))) AS BIGINT) AS weight
      FROM (SELECT DISTINCT t FROM wanted) AS w LEFT JOIN t ON w.t = t.t, s GROUP BY w.t),
m AS (SELECT r, doc_id, 100 - 75 + (75 * len(w) * n_docs) // n_terms AS m FROM d, s WHERE len(w) > 0),
scored AS (SELECT q, doc_id, r, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
           FROM wanted JOIN f USING (t) JOIN t USING (t) JOIN m USING (r) GROUP BY q, doc_id, r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank
           FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN b USING (q) WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_benchmark_decontamination": OP2,
        "op8_quality_rules": OP8,
        "op9_warc": OP9,
        "op10_chat_formatting": OP10,
        "op11_lexical_search": OP11,
    }
