"""DuckDB SQL for the registered queries that SQL can express on whole tables.

The others need a tokenizer, a classifier, a keyed permutation or a seeded hash that SQL
lacks; tests hold them against brute force.
"""

from __future__ import annotations

from talkgauge.llm.licenses import MIN_CONTAINMENT, SHINGLE, TEMPLATES
from talkgauge.llm.queries import URL_RULES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _values(rows) -> str:
    quote = lambda x: "'" + str(x).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, row)) + ")" for row in rows)


def _base32() -> str:
    """Base32 of the hexadecimal column ``hex``: each five digits hold four."""
    digits = []
    for start in range(1, 41, 5):
        number = f"CAST('0x' || substr(hex, {start}, 5) AS INTEGER)"
        digits += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({number} >> {shift}) & 31) + 1, 1)" for shift in (15, 10, 5, 0)]
    return " || ".join(digits)


OP2_URL_FILTERS = f"""
WITH parts AS (
  SELECT page_id, {_LOWER.format("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(rule_host, rule_path, action) AS (VALUES {_values(URL_RULES)}),
best AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(action, length(rule_host || rule_path)) AS action
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT parts.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)
"""

OP4_VECTOR_SEARCH = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP5_WARC = f"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
groups AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS response FROM payloads)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, {_base32()} AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM groups
"""

OP9_LICENSE_SCANS = f"""
WITH texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS words FROM documents),
docs AS (SELECT doc_id, ' ' || array_to_string(words, ' ') || ' ' AS whole FROM texts WHERE len(words) >= {SHINGLE}),
notices(template_id, notice) AS (VALUES {_values(sorted(TEMPLATES.items()))}),
split AS (
  SELECT template_id, list_filter(regexp_split_to_array({_LOWER.format("notice")}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS words FROM notices),
templates AS (
  SELECT template_id, list_distinct(list_transform(range(1, len(words) - {SHINGLE} + 2), lambda i: ' ' || array_to_string(words[i : i + {SHINGLE - 1}], ' ') || ' ')) AS shingles FROM split),
found AS (
  SELECT doc_id, template_id, CAST(len(shingles) AS INTEGER) AS n_shingles,
         CAST(len(list_filter(shingles, lambda s: contains(whole, s))) AS INTEGER) AS found_shingles
  FROM docs CROSS JOIN templates)
SELECT doc_id, template_id, n_shingles, found_shingles, found_shingles / n_shingles AS containment
FROM found WHERE found_shingles >= n_shingles * {MIN_CONTAINMENT}
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": OP2_URL_FILTERS, "op4_vector_search": OP4_VECTOR_SEARCH, "op5_warc": OP5_WARC, "op9_license_scans": OP9_LICENSE_SCANS}
