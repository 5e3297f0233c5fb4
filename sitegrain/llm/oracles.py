"""DuckDB SQL for the queries of this subpackage that SQL can express."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), h AS (
  SELECT page_id, octet_length(body) AS n, sha1(body) AS hex FROM p
), d AS (
  SELECT page_id, n, list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * i + 1, 5))::BIGINT >> s) & 31)::INT + 1, 1)), 'string_agg', '')), 'string_agg', '') AS digest
  FROM h
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY digest) AS top FROM d
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM g
"""

OP2 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), t AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s
), e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id AS a, doc_id AS c FROM documents
  UNION
  SELECT e.b, r.c FROM r JOIN e ON e.a = r.a
), m AS (
  SELECT a AS doc_id, min(c) AS component_id FROM r GROUP BY a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.component_id, m.component_id = s.doc_id AS kept FROM s JOIN m USING (doc_id)
"""

OP4 = rf"""
WITH b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all({LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), bw AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), d AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)
), f AS (
  SELECT doc_id, item, k, i FROM dw JOIN bw USING (k, g)
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM f) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM f) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_LUHN = "list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse({d})[i]::INT WHEN reverse({d})[i]::INT > 4 THEN reverse({d})[i]::INT * 2 - 9 ELSE reverse({d})[i]::INT * 2 END)) % 10 = 0"
_DIGITS = "regexp_replace({m}, '[^0-9]', '', 'g')"
_COMPACT = "replace({m}, ' ', '')"
_MOD97 = (
    "list_reduce(list_prepend(0::BIGINT, list_transform(string_split({c}[5:] || {c}[1:4], ''), lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN x::BIGINT ELSE ascii(x)::BIGINT - 55 END)),"
    " lambda a, x: CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END) = 1"
)


def _kind(k: int, name: str, pattern: str, valid: str, words: str, prior: float) -> str:
    """Rows (doc_id, k, kind, s, e, score) of a kind's valid matches; words within 32 characters raise the score."""
    near = " OR ".join(f"regexp_matches(lower({side}), '(?:^|[^a-z])(?:{words})')" for side in ("t[greatest(1, pos - 31):pos]", "t[pos + length(m) + 1:pos + length(m) + 32]"))
    return f"""
  SELECT doc_id, {k} AS k, '{name}' AS kind, pos AS s, pos + length(m) AS e, {prior} + CASE WHEN {near} THEN 0.3 ELSE 0.0 END AS score FROM (
    SELECT doc_id, t, parts[i] AS m, parts[i - 1] AS prev, coalesce(parts[i + 1], '') AS next, list_sum(list_transform(parts[1:i - 1], lambda x: length(x)))::BIGINT AS pos FROM (
      SELECT doc_id, t, parts, unnest(range(2, len(parts) + 1, 2)) AS i FROM (
        SELECT doc_id, t, string_split(regexp_replace(t, '({pattern})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts FROM d))) WHERE {valid}"""


OP9 = (
    "WITH d AS (SELECT doc_id, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents), m0 AS ("
    + " UNION ALL ".join([
        _kind(1, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", "mail|contact|write", 0.7),
        _kind(2, "ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: coalesce(try_cast(x AS BIGINT), 256) > 255)) = 0", "ip|host|server|address", 0.7),
        _kind(3, "card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS.format(m='m')}) BETWEEN 13 AND 19 AND {_LUHN.format(d=_DIGITS.format(m='m'))}", "card|visa|credit|payment", 0.7),
        _kind(4, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS.format(m='m')}) BETWEEN 9 AND 15", "phone|call|tel|mobile", 0.7),
        _kind(5, "iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", f"NOT regexp_matches(prev, '[A-Za-z0-9]$') AND length({_COMPACT.format(m='m')}) BETWEEN 15 AND 34 AND {_MOD97.format(c=_COMPACT.format(m='m'))}", "iban|account|bank", 0.7),
        _kind(6, "ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "NOT regexp_matches(prev, '-$') AND NOT regexp_matches(next, '^-')", "ssn|social security|tax id", 0.3),
    ])
    + """
), m AS (
  SELECT * FROM m0 WHERE score >= 0.5
), g AS (
  SELECT doc_id, count(*) FILTER (k = 1) AS n_email, count(*) FILTER (k = 2) AS n_ip, count(*) FILTER (k = 3) AS n_card, count(*) FILTER (k = 4) AS n_phone,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (k <= 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans,
    string_agg(printf('%.1f', score::DOUBLE), ',' ORDER BY k, s) AS scores
  FROM m GROUP BY doc_id
)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM documents LEFT JOIN g USING (doc_id)
"""
)

OP10 = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.n AS q, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.n <> c.n AND len(q.v) = len(c.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""

_TERMS = rf"regexp_extract_all({LOWER.format('text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12 = f"""
WITH t AS (
  SELECT r, doc_id, unnest({_TERMS}) AS term FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)
), d AS (
  SELECT r, any_value(doc_id) AS doc_id, count(*)::BIGINT AS n FROM t GROUP BY r
), c AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS len FROM d
), p AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM t GROUP BY r, term
), f AS (
  SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term
), i AS (
  SELECT DISTINCT q, item_id, unnest({_TERMS}) AS term FROM (SELECT row_number() OVER () AS q, item_id, text FROM benchmark)
), s AS (
  SELECT q, item_id, r, doc_id, sum(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // len))))::BIGINT AS score
  FROM i JOIN p USING (term) JOIN f USING (term) JOIN d USING (r), c GROUP BY q, item_id, r, doc_id
), k AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 10
"""

#: For pages whose one article holds headings, paragraphs, bold text and line breaks alone, as the tables' do.
_BLOCK = r'''trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?b>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))'''

OP13 = rf"""
WITH t AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform(
    regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>'), lambda x: {_BLOCK}), lambda x: x <> ''), chr(10)) AS text
  FROM pages
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
"""
