"""DuckDB SQL for the queries of the engine, written apart from them.

Pieces of SQL are put together from small functions over expressions; every query starts
from the same common tables: ``u`` (pages' URLs in parts), ``l`` (their links), ``c`` (pages
under their canonical URL) and ``m`` (matches with the fixed templates).
"""

from __future__ import annotations

from ..functions import values
from .queries import FIXED_TEMPLATES, LINKS, ROOT, SAMPLES, SCATTERED

RX = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _in(items) -> str:
    return "(" + ", ".join(f"'{x}'" for x in items) + ")"


def part(u: str, g: int) -> str:
    return f"regexp_extract({u}, '{RX}', {g})"


def segs(path: str) -> str:
    return f"list_filter(string_split({path}, '/'), lambda x: x <> '')"


def normal(path: str) -> str:
    """Rooted paths without dots, empty segments and a slash at the end."""
    kept = f"list_transform(list_filter(string_split({path}, '/'), lambda x: x NOT IN ('', '.')), lambda x: [x])"
    return f"('/' || array_to_string(list_reduce(list_prepend([]::VARCHAR[], {kept}), lambda a, x: CASE WHEN x[1] = '..' THEN a[1:len(a) - 1] ELSE list_concat(a, x) END), '/'))"


def query_of(q: str, drop: bool) -> str:
    """A query's pairs, the first of each key, sorted and encoded anew."""
    decode = lambda x: f"url_decode(replace({x}, '+', ' '))"
    encode = lambda x: f"replace(url_encode({x}), '%20', '+')"
    pair = f"list_transform(list_filter(string_split({q}, '&'), lambda x: x <> ''), lambda x: {{'k': {decode(r"regexp_extract(x, '^([^=]*)', 1)")}, 'v': {decode(r"regexp_extract(x, '^[^=]*=(.*)$', 1)")}}})"
    keys = f"list_transform({pair}, lambda y: y.k)"
    once = f"list_filter({pair}, lambda x, i: list_position({keys}, x.k) = i)"
    if drop:
        once = f"list_filter({once}, lambda x: lower(x.k) NOT IN {_in(sorted(values.TRACKING_PARAMS))})"
    return f"array_to_string(list_transform(list_sort({once}), lambda x: {encode('x.k')} || '=' || {encode('x.v')}), '&')"


def asked(base: str, q: str) -> str:
    return f"({base}) || CASE WHEN ({q}) = '' THEN '' ELSE '?' || ({q}) END"


def port(host: str, scheme: str) -> str:
    return f"CASE WHEN {scheme} = 'http' THEN regexp_replace({host}, ':80$', '') WHEN {scheme} = 'https' THEN regexp_replace({host}, ':443$', '') ELSE {host} END"


def extension(text: str) -> str:
    return rf"regexp_extract(regexp_extract({text}, '([^/]*)$', 1), '(\.[^.]*)$', 1)"


def kind(s: str) -> str:
    """A segment's lexical type."""
    return rf"""CASE WHEN regexp_matches({s}, '(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$') THEN 'uuid'
      WHEN regexp_matches({s}, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN 'date' WHEN regexp_matches({s}, '^v\d+(\.\d+)*$') OR regexp_matches({s}, '^\d+(\.\d+)+$') THEN 'version'
      WHEN regexp_matches({s}, '^\d+$') THEN 'integer' WHEN regexp_matches({s}, '(?i)^[0-9a-f]{{8,}}$') THEN 'hash'
      WHEN regexp_matches({s}, '^[a-zA-Z_]\w*(\.[a-zA-Z_]\w*)+$') AND lower(regexp_extract({s}, '([^.]*)$', 1)) NOT IN {_in(values.FILE_EXTENSIONS)} THEN 'dotted_path'
      WHEN regexp_matches({s}, '(?i)^.+\.({'|'.join(values.PAGE_EXTENSIONS)})$') THEN 'filename' WHEN regexp_matches({s}, '^[A-Z][a-zA-Z0-9]*$') THEN 'camel_case'
      WHEN regexp_matches({s}, '^[a-z][a-z0-9]*(-[a-z0-9]+)+$') THEN 'slug' ELSE 'literal' END"""


def fits(s: str, t: str) -> str:
    inner = f"lower({t}[2:len({t}) - 1])"
    k = f"({kind(s)})"
    return f"""CASE WHEN {t} LIKE '<%>' THEN {k} = {inner} OR ({inner} IN ('filename', 'dotted_path') AND contains({s}, '.')) OR {inner} IN ('literal', 'unknown')
      OR ({inner} = 'slug' AND {k} IN ('literal', 'slug')) OR ({inner} = 'camel_case' AND {k} IN ('camel_case', 'literal'))
      OR ({inner} = 'version' AND {k} IN ('version', 'integer')) OR ({inner} = 'integer' AND {k} = 'version') ELSE lower({s}) = lower({t}) END"""


def internal(u: str) -> str:
    host = rf"regexp_replace(regexp_replace(lower({part(u, 3)}), ':[^:]*$', ''), '^www\.', '')"
    return f"({host} = '{ROOT}' OR ends_with({host}, '.{ROOT}'))"


def skip(u: str) -> str:
    path = f"lower({part(u, 4)})"
    bare = f"regexp_replace({path}, '/+$', '')"
    return f"(lower({part(u, 1)}) NOT IN ('http', 'https') OR {extension(bare)} IN {_in(values.SKIP_EXTENSIONS)} OR {bare} IN ('/feed', '/rss') OR contains({path}, '/feed/') OR contains({path}, '/rss/') OR contains({path}, '/wp-json/'))"


def asset(u: str) -> str:
    whole = f"regexp_replace(regexp_extract({u}, '(?s)^([^?#]*)', 1), '/+$', '')"
    return f"(lower({extension(whole)}) IN {_in(values.ASSET_EXTENSIONS)})"


def frontier(u: str) -> str:
    p = part(u, 4)
    return asked(f"lower({part(u, 1)}) || '://' || lower({part(u, 3)}) || CASE WHEN {p} = '' THEN '' ELSE {normal(p)} END", part(u, 5))


def unescape(t: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        t = f"replace({t}, '{entity}', '{char}')"
    return t


def attribute(tag: str, name: str) -> str:
    rx = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""
    return f"(CASE WHEN regexp_matches({tag}, '{rx}') THEN {unescape(' || '.join(f"regexp_extract({tag}, '{rx}', {i})" for i in (1, 2, 3)))} END)"


def canonical(u: str) -> str:
    scheme = f"lower({part(u, 1)})"
    return asked(f"{scheme} || '://' || {port(f'lower({part(u, 3)})', scheme)} || {normal(part(u, 4))}", query_of(part(u, 5), True))


def key(u: str) -> str:
    scheme, path = f"lower({part(u, 1)})", part(u, 4)
    return asked(f"{scheme} || '://' || {port(f'lower({part(u, 3)})', scheme)} || CASE WHEN {path} = '' THEN '/' ELSE {path} END", query_of(part(u, 5), False))


def dedup(table: str, by: str) -> str:
    """Least depth, then the longest text, then the first; in the place of the first."""
    return f"SELECT * EXCLUDE (seq, rn, first), first AS seq FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY depth, length(link_text) DESC, seq) AS rn, min(seq) OVER (PARTITION BY {by}) AS first FROM {table}) WHERE rn = 1"


def _text(fragment: str) -> str:
    """The pieces between tags, each without space around it, joined."""
    piece = unescape("x")
    return rf"array_to_string(list_transform(regexp_split_to_array({fragment}, '(?s)<[^>]*>'), lambda x: regexp_replace({piece}, '^\s+|\s+$', '', 'g')), '')"


_A = r"(?is)<a\s[^>]*>.*?</a>"
U = "u AS (SELECT page_id AS seq, url, url AS source_url, 0 AS depth, '' AS link_text FROM pages)"
L0 = f"""l0 AS (SELECT page_id, url, unnest(tags) AS tag, unnest(range(len(tags))) AS pos FROM (SELECT page_id, url, list_filter(regexp_extract_all(html, '{_A}'), lambda x: regexp_matches(x, '(?is)^<a\\s[^>]*\\bhref\\s*=')) AS tags FROM pages)),
l1 AS (SELECT page_id, url, pos, tag, trim({attribute("regexp_extract(tag, '(?is)^(<a[^>]*>)', 1)", "href")}) AS raw FROM l0),
l AS (SELECT page_id, pos, url AS source_url, raw, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || raw AS href, {_text('tag')} AS text,
  coalesce({attribute("regexp_extract(tag, '(?is)^(<a[^>]*>)', 1)", "rel")}, '') AS rel FROM l1 WHERE raw <> '' AND NOT regexp_matches(raw, '^(#|mailto:|tel:|javascript:|data:)'))"""
ALL = f"""{U}, {L0}, a AS (SELECT seq - (1::BIGINT << 62) AS seq, url, source_url, depth, link_text FROM u
  UNION ALL SELECT page_id * {LINKS} + pos, href, source_url, 1, text FROM l)"""
#: Versions after a language; both at the beginning of the path.
_V = "(?i)^(?:stable|dev|latest|master|main|v?\\d+(?:\\.\\d+)*)$"


def _canonical_of(table: str, name: str) -> str:
    s = segs("path")
    at = f"CASE WHEN lower({s}[1]) IN {_in(values.LANGUAGES)} AND len({s}) > 1 THEN 2 ELSE 1 END"
    versioned = f"coalesce(regexp_matches({s}[{at}], '{_V}'), false)"
    return f"""{name}1 AS ({dedup(f"(SELECT *, {key('url')} AS key FROM {table} WHERE NOT {asset('url')})", "key")}),
{name}2 AS ({dedup(f"(SELECT *, {canonical('key')} AS canonical_url FROM {name}1)", "canonical_url")}),
{name}3 AS (SELECT *, {part("canonical_url", 4)} AS path, {port(f"lower({part('url', 3)})", f"lower({part('url', 1)})")} AS domain, lower({part("url", 1)}) AS scheme FROM {name}2),
{name} AS (SELECT *, CASE WHEN {versioned} THEN {s}[{at}] END AS version, CASE WHEN {versioned} THEN '/' || array_to_string({s}[({at}) + 1:], '/') ELSE path END AS version_free_path FROM {name}3)"""


C = f"{U}, {_canonical_of('u', 'c')}"


def _specificity(pattern: str) -> tuple[int, int]:
    parts = pattern.strip("/").split("/")
    return -sum(not p.startswith("<") and p != "..." for p in parts), -len(parts)


_RANKED = sorted(FIXED_TEMPLATES, key=lambda t: _specificity(t[1]))
TPL = "t AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{p}', {k})" for k, (i, p) in enumerate(_RANKED)) + ") AS v(template_id, pattern, rank))"
M = f"""{C}, {TPL}, m0 AS (SELECT seq, canonical_url, template_id, rank, {segs("path")} AS s, {segs("pattern")} AS p FROM c, t),
m1 AS (SELECT *, coalesce(list_position(p, '...'), 0) AS w FROM m0),
m2 AS (SELECT *, unnest(range(1, greatest(1, CASE WHEN w > 0 THEN w - 1 ELSE len(p) END) + 1)) AS i FROM m1 WHERE CASE WHEN w > 0 THEN len(s) >= w - 1 ELSE len(s) = len(p) END),
m3 AS (SELECT seq, canonical_url, template_id, rank, bool_and(len(p) = 0 OR coalesce({fits("s[i]", "p[i]")}, false)) AS ok FROM m2 GROUP BY ALL),
m AS (SELECT seq, canonical_url, arg_min(template_id, rank) AS template_id FROM m3 WHERE ok GROUP BY seq, canonical_url)"""
SEGMENTS = f"""{ALL}, s AS (SELECT unnest({segs(f"CASE WHEN {part('url', 4)} = '' THEN '/' ELSE {part('url', 4)} END")}) AS raw FROM a UNION ALL SELECT * FROM (VALUES {", ".join(f"('{x}')" for x in SAMPLES)}))"""
PREFIX = f"""{C}, n0 AS (SELECT seq, {segs("path")} AS s FROM c), n1 AS (SELECT seq, len(s) AS n, s, unnest(range(len(s) + 1)) AS depth FROM n0),
n AS (SELECT seq, n, depth, array_to_string(s[1:depth], '/') AS prefix FROM n1),
k AS (SELECT prefix, depth, min(seq) AS first_seq, count(*) AS descendant_count, count(*) FILTER (n = depth) AS own_urls FROM n GROUP BY prefix, depth),
h AS (SELECT regexp_replace(prefix, '/?[^/]*$', '') AS prefix, count(*) AS child_count, avg(regexp_matches(regexp_extract(prefix, '([^/]*)$', 1), '^[a-z][a-z0-9_-]*$')::INT) AS r FROM k WHERE depth > 0 GROUP BY 1),
t AS (SELECT k.*, coalesce(child_count, 0) AS child_count, coalesce(r, 0.0) AS child_literal_ratio FROM k LEFT JOIN h USING (prefix))"""
DEEP = f"{C}, d AS (SELECT seq, list_prepend('site', {segs('path')}) AS s FROM c)"
FREQ = f"{DEEP}, f AS (SELECT i - 1 AS pos, raw, count(*) AS n, count(*) / (SELECT count(*) FROM d) AS freq FROM (SELECT unnest(s) AS raw, unnest(range(1, len(s) + 1)) AS i FROM d) WHERE i <= (SELECT min(len(s)) FROM d) GROUP BY ALL)"
_title = _text("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
RECORDS = f"""r AS (SELECT page_id, {_title} AS page_title, CASE page_id % 3 WHEN 0 THEN 'f(x)' WHEN 1 THEN 'fit(X, y)' END AS function_signature,
  CASE page_id % 5 WHEN 0 THEN ' N/A ' WHEN 1 THEN '' ELSE url END AS description, CASE WHEN page_id % 2 = 0 THEN '[]' END AS parameters FROM pages)"""


def scored(c: str, least: int) -> str:
    t = f"CASE WHEN trim({c}) IN ('[]', '{{}}') THEN '' ELSE trim({c}) END"
    return f"CASE WHEN {c} IS NULL THEN 'empty' WHEN {t} = '' THEN '{'ok' if not least else 'empty'}' WHEN lower({t}) IN {_in(values.GARBAGE)} THEN 'garbage' WHEN length({t}) < {least} THEN 'too_short' ELSE 'ok' END"


SCORES = f"{RECORDS}, sc AS (SELECT page_id, {', '.join(f'{scored(c, n)} AS {c}' for c, n in values.RECORD_FIELDS.items())} FROM r)"
_bad = " + ".join(f"({c} IN ('empty', 'garbage'))::INT" for c in values.RECORD_FIELDS)
_short = " + ".join(f"({c} = 'too_short')::INT" for c in values.RECORD_FIELDS)
VERDICT = f"{SCORES}, v AS (SELECT page_id, CASE WHEN {_bad} >= 2 THEN 'FAIL' WHEN {_bad} + {_short} = 0 THEN 'PASS' ELSE 'BORDERLINE' END AS verdict FROM sc)"


def _domain_kind() -> str:
    named = " ".join(f"WHEN lower(domain) IN {_in(hosts)} THEN '{name}'" for name, hosts in values.DOMAIN_KINDS.items())
    ends = " OR ".join(f"ends_with(lower(domain), '{e}')" for e in values.DOC_HOST_ENDINGS)
    signal = " OR ".join(f"contains(path, '{p}')" for p in values.DOC_PATH_SIGNALS)
    words = " OR ".join(f"contains(lower(domain), '{w}')" for w in values.DOC_HOST_SIGNALS)
    return f"CASE {named} WHEN {ends} OR bool_or({signal}) THEN 'documentation_crossref' WHEN bool_and(path IN ('', '/')) THEN 'project_homepage' WHEN {words} OR bool_or(length(path) - length(replace(path, '/', '')) >= 2) THEN 'documentation_crossref' ELSE 'unknown' END"


_meta = "list_filter(regexp_extract_all(html, '(?is)<meta[\\s>/][^>]*>'), lambda x: lower({a}) = '{n}')"
_links = "list_transform(regexp_extract_all(html, '(?is)<link[\\s>/][^>]*>'), lambda x: coalesce({a}, ''))"
_scripts = f"list_transform(regexp_extract_all(html, '(?is)<script[\\s>/][^>]*>'), lambda x: lower(coalesce({attribute('x', 'src')}, '')))"
_any = lambda listed, test: f"len(list_filter({listed}, lambda y: {test})) > 0"
_generator = f"coalesce({attribute(f'({_meta.format(a=attribute('x', 'name'), n='generator')})[1]', 'content')}, '')"
_hrefs, _rels = _links.format(a=attribute("x", "href")), _links.format(a=attribute("x", "rel"))
_root = "regexp_replace(url, '[?#].*$', '')"
_origin = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
_index = f"regexp_replace({_root}, '/+$', '') || '/search/search_index.json'"
SIGNALS = f"""kn AS (SELECT DISTINCT {frontier("f")} AS key FROM (SELECT unnest([CASE WHEN page_id % 3 = 0 THEN {_origin} || '/robots.txt' END, CASE WHEN page_id % 5 = 0 THEN {_origin} || '/objects.inv' END,
    CASE WHEN page_id % 7 = 0 THEN {_origin} || '/sitemap.xml' END, CASE WHEN page_id % 4 = 0 THEN {_index} END]) AS f FROM pages) WHERE f IS NOT NULL),
  wn AS (SELECT page_id, html, {_origin} || '/robots.txt' AS f1, {_origin} || '/objects.inv' AS f2, {_origin} || '/sitemap.xml' AS f3, {_index} AS f4 FROM pages),
  g AS (SELECT page_id, {frontier("f1")} IN (FROM kn) AS has_robots_txt, {frontier("f2")} IN (FROM kn) AS has_objects_inv, {frontier("f3")} IN (FROM kn) AS has_sitemap, {frontier("f4")} IN (FROM kn) AS has_search_index,
  {_generator} AS meta_generator, {_any(_hrefs, "contains(y, '/_static/') OR starts_with(y, '_static/')")} AS static_dir,
  {_any(_hrefs, "contains(y, '/assets/') OR starts_with(y, 'assets/')")} AS assets_dir, {_any(_hrefs, "contains(y, '.vuepress')")} AS vuepress_dir,
  {_any(_scripts, "contains(y, 'docusaurus')")} AS docusaurus_detected, {_any(_scripts, "contains(y, 'mkdocs')")} AS mkdocs_detected, {_any(_scripts, "contains(y, 'searchtools.js')")} AS sphinx_searchtools,
  {_any(_rels, "list_contains(string_split(y, ' '), 'canonical')")} AS has_canonical, contains(html, 'wy-grid-for-nav') AS rtd_theme, contains(html, 'md-container') AS mkdocs_material, contains(lower(html), 'docusaurus') AS docusaurus_in_html FROM wn)"""


_MADE = "CASE WHEN seq % 5 = 0 THEN '/_sources' || path WHEN seq % 3 = 0 THEN '/modules/generated' || path ELSE path END"


def _generator_sql() -> str:
    scores = ", ".join(
        f"greatest(0.0, {', '.join(f'CASE WHEN count(*) FILTER (contains(lower(p), {chr(39)}{piece}{chr(39)})) > {more} THEN {value} ELSE 0.0 END' for n, piece, more, value in values.GENERATOR_PATHS if n == g)}) AS {g}" for g in values.GENERATORS
    )
    names = " ".join(f"WHEN {g} = top THEN '{g}'" for g in values.GENERATORS)
    return f"WITH {C}, x AS (SELECT {scores} FROM (SELECT {_MADE} AS p FROM c)), y AS (SELECT *, greatest({', '.join(values.GENERATORS)}) AS top FROM x) SELECT CASE WHEN top >= 0.3 THEN CASE {names} END END AS generator, CASE WHEN top >= 0.3 THEN top ELSE 0.0 END::DOUBLE AS confidence FROM y"


#: Rounds of extraction: every page's verdict in each, and the first round that takes it.
_round = lambda t: f"""SELECT page_id, {t} AS round, page_title, function_signature, CASE WHEN page_id % 2 = 0 AND {t} = 0 THEN 'N/A' ELSE 'see ' || url END AS description, CASE WHEN page_id % 5 <> 0 OR {t} = 2 THEN '[]' END AS parameters FROM r JOIN pages USING (page_id)"""


def _healed(accept: bool) -> str:
    kinds = "v = 'PASS' OR (v = 'BORDERLINE' AND function_signature IS NOT NULL)" if accept else "v = 'PASS'"
    scores = ", ".join(f"{scored(c, n)} AS s_{c}" for c, n in values.RECORD_FIELDS.items())
    bad = " + ".join(f"(s_{c} IN ('empty', 'garbage'))::INT" for c in values.RECORD_FIELDS)
    short = " + ".join(f"(s_{c} = 'too_short')::INT" for c in values.RECORD_FIELDS)
    return f"""{M}, {RECORDS}, w AS (SELECT * FROM m JOIN (SELECT seq, url FROM c) USING (seq) WHERE template_id <> 't4'), x0 AS ({" UNION ALL ".join(_round(t) for t in range(3))}),
x1 AS (SELECT *, {scores} FROM x0), x2 AS (SELECT *, CASE WHEN {bad} >= 2 THEN 'FAIL' WHEN {bad} + {short} = 0 THEN 'PASS' ELSE 'BORDERLINE' END AS v FROM x1),
x3 AS (SELECT * FROM x2 WHERE {kinds} QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY round) = 1),
dn AS (SELECT template_id, seq, url, round, v AS verdict, page_title, function_signature, description, parameters FROM w JOIN x3 ON seq = page_id), ls AS (SELECT template_id, seq, url FROM w WHERE seq NOT IN (SELECT seq FROM dn))"""


_data = "'{' || concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN '\"{c}\":' || to_json({c})::VARCHAR END" for c in ("page_title", "function_signature", "description", "parameters")) + ") || '}'"
#: Lines of documents: section, key (of the order in it) and line; a comma stands before each element of a list but the first.
_numbered = "SELECT section, row_number() OVER (PARTITION BY section ORDER BY a, b, c) - 1 AS seq, line FROM x"
_line = lambda section, text: f"SELECT '{section}' AS section, '' AS a, 0 AS b, 0::BIGINT AS c, '{text}' AS line"
_DOCUMENT = f"""WITH {_healed(True)}, t2 AS (SELECT DISTINCT template_id FROM w), f AS (SELECT template_id, min(seq) AS first FROM dn GROUP BY 1), x AS (
  SELECT '00-head' AS section, '' AS a, 0 AS b, 0::BIGINT AS c, '{{"domain":"{ROOT}","total_processed":' || (SELECT count(*) FROM w) || ',"total_healed":' || (SELECT count(*) FROM dn WHERE round > 0) || ',"failed":' || (SELECT count(*) FROM ls) || ',"results":{{' AS line
  UNION ALL SELECT '01-results', template_id, 0, 0, CASE WHEN template_id = (SELECT min(template_id) FROM t2) THEN '' ELSE ',' END || to_json(template_id)::VARCHAR || ':[' FROM t2
  UNION ALL SELECT '01-results', template_id, 1, seq, CASE WHEN seq = first THEN '' ELSE ',' END || '{{"url":' || to_json(url)::VARCHAR || ',"status":"extracted","data":' || {_data} || '}}' FROM dn JOIN f USING (template_id)
  UNION ALL SELECT '01-results', template_id, 2, 0, ']' FROM t2
  UNION ALL {_line("02-then", '}},"failed_urls":['.replace("}}", "}"))}
  UNION ALL SELECT '03-failed_urls', template_id, 0, seq, CASE WHEN (template_id, seq) = (SELECT min((template_id, seq)) FROM ls) THEN '' ELSE ',' END || '{{"url":' || to_json(url)::VARCHAR || ',"template_id":' || to_json(template_id)::VARCHAR || '}}' FROM ls
  UNION ALL {_line("04-end", "]}")}) {_numbered}"""
_LINK = """'{"url":' || to_json(url)::VARCHAR || ',"source_url":' || to_json(source_url)::VARCHAR || ',"depth":' || depth || ',"link_text":' || to_json(link_text)::VARCHAR || '}'"""
_listed = lambda section, rows: f"SELECT '{section}', '', 0, seq, CASE WHEN seq = (SELECT min(seq) FROM {rows}) THEN '' ELSE ',' END || {_LINK} FROM {rows}"
_head = f'{{"crawl_id":"crawl_1","root_domain":"{ROOT}","root_urls":["https://{ROOT}/"],"signals":{{"has_objects_inv":"false"}},"internal_urls":['
_CRAWL = f"""WITH {U}, i AS (SELECT * FROM u WHERE {internal('url')}), o AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY lower({part('url', 3)}) ORDER BY seq) AS k FROM u WHERE NOT {internal('url')}) WHERE k <= 50 ORDER BY seq LIMIT 500),
  x AS ({_line("00-head", _head)} UNION ALL {_listed("01-internal_urls", "i")} UNION ALL {_line("02-then", '],"external_urls":[')} UNION ALL {_listed("03-external_urls", "o")} UNION ALL {_line("04-end", "]}")}) {_numbered}"""


_scheme, _path = f"lower({part('url', 1)})", f"CASE WHEN {part('url', 4)} = '' THEN '/' ELSE {part('url', 4)} END"
_host = port(f"lower({part('url', 3)})", _scheme)
_kinds = ", ".join(f"('<{k}>')" for k in ("filename", "dotted_path", "literal", "unknown", "slug", "camel_case", "version", "integer", "hash")) + ", ('INDEX.html')"
_first_key = lambda src, columns: f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS rn FROM ({src})) WHERE rn = 1"
_cap = f"SELECT seq, url, row_number() OVER (PARTITION BY lower({part('url', 3)}) ORDER BY seq) AS k FROM u"
_edges = "e AS (SELECT src, dst, pos FROM (SELECT page_id AS src, unnest([2 * page_id + 1, 2 * page_id + 2, page_id // 3]) AS dst, unnest([0, 1, 2]) AS pos FROM pages) WHERE dst IN (SELECT page_id FROM pages))"
#: Nodes with their first way from the seed: of the shortest ones, the first by the places of its links.
_WAYS = f"""RECURSIVE {_edges}, b AS (SELECT 5::BIGINT AS node, 0 AS depth, []::INT[] AS way, NULL::BIGINT AS parent WHERE 5 IN (SELECT page_id FROM pages)
  UNION ALL SELECT e.dst, b.depth + 1, list_append(b.way, e.pos), b.node FROM b JOIN e ON e.src = b.node WHERE b.depth < 3),
f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY node ORDER BY depth, way) = 1)"""

_last = "regexp_extract(prefix, '([^/]*)$', 1)"
_parent = "regexp_replace(prefix, '/?[^/]*$', '')"
SECTIONS = "(SELECT * REPLACE (CASE seq % 4 WHEN 0 THEN '/guide' || path WHEN 1 THEN '/api/generated' || path WHEN 2 THEN path ELSE '/user_guide/' || seq % 7 || '.html' END AS path) FROM c)"
_SCATTERED = f"(SELECT * REPLACE ({SCATTERED} AS path) FROM c)"
GROUPS = f"""{PREFIX.replace("FROM c)", f"FROM {SECTIONS})")}, sec AS (SELECT {_parent} AS prefix, count(*) AS sections, max(child_literal_ratio) AS most, min((child_count > 0)::INT) AS lo, max((child_count > 0)::INT) AS hi
    FROM t WHERE depth > 0 AND descendant_count >= 3 AND {kind(_last)} IN ('literal', 'slug') GROUP BY 1),
sp AS (SELECT t.prefix, t.child_count, coalesce((sections >= 2 AND NOT (most < 0.5 AND lo = hi)) OR (sections = 1 AND child_count > 1), false) AS splits FROM t LEFT JOIN sec USING (prefix)),
own AS (SELECT seq, max(n) AS n, arg_min(prefix, depth) FILTER (NOT splits) AS prefix, arg_min(child_count, depth) FILTER (NOT splits) AS kids FROM n JOIN sp USING (prefix) GROUP BY seq),
big AS (SELECT prefix FROM own WHERE kids > 0 GROUP BY prefix HAVING count(*) >= 3),
grp0 AS (SELECT seq, n, CASE WHEN kids > 0 AND prefix IN (FROM big) THEN '/' || prefix END AS g FROM own),
far AS (SELECT n FROM grp0 WHERE g IS NULL GROUP BY n HAVING count(*) >= 3),
grp AS (SELECT seq, coalesce(g, 'depth_' || n) AS group_prefix, g IS NULL AS late FROM grp0 WHERE g IS NOT NULL OR n IN (FROM far))"""
LATE = GROUPS.replace(SECTIONS, _SCATTERED)
DERIVED = f"""{GROUPS}, mem AS (SELECT group_prefix, seq, canonical_url, version, {segs("path")} AS s FROM grp JOIN {SECTIONS} USING (seq)),
bnd AS (SELECT group_prefix, count(*) AS member_count, min(len(s)) AS lo, max(len(s)) AS hi, array_to_string((list(canonical_url ORDER BY seq))[1:5], '|') AS examples FROM mem GROUP BY 1),
val AS (SELECT group_prefix, seq, i, s[i] AS raw FROM (SELECT group_prefix, seq, s, unnest(range(1, lo + 1)) AS i FROM mem JOIN bnd USING (group_prefix))),
cnt AS (SELECT group_prefix, i, raw, count(*) AS n, min(seq) AS f FROM val GROUP BY ALL),
knd AS (SELECT group_prefix, i, {kind("raw")} AS k, count(*) AS n, min(seq) AS f FROM val GROUP BY ALL),
pos AS (SELECT a.group_prefix, a.i, d, CASE WHEN d = 1 OR (d <= 3 AND top / total >= 0.75) THEN raw ELSE '<' || k || '>' END AS part, CASE WHEN d = 1 OR (d <= 3 AND top / total >= 0.75) THEN upper(raw) ELSE k END AS print
  FROM (SELECT group_prefix, i, count(*) AS d, sum(n) AS total, max(n) AS top, first(raw ORDER BY n DESC, f) AS raw FROM cnt GROUP BY ALL) a JOIN (SELECT group_prefix, i, first(k ORDER BY n DESC, f) AS k FROM knd GROUP BY ALL) b USING (group_prefix, i)),
tail AS (SELECT group_prefix, min(t) AS lo_t, max(t) AS hi_t FROM (SELECT group_prefix, array_to_string(s[lo + 1:], '/') AS t FROM mem JOIN bnd USING (group_prefix) WHERE len(s) > lo) GROUP BY 1),
der AS (SELECT group_prefix, member_count, examples, '/' || concat_ws('/', string_agg(part, '/' ORDER BY i), CASE WHEN any_value(lo_t) IS NULL THEN NULL WHEN any_value(lo_t) = any_value(hi_t) THEN any_value(lo_t) ELSE '...' END) AS pattern,
  concat_ws('/', string_agg(print, '/' ORDER BY i), CASE WHEN any_value(lo_t) IS NULL THEN NULL WHEN any_value(lo_t) = any_value(hi_t) THEN 'STATIC_DEEP' ELSE 'DEEPER' END) AS fingerprint,
  greatest(0.1, least(1.0, least(member_count / 50, 1.0) * 0.25 + count(*) FILTER (d = 1) / greatest(any_value(lo), 1) * 0.5 + CASE WHEN group_prefix IN ('', '/') OR starts_with(group_prefix, '/<') THEN 0.0 ELSE 0.15 END + 0.15)) AS confidence
  FROM bnd LEFT JOIN pos USING (group_prefix) LEFT JOIN tail USING (group_prefix) GROUP BY group_prefix, member_count, examples)"""
_names = " ".join(f"WHEN contains(lower(group_prefix), '{piece}') THEN '{name}'" for piece, name in values.TEMPLATE_NAMES)
_words = "list_filter(string_split(lower(group_prefix), '/'), lambda x: x <> '' AND NOT starts_with(x, '<') AND NOT starts_with(x, 'depth_'))"
_fit = "child_literal_ratio < 0.3 AND descendant_count >= 3 AND child_count > 0"
#: Anchors from the deepest level up; the pages' paths have few levels.
ANCHORS = PREFIX + "".join(
    f", a{d} AS (SELECT prefix, depth, descendant_count FROM t WHERE {_fit} AND depth = {d}" + (f" AND prefix NOT IN (SELECT {_parent} FROM a{d + 1})" if d < 6 else "") + ")" for d in range(6, -1, -1)
)
_canonical_tag = f"(list_filter(regexp_extract_all(html, '(?is)<link[\\s>/][^>]*>'), lambda x: list_contains(string_split(coalesce({attribute('x', 'rel')}, ''), ' '), 'canonical')))[1]"
_charset_tag = "(list_filter(regexp_extract_all(html, '(?is)<meta[\\s>/][^>]*>'), lambda x: regexp_matches(x, '(?i)\\scharset\\s*=')))[1]"
_content = lambda n, a="name": f"coalesce({attribute(f'({_meta.format(a=attribute(chr(120), a), n=n)})[1]', 'content')}, '')"

ORACLE_SQL = {
    "html_metadata": f"""SELECT page_id, {_title} AS title, {_content("generator")} AS generator, {_content("description")} AS description, coalesce({attribute(_canonical_tag, "href")}, '') AS canonical_url,
      coalesce({attribute(_charset_tag, "charset")}, nullif(trim(regexp_extract(lower({_content("content-type", "http-equiv")}), 'charset=(.*)$', 1)), ''), 'utf-8') AS charset FROM pages""",
    "html_link_tags": f"SELECT page_id, 0 AS pos, {_origin} || '/c' || page_id || '?a=1&b' AS href, 'canonical' AS rel FROM pages UNION ALL SELECT page_id, 1, 'https://cdn.example.com/s.css', 'stylesheet' FROM pages",
    "anti_unassigned": f"WITH {LATE} SELECT seq, path FROM {_SCATTERED} WHERE seq NOT IN (SELECT seq FROM grp)",
    "group_discover": f"WITH {GROUPS} SELECT seq, group_prefix FROM grp",
    "group_remaining_by_depth": f"WITH {LATE} SELECT group_prefix, count(*) AS n FROM grp WHERE late GROUP BY 1",
    "tpl_derive": f"WITH {DERIVED} SELECT group_prefix, pattern, fingerprint, member_count FROM der",
    "tpl_confidence": f"WITH {DERIVED} SELECT group_prefix, round(confidence, 9)::DOUBLE AS confidence FROM der",
    "tpl_name": f"WITH {DERIVED} SELECT group_prefix, CASE {_names} WHEN contains(lower(pattern), 'generated') THEN 'api_reference' ELSE coalesce({_words}[1], 'catch_all') END AS name FROM der",
    "topk_examples": f"WITH {DERIVED} SELECT group_prefix, examples FROM der",
    "trie_anchors": f"WITH {ANCHORS} " + " UNION ALL ".join(f"SELECT prefix, depth::INT AS depth, descendant_count FROM a{d}" for d in range(7)),
    "url_parse": f"WITH {U} SELECT seq, {_scheme} AS scheme, {_host} AS host, {_path} AS path, {query_of(part('url', 5), False)} AS query, nullif({part('url', 6)}, '') AS fragment FROM u",
    "url_build_parsed": f"WITH {U} SELECT seq, {key('url')} AS key, {_host} AS domain, {_path} AS path, {asset('url')} AS is_asset FROM u",
    "url_canonicalize": f"WITH {U} SELECT seq, {canonical('url')} AS canonical_url FROM u",
    "url_normalize_frontier": f"WITH {U} SELECT seq, {frontier('url')} AS key FROM u",
    "url_split_segments": f"WITH {U} SELECT seq, len({segs(part('url', 4))})::INT AS n, array_to_string({segs(part('url', 4))}, '|') AS segments FROM u",
    "url_is_asset": f"WITH {ALL} SELECT seq, {asset('url')} AS is_asset FROM a",
    "url_extract_version": f"WITH {U}, p AS (SELECT seq, {_path} AS path FROM u), q AS (SELECT seq, path, {segs('path')} AS s FROM p), r AS (SELECT *, CASE WHEN lower(s[1]) IN {_in(values.LANGUAGES)} AND len(s) > 1 THEN 2 ELSE 1 END AS i FROM q) SELECT seq, CASE WHEN regexp_matches(s[i], '{_V}') THEN s[i] END AS version, CASE WHEN regexp_matches(s[i], '{_V}') THEN '/' || array_to_string(s[i + 1:], '/') ELSE path END AS version_free_path FROM r",
    "apply_version": f"WITH {C} SELECT seq, canonical_url, version, version_free_path FROM c",
    "url_root_domain": f"WITH {U} SELECT seq, regexp_replace(regexp_replace(lower({part('url', 3)}), ':[^:]*$', ''), '^www\\.', '') AS root_domain FROM u",
    "url_resolve": f"WITH {L0} SELECT page_id, pos::INT AS pos, raw, href FROM l",
    "url_should_skip": f"WITH {ALL} SELECT seq, {skip('url')} AS skip FROM a",
    "url_classify_link": f"WITH {ALL} SELECT seq, CASE WHEN {internal('url')} THEN 'internal' ELSE 'external' END AS class FROM a",
    "seg_classify": f"WITH {SEGMENTS} SELECT raw, {kind('raw')} AS kind, count(*) AS n FROM s GROUP BY ALL",
    "seg_is_literal_like": f"WITH {SEGMENTS} SELECT raw, regexp_matches(raw, '^[a-z][a-z0-9_-]*$') AS literal, count(*) AS n FROM s GROUP BY ALL",
    "seg_matches_template": f"WITH {SEGMENTS}, every AS (SELECT DISTINCT raw FROM s) SELECT raw, template, {fits('raw', 'template')} AS fits FROM every, (VALUES {_kinds}) AS b(template)",
    "extract_record": r"""SELECT page_id, CASE WHEN html IS NULL THEN 'failed' ELSE 'extracted' END AS status, (NOT regexp_matches(html, '(?i)<(title|h1)[\s>]'))::INT + (NOT regexp_matches(html, '(?i)<(pre|h1)[\s>]'))::INT
      + (NOT regexp_matches(html, '(?i)<p[\s>]'))::INT + (NOT regexp_matches(html, '(?i)<ul[\s>]'))::INT AS fields_missing FROM pages""",
    "css_extract": f"""SELECT page_id, '{{"page_title": ' || to_json({_title})::VARCHAR || ', "function_signature": ' || to_json({_text(r"regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")})::VARCHAR || ', "description": '
      || to_json({_text(r"regexp_extract(html, '(?s)<p>(.*?)(?:</p>|<p>|</article>)', 1)")})::VARCHAR || ', "parameters": [' || array_to_string(list_transform(regexp_extract_all(regexp_extract(html, '(?s)<ul>(.*?)</ul>', 1), '(?s)<li>(.*?)</li>', 1), lambda li: to_json({_text("li")})::VARCHAR), ', ') || ']}}' AS data FROM pages""",
    "html_links": f"WITH {L0} SELECT page_id, pos::INT + 3 AS pos, href, text, rel FROM l UNION ALL SELECT page_id, pos, {_origin} || href, text, rel FROM pages, (VALUES (0, '/q', 'Eé ♥', ''), (1, '/l?a=1&copy=2', 'onetwo', 'a b'), (2, '/m', 'm', '')) AS awkward(pos, href, text, rel)",
    "html_signals": f"WITH {SIGNALS} SELECT * FROM g",
    "signals_best_guess": f"""WITH {SIGNALS}, b AS (SELECT page_id, CASE WHEN contains(lower(meta_generator), 'sphinx') THEN ['sphinx', '0.95'] WHEN contains(lower(meta_generator), 'mkdocs') THEN ['mkdocs', '0.95'] WHEN contains(lower(meta_generator), 'docusaurus') THEN ['docusaurus', '0.95']
      WHEN has_objects_inv THEN ['sphinx', '0.95'] WHEN has_search_index THEN ['mkdocs', '0.9'] WHEN static_dir OR sphinx_searchtools THEN ['sphinx', '0.7'] WHEN docusaurus_detected OR docusaurus_in_html THEN ['docusaurus', '0.85'] WHEN rtd_theme THEN ['sphinx_rtd_theme', '0.8']
      WHEN mkdocs_material OR mkdocs_detected THEN ['mkdocs_material', '0.8'] END AS x FROM g) SELECT page_id, x[1] AS tool, coalesce(x[2]::DOUBLE, 0.0) AS confidence FROM b""",
    "filter_assets": f"WITH {ALL} SELECT {asset('url')} AS is_asset, count(*) AS n FROM a GROUP BY ALL",
    "filter_skip": f"WITH {ALL} SELECT seq, url FROM a WHERE depth = 1 AND NOT {skip('url')}",
    "filter_should_crawl": f"WITH {U}, x AS (SELECT seq, regexp_replace(lower({part('url', 3)}), '^www\\.', '') AS h FROM u) SELECT seq, CASE WHEN NOT (h = '{ROOT}' OR ends_with(h, '.{ROOT}')) THEN 'external_not_crawled' WHEN seq % 6 > 3 THEN 'max_depth' WHEN seq >= 200 THEN 'max_internal_urls' ELSE 'ok' END AS reason FROM x",
    "project_wide_url": f"WITH {C} SELECT seq, canonical_url, path, array_to_string({segs('path')}, '|') AS segments, domain, scheme, depth FROM c",
    "dedup_ingest": f"WITH {ALL}, {_canonical_of('a', 'c')} SELECT seq, key, depth, link_text FROM c1",
    "dedup_canonical": f"WITH {ALL}, {_canonical_of('a', 'c')} SELECT seq, canonical_url, depth, link_text FROM c2",
    "dedup_frontier": f"WITH {ALL} {_first_key(f'SELECT *, {frontier("url")} AS key FROM a', 'seq, key, url')}",
    "dedup_internal": f"WITH {ALL} {_first_key(f'SELECT *, {frontier("url")} AS key FROM a WHERE {internal("url")}', 'seq, key, url, depth')}",
    "join_url_lookup": f"WITH {ALL}, {_canonical_of('u', 'c')} SELECT c.domain, count(*) AS n FROM l JOIN c ON {canonical('l.source_url')} = c.canonical_url GROUP BY ALL",
    "semi_group_members": f"WITH {M} SELECT seq, canonical_url FROM c WHERE EXISTS (FROM m WHERE m.seq = c.seq AND template_id = 't2')",
    "anti_uncovered": f"WITH {M} SELECT seq, canonical_url FROM c WHERE NOT EXISTS (FROM m WHERE m.seq = c.seq)",
    "frontier_stream": f"WITH {ALL} SELECT DISTINCT {frontier('url')} AS key FROM a WHERE depth = 1 AND {frontier('url')} NOT IN (SELECT {frontier('url')} FROM u)",
    "anti_visited": f"WITH {ALL} SELECT seq, {frontier('url')} AS key FROM a WHERE depth = 1 AND {frontier('url')} NOT IN (SELECT {frontier('url')} FROM u)",
    "anti_visited_levels": f"WITH {ALL} SELECT seq, {frontier('url')} AS key FROM a WHERE depth = 1 AND {frontier('url')} NOT IN (SELECT {frontier('url')} FROM u)",
    "theta_template_match": f"WITH {M} SELECT * FROM m",
    "first_match": f"WITH {M} SELECT template_id, count(*) AS n, min(seq) AS first_seq FROM m GROUP BY ALL",
    "join_template_map": f"WITH {M} SELECT template_id, pattern, canonical_url FROM m JOIN t USING (template_id)",
    "join_zip_positions": f"WITH {M}, z AS (SELECT template_id, {segs('path')} AS s, {segs('pattern')} AS p FROM m JOIN (SELECT seq, path FROM c) USING (seq) JOIN t USING (template_id)), y AS (SELECT template_id, i, s[i] AS raw, p[i] AS part FROM (SELECT *, unnest(range(1, greatest(len(s), len(p)) + 1)) AS i FROM z)) SELECT template_id, (i - 1)::INT AS pos, part, CASE WHEN raw IS NOT NULL THEN {kind('raw')} END AS lexical_type, count(*) AS n FROM y GROUP BY ALL",
    "trie_metrics": f"WITH {PREFIX} SELECT prefix, depth::INT AS depth, first_seq, descendant_count, own_urls, child_count, child_literal_ratio FROM t",
    "trie_collect_leaves": f"WITH {PREFIX}, o AS (SELECT n.seq, list(t.first_seq ORDER BY n.depth) AS trail FROM n JOIN t USING (prefix) GROUP BY n.seq) SELECT prefix, seq, row_number() OVER (PARTITION BY prefix ORDER BY trail, seq) - 1 AS pos FROM n JOIN o USING (seq)",
    "trie_junctions": f"WITH {PREFIX} SELECT prefix, depth::INT AS depth, first_seq, descendant_count, own_urls, child_count, child_literal_ratio FROM t WHERE child_literal_ratio >= 0.7 AND child_count >= 2",
    "pos_frequencies": f"WITH {FREQ} SELECT pos::INT AS pos, raw, n, freq FROM f",
    "pos_classify": f"WITH {FREQ} SELECT pos::INT AS pos, CASE WHEN max(freq) >= 0.8 THEN 'static' WHEN max(freq) < 0.1 THEN 'variable' ELSE 'semi_variable' END AS kind FROM f GROUP BY pos",
    "pos_fingerprint": f"WITH {FREQ}, p AS (SELECT pos FROM f GROUP BY pos HAVING max(freq) >= 0.8) SELECT seq, string_agg(CASE WHEN i - 1 IN (FROM p) THEN raw ELSE upper({kind('raw')}) END, '/' ORDER BY i) AS fingerprint FROM (SELECT seq, unnest(s) AS raw, unnest(range(1, len(s) + 1)) AS i FROM d) GROUP BY seq",
    "tpl_versions": f"WITH {DERIVED} SELECT group_prefix, coalesce(array_to_string(list_sort(list(DISTINCT version) FILTER (version IS NOT NULL)), '|'), '') AS versions FROM mem GROUP BY 1",
    "coverage_report": f"WITH {M}, x AS (SELECT (SELECT count(*) FROM c) AS n, (SELECT count(*) FROM m) AS k) SELECT n AS total_internal_urls, k AS covered_urls, n - k AS uncovered_urls, round(k / n * 100, 2) AS coverage_percent, {len(FIXED_TEMPLATES)}::INT AS template_count, round(k / {len(FIXED_TEMPLATES)}, 1) AS avg_urls_per_template FROM x",
    "coverage_template_map": f"WITH {M} SELECT t.template_id, count(seq)::INT AS n, coalesce(string_agg(canonical_url, '|' ORDER BY seq), '') AS urls FROM t LEFT JOIN m USING (template_id) GROUP BY ALL",
    "uncovered_rows": f"WITH {M} SELECT seq, canonical_url AS url, 'no_template_match (path=' || path[1:80] || ')' AS reason, 'self_heal' AS recommendation FROM c WHERE seq NOT IN (SELECT seq FROM m)",
    "topk_uncovered": f"WITH {M} SELECT seq, canonical_url AS url FROM c WHERE seq NOT IN (SELECT seq FROM m) ORDER BY seq LIMIT 50",
    "sort_specificity": f"WITH {DERIVED}, sp2 AS (SELECT group_prefix, member_count, string_split(trim(pattern, '/'), '/') AS p FROM der) SELECT group_prefix, -len(list_filter(p, lambda x: NOT starts_with(x, '<') AND x <> '...'))::INT AS literals, -len(p)::INT AS parts, -member_count AS members FROM sp2",
    "uncovered_dirs": f"WITH {M} SELECT directory, n FROM (SELECT CASE WHEN d = '' THEN '/' ELSE d END AS directory, count(*) AS n, min(seq) AS f FROM (SELECT seq, regexp_replace(path, '/?[^/]*$', '') AS d FROM c WHERE seq NOT IN (SELECT seq FROM m)) GROUP BY 1) ORDER BY n DESC, f LIMIT 30",
    "uncovered_prefix2": f"WITH {M} SELECT prefix, n FROM (SELECT CASE WHEN len({segs('path')}) = 0 THEN 'ROOT' ELSE '/' || array_to_string(({segs('path')})[1:2], '/') END AS prefix, count(*) AS n, min(seq) AS f FROM c WHERE seq NOT IN (SELECT seq FROM m) GROUP BY 1) ORDER BY n DESC, f LIMIT 30",
    "external_rollup": f"WITH {C} SELECT domain, min(seq) AS first_seq, count(*) AS url_count, array_to_string((list(path ORDER BY seq))[1:10], '|') AS observed_paths FROM c GROUP BY domain",
    "external_classify": f"WITH {C} SELECT domain, {_domain_kind()} AS classification FROM c GROUP BY domain",
    "cap_external_per_domain": f"WITH {U} SELECT seq, url FROM ({_cap}) WHERE k <= 3 ORDER BY seq LIMIT 100",
    "cap_internal": f"WITH {_WAYS} SELECT node, depth::INT AS depth FROM f ORDER BY depth, way LIMIT 10",
    "limit_per_template": f"WITH {M} SELECT template_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY seq) AS k FROM m) WHERE k <= 5",
    "sample_per_template": f"WITH {M} SELECT template_id, canonical_url FROM (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY seq) AS k FROM m) WHERE k <= 3",
    "generator_path_flags": f"WITH {C}, g AS (SELECT lower({_MADE}) AS p FROM c) SELECT generator, piece, count(*) FILTER (contains(p, piece)) AS n FROM (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, {chr(39)}{x}{chr(39)})' for n, x, _, _ in values.GENERATOR_PATHS)}) AS k(generator, piece), g GROUP BY ALL",
    "generator_detect": _generator_sql(),
    "crawl_stats": f"WITH {U} SELECT count(*) FILTER ({internal('url')}) AS internal_discovered, 0 AS max_depth_reached, count(*) FILTER (NOT {internal('url')}) AS external_discovered, count(DISTINCT lower({part('url', 3)})) FILTER (NOT {internal('url')}) AS external_domains FROM u",
    "crawl_enqueue": f"WITH {L0} SELECT page_id, pos::INT AS pos, {frontier('href')} AS key, {internal('href')} AS internal FROM l WHERE NOT {skip('href')}",
    "crawl_bfs": f"WITH {_WAYS} SELECT node, depth::INT AS depth, coalesce(parent, -1) AS parent FROM f",
    "crawl_pages": f"WITH {_WAYS} SELECT 'https://{ROOT}/p' || node AS url, depth::INT AS depth, 'https://{ROOT}/p' || coalesce(parent, node) AS source_url FROM f",
    "crawl_external": f"WITH {_WAYS}, o AS (SELECT *, row_number() OVER (PARTITION BY node % 7 ORDER BY depth, way) AS k FROM f) SELECT 'https://out' || node % 7 || '.example/' || node AS url, (depth + 1)::INT AS depth, 'https://{ROOT}/p' || node AS source_url, 'out' AS link_text FROM o WHERE k <= 2 ORDER BY o.depth, way LIMIT 9",
    "get_next": f"WITH {ALL}, k AS (SELECT {frontier('url')} AS key FROM u WHERE seq % 2 = 0) SELECT key, 1 AS depth, seq FROM (SELECT {frontier('url')} AS key, seq FROM a WHERE depth = 1 AND NOT {skip('url')}) WHERE key NOT IN (FROM k) ORDER BY seq LIMIT 20",
    "src_unlocker": "SELECT url, CASE WHEN k = 0 THEN 'page ' || url END AS html, CASE WHEN k < 2 THEN 1 ELSE 3 END AS requests, (k = 0)::INT AS successful, (k <> 0)::INT AS failed, (k = 0)::INT AS credits FROM (SELECT url, length(url) % 6 AS k FROM pages)",
    "heal_loop": f"WITH {_healed(False)} SELECT template_id, url, round, verdict FROM dn",
    "llm_escalate": f"WITH {_healed(True)} SELECT verdict, round, count(*) AS n FROM dn GROUP BY ALL",
    "phase3_counts": f"WITH {_healed(True)} SELECT (SELECT count(*) FROM w) AS total_urls, (SELECT count(*) FROM w) AS processed, (SELECT count(*) FROM dn WHERE round > 0) AS healed, (SELECT count(*) FROM ls) AS failed",
    "snk_phase3_json": _DOCUMENT,
    "snk_phase1_json": _CRAWL,
    "frontier_seed": f"WITH {U} SELECT {frontier('url')} AS key, depth FROM u ORDER BY seq LIMIT 1",
    "redirect_rehome": f"WITH {U}, x AS (SELECT seq, CASE WHEN seq % 4 = 0 THEN 'https://www.example.com:8080/moved' ELSE url END AS f FROM u) SELECT seq, {internal('f')} AS inside FROM x",
    "src_http_fetch_source": f"WITH {ALL}, k AS (SELECT {frontier('url')} AS key FROM u), x AS (SELECT {frontier('url')} IN (FROM k) AS hit FROM (SELECT DISTINCT url FROM a)) SELECT CASE WHEN hit THEN 'success' ELSE 'http_error' END AS crawl_status, CASE WHEN hit THEN 200 ELSE 404 END AS status_code, count(*) AS n FROM x GROUP BY ALL",
    "src_http_fetch": f"WITH {ALL}, k AS (SELECT {frontier('url')} AS key FROM u), x AS (SELECT {frontier('url')} IN (FROM k) AS hit FROM a) SELECT CASE WHEN hit THEN 'success' ELSE 'http_error' END AS crawl_status, CASE WHEN hit THEN 200 ELSE 404 END AS status_code, count(*) AS n FROM x GROUP BY ALL",
    "src_http_head": f"WITH {ALL} SELECT seq FROM a WHERE {frontier('url')} IN (SELECT {frontier('url')} FROM u)",
    "fetch_status_classify": "SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'timeout' WHEN page_id % 17 = 0 THEN 'error' WHEN page_id % 6 IN (0, 4) THEN CASE WHEN page_id % 5 = 0 THEN 'skipped_content_type' WHEN page_id % 3 = 0 THEN 'redirect' ELSE 'success' END ELSE 'http_error' END AS crawl_status FROM pages",
    "score_field": f"WITH {SCORES} SELECT * FROM sc",
    "validate_record": f"WITH {VERDICT} SELECT * FROM v",
    "validate_schema": f"""WITH {RECORDS}, x AS (SELECT *, list_filter(['page_title', 'description', 'parameters'], lambda n: CASE n WHEN 'page_title' THEN page_title WHEN 'description' THEN description ELSE parameters END IS NULL) AS gone,
      list_filter(['page_title', 'description', 'parameters'], lambda n: CASE n WHEN 'page_title' THEN page_title WHEN 'description' THEN description ELSE parameters END IN ('', '[]')) AS blank FROM r)
      SELECT page_id, len(gone) + len(blank) = 0 AS passed, array_to_string(gone, ',') AS missing, array_to_string(blank, ',') AS empty, (function_signature IS NULL)::INT AS optional, round((3 - len(gone) - len(blank)) / 3, 6) AS score FROM x""",
    "template_stats": f"WITH {VERDICT} SELECT (page_id % 4)::VARCHAR AS template_id, count(*) AS total, count(*) FILTER (verdict = 'PASS') AS passed, count(*) FILTER (verdict = 'BORDERLINE') AS borderline, count(*) FILTER (verdict = 'FAIL') AS failed FROM v GROUP BY ALL",
    "src_phase1_json": f"WITH {U} SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, url, depth, link_text FROM u WHERE {internal('url')}",
    "snk_txt_csv": f"WITH {M} SELECT canonical_url AS url FROM m ORDER BY seq LIMIT 50",
    "src_scraper_cli": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN '{\"id\": ' || page_id || '}' WHEN 1 THEN '[1, 2]' ELSE '{\"raw_output\":\"run\\n{broken\\ndone\"}' END AS data FROM pages",
}
