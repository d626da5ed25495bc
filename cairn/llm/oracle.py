"""DuckDB SQL that states the rows of the queries that SQL can express, by definition and not by the operators' methods."""

from __future__ import annotations

from .licenses import CONTAINED, NOTICES

_LOWERED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TEXT = _LOWERED.format("text")

OP5 = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({_TEXT}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) + any_value(b.n) AS t FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE 100 * c >= 85 * (t - c) UNION ALL SELECT y, x FROM p WHERE 100 * c >= 85 * (t - c)),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.id),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, root AS component_id, doc_id = root AS kept FROM s JOIN c ON id = doc_id"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // {0}) % 32 + 1, 1)"
_BASE32 = f"array_to_string(list_transform(list_transform(range(0, 8), lambda i: ('0x' || substr(sha1(h), i * 5 + 1, 5))::BIGINT), lambda v: {' || '.join(_DIGIT.format(32**k) for k in (3, 2, 1, 0))}), '')"

OP6 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), m AS (SELECT h, max(page_id) AS first FROM p GROUP BY h)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN m USING (h)"""

_ITEM_WORDS = f"regexp_extract_all({_TEXT}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP7 = f"""
WITH d AS (SELECT doc_id, coalesce({_ITEM_WORDS}, []) AS w FROM documents), i AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 9], ' ') AS g, least(10, len(w)) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM i WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM q),
o AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, n WHERE len(w) >= n)),
h AS (SELECT doc_id, k, o.n, item_id FROM o JOIN q ON o.g = q.g AND o.n = q.n),
a AS (SELECT doc_id, count(DISTINCT k) AS hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS k FROM h) GROUP BY 1),
b AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM h GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, hit IS NOT NULL AS contaminated
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)"""


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = f"""({'|'.join(map(_either, ('password', 'passwd', 'secret', 'token')))}|{_either('api')}_?{_either('key')})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_RUN = "[A-Za-z0-9+/_-]{24,}"


def _matches(kind: int, pattern: str, group: int) -> str:
    """doc_id, row, kind, start, end, value of the matches of a pattern."""
    before = "coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    return f"""SELECT doc_id, source, lang, {kind} AS kind, ({before})::INT AS a, ({before} + length(m[i]))::INT AS z, v[i] AS value FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT doc_id, source, lang, string_split_regex(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {group}) AS v FROM documents WHERE text IS NOT NULL))"""


_SHOWN = "CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'opaque' END || ':' || a || ':' || z"

OP8 = f"""
WITH base AS (SELECT * FROM ({_matches(0, _ASSIGN, 2)}) WHERE length(value) >= 6 UNION ALL SELECT * FROM ({_matches(1, 'AKIA[A-Z0-9]+', 0)}) WHERE length(value) >= 20 UNION ALL {_matches(2, '[0-9a-f]{24,}', 0)}),
run AS (SELECT * FROM ({_matches(3, _RUN, 0)}) r WHERE regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]') AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.a < r.z AND r.a < b.z)),
f AS (SELECT * FROM base UNION ALL SELECT * FROM run),
n AS (SELECT value, count(DISTINCT source) > 2 OR count(DISTINCT source || '/' || lang) > 4 AS copied FROM f GROUP BY 1),
j AS (SELECT f.*, copied FROM f JOIN n USING (value)),
o AS (SELECT doc_id, count_if(kind = 0) AS x, count_if(kind = 1) AS y, count_if(kind = 2) AS w, string_agg({_SHOWN}, ',' ORDER BY a, kind) FILTER (kind < 3) AS b, string_agg({_SHOWN}, ',' ORDER BY a, kind) FILTER (kind < 3 OR NOT copied) AS s, count_if(copied AND kind < 3) AS c, count_if(NOT copied) AS l FROM j GROUP BY 1)
SELECT doc_id, coalesce(x, 0)::BIGINT AS n_assign, coalesce(y, 0)::BIGINT AS n_access, coalesce(w, 0)::BIGINT AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans, coalesce(c, 0)::BIGINT AS n_copied, coalesce(l, 0)::BIGINT AS n_live
FROM documents LEFT JOIN o USING (doc_id)"""

_LICENSE_WORDS = "regexp_extract_all(lower({0}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_SHINGLES = "CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) ELSE [] END"
_NOTICES = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(NOTICES))

OP4 = f"""
WITH t AS (SELECT id, license, unnest(s) AS g, len(s) AS n FROM (SELECT id, license, {_SHINGLES} AS s FROM (SELECT id, license, {_LICENSE_WORDS.format("notice")} AS w FROM (VALUES {_NOTICES}) v(id, license, notice)))),
d AS (SELECT doc_id, unnest(s) AS g FROM (SELECT doc_id, {_SHINGLES} AS s FROM (SELECT doc_id, coalesce({_LICENSE_WORDS.format("text")}, []) AS w FROM documents))),
f AS (SELECT doc_id, id, any_value(license) AS license FROM d JOIN t USING (g) GROUP BY doc_id, id HAVING count(*) >= {CONTAINED} * any_value(n)),
o AS (SELECT doc_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT license)), ',') AS names FROM f GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_templates, coalesce(names, '') AS licenses FROM documents LEFT JOIN o USING (doc_id)"""

ORACLE = {"op4_license_windows": OP4, "op5_lsh_forest": OP5, "op6_content_archive": OP6, "op7_fm_index": OP7, "op8_ownership_secrets": OP8}
