"""DuckDB SQL with the rows of those queries that SQL can express on small tables (doc_id unique)."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _covered(size: int) -> str:
    """CTEs ending in c(doc_id, pos, word, gone): whether a word lies in a window that stands elsewhere too."""
    return rf"""w AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS pos, len(l) AS n FROM (SELECT doc_id, {_WORDS} AS l FROM documents)),
x AS (SELECT doc_id, pos, word, CASE WHEN pos + {size - 1} <= n THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING) END AS win FROM w),
r AS (SELECT win FROM x WHERE win IS NOT NULL GROUP BY win HAVING count(*) > 1),
c AS (SELECT doc_id, pos, word, max(CASE WHEN r.win IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW) AS gone FROM x LEFT JOIN r ON x.win = r.win)"""


SUBSTRINGS = f"""WITH {_covered(35)}
SELECT d.doc_id, count(c.pos) AS n_words, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0), '')) AS kept_sha256
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id"""

SUFFIXES = f"""WITH {_covered(50)},
i AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM c WHERE gone = 1),
s AS (SELECT doc_id, min(pos) - 1 AS a, max(pos) AS z FROM i GROUP BY doc_id, island)
SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_repeated, count(*) AS n_spans, string_agg(a || ':' || z, ',' ORDER BY a) AS spans FROM s GROUP BY doc_id"""

NEAR_DUPLICATES = rf"""WITH RECURSIVE l AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM l WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
v AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
t AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT t.id, v.b FROM t JOIN v ON v.a = t.r),
m AS (SELECT id, min(r) AS component_id FROM t GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


def _places(name: str, pattern: str) -> str:
    """CTE name(doc_id, a, z, m): matches of a pattern and their places, read off the text between them."""
    return f"""{name}_0 AS (SELECT doc_id, unnest(regexp_extract_all(t, {pattern})) AS m, unnest(regexp_split_to_array(t, {pattern})) AS gap, generate_subscripts(regexp_split_to_array(t, {pattern}), 1) AS i FROM d),
{name} AS (SELECT doc_id, m, CAST(sum(length(gap) + coalesce(length(m), 0)) OVER (PARTITION BY doc_id ORDER BY i) - coalesce(length(m), 0) AS BIGINT) AS a, CAST(sum(length(gap) + coalesce(length(m), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS z FROM {name}_0 QUALIFY m IS NOT NULL)"""


_ASSIGN = r"""'(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'"""
_VALUE = r"""'^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$'"""

SECRETS = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_places("assign", _ASSIGN)},
{_places("access", "'AKIA[A-Z0-9]+'")},
{_places("hex", "'[0-9a-f]+'")},
{_places("opaque", "'[A-Za-z0-9+/_-]+'")},
{_places("name", r"'\b(?:client_id|client_secret|access_key|account|username|login|credential|bearer|passphrase|private_key)\b'")},
{_places("endpoint", r"'(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"''<>]+'")},
strong AS (SELECT doc_id, a, 0 AS k, 'assign' AS kind, z FROM assign WHERE length(regexp_extract(m, {_VALUE}, 1)) >= 6 UNION ALL SELECT doc_id, a, 1, 'access', z FROM access WHERE z - a >= 20 UNION ALL SELECT doc_id, a, 2, 'hex', z FROM hex WHERE z - a >= 24),
weak AS (SELECT doc_id, a, 3 AS k, 'weak' AS kind, z FROM opaque o WHERE z - a >= 16 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')
  AND EXISTS (SELECT 1 FROM endpoint e WHERE e.doc_id = o.doc_id AND abs(e.a - o.a) <= 200)
  AND EXISTS (SELECT 1 FROM (SELECT doc_id, a FROM name UNION ALL SELECT doc_id, a FROM strong WHERE k = 1) i WHERE i.doc_id = o.doc_id AND abs(i.a - o.a) <= 200)
  AND NOT EXISTS (SELECT 1 FROM (SELECT doc_id, a, z FROM strong UNION ALL SELECT doc_id, a, z FROM endpoint) b WHERE b.doc_id = o.doc_id AND b.a < o.z AND b.z > o.a)),
every AS (SELECT * FROM strong UNION ALL SELECT * FROM weak)
SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, sha256(coalesce(string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k) FILTER (k < 3), '')) AS base_sha256, coalesce(string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k), '') AS spans, count(*) FILTER (k = 3) AS n_weak
FROM d LEFT JOIN every ON every.doc_id = d.doc_id GROUP BY d.doc_id"""
