"""Results of the operators that SQL can state, as DuckDB SQL over the same tables."""

from __future__ import annotations

import string

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
LOWER_WORDS = _WORDS.format(text=_LOWER)
WORDS = _WORDS.format(text="coalesce(text, '')")

#: Windows of 20 words: the first place of each, and the words that a later one covers.
SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, j, md5(array_to_string(w[j:j + 19], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS j FROM d)),
bad AS (SELECT doc_id, j FROM win QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, j) > 1),
cov AS (SELECT DISTINCT doc_id, unnest(range(j, j + 20)) AS k FROM bad),
gone AS (SELECT doc_id, list(k) AS ks FROM cov GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(ks), 0) AS n_removed, w, coalesce(ks, []) AS ks FROM d LEFT JOIN gone g ON g.doc_id = d.doc_id),
pos AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM d),
txt AS (SELECT p.doc_id, string_agg(x, ' ' ORDER BY p.k) AS t FROM pos p LEFT JOIN cov c ON c.doc_id = p.doc_id AND c.k = p.k WHERE c.k IS NULL GROUP BY 1)
SELECT k.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM kept k LEFT JOIN txt ON txt.doc_id = k.doc_id"""

#: Distinct shingles of items and documents, counted where they meet.
CONTAINED = f"""
WITH i AS (SELECT item_id, {LOWER_WORDS} AS w FROM benchmark),
ish AS (SELECT DISTINCT item_id, k, array_to_string(w[j:j + k - 1], ' ') AS s FROM (
  SELECT item_id, w, least(5, len(w)) AS k, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS j FROM i WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n FROM ish GROUP BY 1),
d AS (SELECT doc_id, {LOWER_WORDS} AS w FROM documents),
dsh AS (SELECT DISTINCT doc_id, k, array_to_string(w[j:j + k - 1], ' ') AS s FROM (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, (SELECT DISTINCT k FROM ish) WHERE len(w) >= k))
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n.n) AS n_shingles
FROM ish JOIN dsh USING (k, s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(n.n)"""

#: All pairs of documents that share a shingle, the similar ones as links, and the smallest document reachable.
NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {LOWER_WORDS} AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[j:j + 3], ' ') AS s FROM (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS j FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, n.n"""

#: Windows of 400 bytes, written as 800 hexadecimal digits, that occur twice; what they cover goes.
REPEATED_BYTES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, j, md5(substr(h, 2 * j + 1, 800)) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 399)) AS j FROM d)),
bad AS (SELECT doc_id, j FROM win QUALIFY count(*) OVER (PARTITION BY s) > 1),
marked AS (SELECT *, CASE WHEN j <= lag(j) OVER (PARTITION BY doc_id ORDER BY j) + 400 THEN 0 ELSE 1 END AS fresh FROM bad),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY j) AS g FROM marked),
runs AS (SELECT doc_id, min(j) AS b, max(j) + 400 AS e FROM numbered GROUP BY doc_id, g),
cut AS (SELECT *, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY b) AS a FROM runs),
left_over AS (SELECT d.doc_id, sum(e - b) AS n_removed, count(*) AS n_spans,
  string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY b) || substr(any_value(h), 2 * max(e) + 1) AS kept
  FROM cut JOIN d ON d.doc_id = cut.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN left_over l ON l.doc_id = d.doc_id"""


#: Shares of all kept terms in every group, by whole numbers of 128 bits; pairs over all terms, ten terms a group.
DIVERGENCE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS place, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT place, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT place) >= 10),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY 1),
c AS (SELECT t.lang, source, term, count(*)::HUGEINT AS n FROM t JOIN kept k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
  1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (g.total + 2 * l.v) AS p, 1 + (1000000000 * (k.n + 2)) // (l.total + 2 * l.v) AS q
  FROM g JOIN kept k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
    FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY 1, 2, 3) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
listed AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM listed)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10"""
