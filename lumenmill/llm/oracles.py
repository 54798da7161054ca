"""SQL (DuckDB) for the queries that SQL can express, written from their definitions and not from the operators."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: BM25 with k1 1.2 and b 0.75: the ten best documents for each query that shares a word with any.
SEARCH = f"""
WITH t AS (SELECT doc_id, unnest({WORDS.replace("coalesce(text, '')", LOWER.format("coalesce(text, '')"))}) AS w FROM documents),
 f AS (SELECT doc_id, w, count(*) AS tf FROM t GROUP BY ALL),
 n AS (SELECT doc_id, sum(tf) AS words FROM f GROUP BY doc_id),
 s AS (SELECT (SELECT count(*) FROM documents) AS docs, (SELECT sum(words) FROM n) / (SELECT count(*) FROM documents) AS mean),
 i AS (SELECT w, ln(1 + (any_value(docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM f, s GROUP BY w),
 g AS (SELECT f.doc_id, w, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * words / mean)) AS gain FROM f JOIN n USING (doc_id) JOIN i USING (w), s),
 p AS (SELECT q.doc_id AS query_id, g.doc_id, round(sum(gain), 6) AS score FROM f q JOIN g USING (w) WHERE q.doc_id % 20 = 0 GROUP BY ALL),
 r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""

#: Sets of two-word shingles, all pairs that share one, and what can be reached over links of 0.8 or more.
NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
 e AS (SELECT DISTINCT doc_id, ws[k] || ' ' || ws[k + 1] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS k FROM w) UNION ALL SELECT doc_id, ws[1] FROM w WHERE len(ws) = 1),
 n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id),
 c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * common >= 80 * (x.n + y.n - common)),
 d AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
 reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT reach.u, d.v FROM reach JOIN d ON reach.v = d.u),
 comp AS (SELECT u, min(v) AS low FROM reach GROUP BY u)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, low AS component_id, doc_id = low AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN comp ON u = doc_id
"""

#: kind, pattern, group that is measured, least length, whether it is one of the base kinds; in the order of kinds.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    ("hex", r"[0-9a-f]+", 0, 24, True),
    ("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1, False),
    ("vcs_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0, 40, False),
    ("chat_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, False),
    ("web_token", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 34, False),
)


def _found(rank: int, kind: str, pattern: str, group: int, least: int, base: bool) -> str:
    """One row for each match that is long enough. A match starts after all gaps and matches before it."""
    p = "'" + pattern.replace("'", "''") + "'"
    hits = f"SELECT doc_id, regexp_extract_all(t, {p}) AS hits, regexp_extract_all(t, {p}, {group}) AS vals, string_split_regex(t, {p}) AS gaps FROM d"
    each = f"SELECT doc_id, unnest(range(1, len(hits) + 1)) AS k, hits, vals, gaps FROM ({hits}) WHERE len(hits) > 0"
    before = "list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0)"
    return f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, {base} AS base, {before} AS a, length(hits[k]) AS size FROM ({each}) WHERE length(vals[k]) >= {least}"


SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 f AS ({" UNION ALL ".join(_found(i, *k) for i, k in enumerate(KINDS))}),
 s AS (SELECT *, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + size AS BIGINT) AS span FROM f),
 g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(span, ',' ORDER BY a, rank) FILTER (base) AS base_spans, string_agg(span, ',' ORDER BY a, rank) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
 FROM documents LEFT JOIN g USING (doc_id)
"""

#: The counts of the quality rules and the base verdict.
RULES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
 l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
 u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dups FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
 g AS (SELECT doc_id, k, ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS k FROM d)),
 r AS (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1),
 h AS (SELECT DISTINCT doc_id, k + j AS k FROM g JOIN r USING (doc_id, g), range(3) x(j)),
 c AS (SELECT doc_id, count(*) AS repeats FROM h GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups, 0) AS n_dup_lines,
 coalesce(repeats, 0) AS n_repeat_words, len(ws) < 50 OR 100 * coalesce(repeats, 0) > 50 * len(ws) AS base_failed FROM d LEFT JOIN u USING (doc_id) LEFT JOIN c USING (doc_id)
"""

#: Sizes, and targets in closed form: with sources in the order of cap over weight, those before the first that stays below its cap are full.
MIX = f"""
WITH d AS (SELECT doc_id, source, len({WORDS}) AS size FROM documents),
 s AS (SELECT source, sum(size) AS size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
 r AS (SELECT *, 1.5 * sum(size) OVER () - coalesce(sum(2 * size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM s WINDOW o AS (ORDER BY size / w, source)),
 k AS (SELECT arg_min(rest / ws, size / w) AS level FROM r WHERE rest / ws <= 2 * size / w)
SELECT doc_id, d.size, CAST(s.size AS BIGINT) AS source_size, round(least(2 * s.size, level * w), 4) AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, k
"""

SQL = {"op2_bm25_search": SEARCH, "op5_near_dedup": NEAR, "op8_secret_scan": SECRETS, "rule_counts": RULES, "mix_targets": MIX}
