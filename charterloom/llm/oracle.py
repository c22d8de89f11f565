"""Equivalent DuckDB SQL of the training-data queries, where SQL can express them over whole tables."""

from __future__ import annotations

#: One row for each record of tokenized_corpus: the latest.
_RECORDS = """
recs AS (SELECT doc_idx, arg_max(t, k) AS tokens FROM (
  SELECT doc_idx, {'v': tokens} AS t, {'known': tokenized_at IS NOT NULL, 'at': coalesce(tokenized_at, TIMESTAMP '0001-01-01')} AS k
  FROM tokenized_corpus WHERE doc_idx IS NOT NULL) GROUP BY doc_idx),
rec AS (SELECT doc_idx, tokens.v AS tokens FROM recs),
nn AS (SELECT count(*) AS n FROM rec),
tf AS (SELECT doc_idx, token, count(*) AS tf FROM (SELECT doc_idx, unnest(tokens) AS token FROM rec) WHERE token <> '' GROUP BY ALL),
tot AS (SELECT token, CAST(sum(tf) AS BIGINT) AS n_occurrences, count(*) AS n_records FROM tf GROUP BY token)
"""

_MARK = "CASE WHEN n_occurrences <= 2 THEN 'rare' WHEN 4 * n_records > n THEN 'common' END"

_SPANS = f"""
WITH {_RECORDS},
texts AS (SELECT 2 * doc_idx AS rec, tokens FROM rec WHERE len(tokens) >= 20
  UNION ALL SELECT 2 * doc_idx + 1, tokens FROM formulary WHERE len(tokens) >= 20),
w AS (SELECT rec, p, list_slice(tokens, p + 1, p + 20) AS win FROM (
  SELECT rec, tokens, unnest(range(len(tokens) - 19)) AS p FROM texts)),
ok AS (SELECT rec, p, hash(win) AS h, win FROM w WHERE len(list_filter(win, lambda x: x IS NULL OR x = '')) = 0),
shared AS (SELECT win FROM ok GROUP BY win HAVING count(DISTINCT rec) > 1),
hit AS (SELECT rec, p FROM ok JOIN shared USING (win) WHERE rec % 2 = 0),
mark AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY rec ORDER BY p) + 20 THEN 0 ELSE 1 END AS s FROM hit),
grp AS (SELECT *, sum(s) OVER (PARTITION BY rec ORDER BY p) AS g FROM mark),
runs AS (SELECT rec // 2 AS doc_idx, CAST(min(p) AS INTEGER) AS start_pos, CAST(max(p) + 20 - min(p) AS INTEGER) AS n_tokens FROM grp GROUP BY rec, g)
"""

#: The greatest length 20 * 2^k of a window in each run that stands in another record too.
_LEVELS = """, lv AS (SELECT rec, tokens, w FROM texts, (SELECT CAST(20 * pow(2, k) AS BIGINT) AS w FROM (SELECT unnest(range(16)) AS k)) WHERE len(tokens) >= w),
lw AS (SELECT rec, w, p, list_slice(tokens, p + 1, p + w) AS win FROM (SELECT rec, w, tokens, unnest(range(len(tokens) - w + 1)) AS p FROM lv)),
lok AS (SELECT rec, w, p, win FROM lw WHERE len(list_filter(win, lambda x: x IS NULL OR x = '')) = 0),
lhit AS (SELECT rec, w, p FROM lok JOIN (SELECT win FROM lok GROUP BY win HAVING count(DISTINCT rec) > 1) USING (win) WHERE rec % 2 = 0)
SELECT doc_idx, start_pos, n_tokens, CAST(max(w) AS INTEGER) AS repeated_len
FROM runs JOIN lhit ON rec = 2 * doc_idx AND p BETWEEN start_pos AND start_pos + n_tokens - 1 GROUP BY ALL"""

ORACLE: dict[str, str] = {
    "p2_spans": _SPANS + _LEVELS,
    "p2_found": _SPANS + "SELECT doc_idx, start_pos, n_tokens FROM runs",
    "p2_share": _SPANS
    + """, per AS (SELECT doc_idx, CAST(sum(n_tokens) AS BIGINT) AS n_shared FROM runs GROUP BY 1)
SELECT doc_idx, CAST(coalesce(len(tokens), 0) AS INTEGER) AS n_tokens, coalesce(n_shared, 0) AS n_shared,
  CASE WHEN coalesce(len(tokens), 0) > 0 THEN coalesce(n_shared, 0) / len(tokens) ELSE 0.0 END AS share
FROM rec LEFT JOIN per USING (doc_idx)""",
    "p3_found": f"""WITH {_RECORDS},
wt AS (SELECT doc_idx, token, n_records AS df, n, tf * (ln((1 + n) / (1 + n_records)) + 1) AS w FROM tf JOIN tot USING (token), nn)
SELECT doc_idx, token FROM (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY doc_idx)) AS x FROM wt) WHERE x >= 0.3 AND 40 * df <= n""",
    "p3_scores": f"""WITH {_RECORDS},
len AS (SELECT doc_idx, CAST(sum(tf) AS BIGINT) AS doc_len FROM tf GROUP BY 1),
mean AS (SELECT (SELECT sum(tf) FROM tf) / n AS avg_len FROM nn),
x AS (SELECT tf.doc_idx, token, tf, n_records AS df, n_occurrences AS cf, doc_len, n, n_occurrences / n AS rate,
  tf * log2(1 + avg_len / doc_len) AS tfn FROM tf JOIN tot USING (token) JOIN len ON len.doc_idx = tf.doc_idx, nn, mean)
SELECT doc_idx, token, tf, df, cf, doc_len, n, round((log2(1 + rate) - tfn * log2(rate / (1 + rate))) / (tfn + 1), 6) AS score FROM x""",
    "p4_found": f"WITH {_RECORDS} SELECT * FROM (SELECT token, n_occurrences, n_records, {_MARK} AS mark FROM tot, nn) WHERE mark IS NOT NULL",
    "p4_terms": f"WITH {_RECORDS} SELECT token, n_occurrences, n_records, {_MARK} AS mark FROM tot, nn",
    "p4_names": f"""WITH one AS (SELECT doc_idx, arg_max({{'v': name}}, {{'k': loaded_at IS NOT NULL, 'at': coalesce(loaded_at, TIMESTAMP '0001-01-01')}}).v AS token FROM corpus GROUP BY 1),
nn AS (SELECT count(*) AS n FROM one),
tot AS (SELECT token, count(*) AS n_occurrences, count(*) AS n_records FROM one WHERE token <> '' GROUP BY 1)
SELECT token, n_occurrences, n_records, {_MARK} AS mark FROM tot, nn""",
    "p5_found": """WITH RECURSIVE e AS (SELECT DISTINCT i AS a, j AS b FROM dist_mat
  WHERE i IS NOT NULL AND j IS NOT NULL AND i <> j AND score IS NOT NULL AND NOT isnan(score) AND score >= 0.6),
d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(v, r) AS (SELECT DISTINCT a, a FROM d UNION SELECT reach.v, d.b FROM reach JOIN d ON d.a = reach.r)
SELECT v AS doc_idx, min(r) AS group_id FROM reach GROUP BY v""",
}
