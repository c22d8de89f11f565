"""Equivalent DuckDB SQL of the core queries, over the same whole tables."""

from __future__ import annotations

import unicodedata
from itertools import combinations

from charterloom.config import BIGRAM_RULES, PHONETIC_ALPHABET, PHONETIC_RULES, parse_bigram_rules, parse_phonetic_rules
from charterloom.functions.text import LIGATURES, SINGLE_LETTERS

_LATEST = "{{'k': {at} IS NOT NULL, 'at': coalesce({at}, TIMESTAMP '0001-01-01')}}"
_WHITE = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _chain(column: str, rules) -> str:
    for source, target in rules:
        column = f"replace({column}, '{source}', '{target}')"
    return column


def _letters() -> dict[str, str]:
    """Characters of the basic plane whose compatibility decomposition starts with a letter a to z."""
    found = {}
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x10000)):
        first = unicodedata.normalize("NFKD", chr(code))[:1]
        if "a" <= first <= "z":
            found[chr(code)] = first
    return found | SINGLE_LETTERS


_MAP = _letters()
_FOLD = _chain("lower(text)", LIGATURES)
_NORM = rf"regexp_replace(translate(regexp_replace({_FOLD}, '[\x{{10000}}-\x{{10FFFF}}]', '  ', 'g'), '{''.join(_MAP)}', '{''.join(_MAP.values())}'), '[^a-z ]', ' ', 'g')"
_PHON = {s: t for s, t in parse_phonetic_rules(PHONETIC_RULES).items() if t in PHONETIC_ALPHABET}

_CORPUS = f"""rec AS (SELECT doc_idx, x.name AS name, x.path AS path, x.text AS text FROM (
  SELECT doc_idx, arg_max({{'name': name, 'path': path, 'text': text}}, {_LATEST.format(at='loaded_at')}) AS x
  FROM corpus WHERE doc_idx IS NOT NULL GROUP BY doc_idx))"""
_NORMED = f"{_CORPUS}, norm AS (SELECT doc_idx, {_NORM} AS norm_text FROM rec)"
_WORDS = rf"""{_NORMED},
words AS (SELECT word, count(*) AS freq FROM (SELECT unnest(regexp_split_to_array(norm_text, '\s+')) AS word FROM norm) WHERE word <> '' GROUP BY word),
freq AS (SELECT * FROM words WHERE freq >= 5 AND length(word) > 1)"""


def _affix(name: str, word: str, out: str) -> str:
    return f"""{name} AS (SELECT {out.format('left(w, n)')} AS affix, f AS freq FROM (
  SELECT w, f, len(list_filter(range(1, 8), lambda k: length(w) >= k AND length(v) >= k AND left(w, k) = left(v, k))) AS n FROM (
    SELECT {word} AS w, lead({word}) OVER (ORDER BY {word}) AS v, freq + lead(freq) OVER (ORDER BY {word}) AS f FROM freq) WHERE v IS NOT NULL)
  WHERE n BETWEEN 2 AND 6)"""


_AFFIXES = f"{_WORDS}, {_affix('pre', 'word', '{}')}, {_affix('suf', 'reverse(word)', 'reverse({})')}"
_BOTH = "cnt AS (SELECT affix, CAST(sum(freq) AS BIGINT) AS c FROM (SELECT * FROM pre UNION ALL SELECT * FROM suf) GROUP BY affix)"


def _tokens(second: bool) -> str:
    more = " UNION ALL SELECT doc_idx, 2, tokens FROM formulary" if second else ""
    return f"""tok AS (SELECT doc_idx, corpus, coalesce(list_filter(tokens, lambda t: t IS NOT NULL AND t <> ''), []) AS tokens FROM (
  SELECT doc_idx, 1 AS corpus, x.t AS tokens FROM (SELECT doc_idx, arg_max({{'t': tokens}}, {_LATEST.format(at='tokenized_at')}) AS x
  FROM tokenized_corpus WHERE doc_idx IS NOT NULL GROUP BY doc_idx){more})),
dict AS (SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 AS INTEGER) AS token_id FROM (SELECT DISTINCT unnest(tokens) AS token FROM tok)),
ex AS (SELECT doc_idx, corpus, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM tok),
ids AS (SELECT tok.doc_idx, tok.corpus, coalesce(x.ids, []) AS ids FROM tok LEFT JOIN (
  SELECT doc_idx, corpus, list(token_id ORDER BY pos) AS ids FROM ex JOIN dict USING (token) GROUP BY ALL) x USING (doc_idx, corpus))"""


def _features(second: bool, n: int = 6, r: int = 1) -> str:
    masks = list(combinations(range(n), n - r))
    terms = lambda m: " + ".join(f"CAST(ids[pos + {c + 1}] AS HUGEINT) * p{k}" for k, c in enumerate(m))
    modulus = (1 << 61) - 1
    powers = ", ".join(f"CAST(1 AS HUGEINT){' * v' * k} % {modulus} AS p{k}" for k in range(n - r))
    rows = " UNION ALL ".join(f"SELECT doc_idx, corpus, CAST(pos AS INTEGER) AS pos, {q} AS mask, CAST(({terms(m)}) % {modulus} AS BIGINT) AS feature FROM win, pw" for q, m in enumerate(masks))
    return f"""{_tokens(second)},
vv AS (SELECT CAST(count(*) AS HUGEINT) AS v FROM dict), pw AS (SELECT {powers} FROM vv),
win AS (SELECT doc_idx, corpus, ids, unnest(range(len(ids) - {n - 1})) AS pos FROM ids WHERE len(ids) >= {n}),
lno AS ({rows}),
post AS (SELECT doc_idx, corpus, feature, count(*) AS tf FROM lno GROUP BY ALL)"""


def _weights(second: bool) -> str:
    return f"""{_features(second)},
dfs AS (SELECT feature, count(*) AS df FROM post GROUP BY feature), nn AS (SELECT count(*) AS n FROM tok),
raw AS (SELECT doc_idx, corpus, feature, df, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM post JOIN dfs USING (feature), nn),
wt AS (SELECT doc_idx, corpus, feature, df, x / sqrt(sum(x * x) OVER (PARTITION BY corpus, doc_idx)) AS w FROM raw),
cls AS (SELECT tokens, min(doc_idx) AS class_id, count(*) AS n_docs FROM tok WHERE corpus = 1 GROUP BY tokens),
rep AS (SELECT class_id AS doc_idx FROM cls),
one AS (SELECT wt.* FROM wt JOIN rep USING (doc_idx) WHERE corpus = 1 AND df > 1)"""


_INTRA = f"""{_weights(False)},
pairs AS (SELECT a.doc_idx AS i, b.doc_idx AS j, round(sum(a.w * b.w), 8) AS score FROM one a JOIN one b ON a.feature = b.feature AND a.doc_idx < b.doc_idx GROUP BY ALL)"""
#: The same over all documents, copies among them.
_EVERY = f"""{_weights(False)}, every AS (SELECT * FROM wt WHERE df > 1),
pairs AS (SELECT a.doc_idx AS i, b.doc_idx AS j, round(sum(a.w * b.w), 8) AS score FROM every a JOIN every b ON a.feature = b.feature AND a.doc_idx < b.doc_idx GROUP BY ALL)"""
_STORED = """st AS (SELECT i, j, arg_max(s, {'k': scored_at IS NOT NULL, 'at': coalesce(scored_at, TIMESTAMP '0001-01-01'), 's': s}) AS score FROM (
  SELECT least(i, j) AS i, greatest(i, j) AS j, scored_at, CAST(score AS DOUBLE) AS s FROM dist_mat
  WHERE i IS NOT NULL AND j IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)) GROUP BY i, j)"""
_DOCS = f"{_CORPUS}, docs AS (SELECT doc_idx, 1 AS corpus, name FROM rec UNION ALL SELECT doc_idx, 2, name FROM formulary)"
_YEAR = "coalesce(try_cast(nullif(regexp_extract(coalesce(name, ''), '(?:^|[^0-9])([12][0-9]{3})(?:[^0-9]|$)', 1), '') AS INTEGER), 9999)"
#: The table of the longest common subsequence, folded row by row; list elements are indexes, as DuckDB wants one type.
_LCS = """list_reduce(list_transform(range(1, len(b) + 1), lambda q: [q]), lambda acc, ch: list_reduce(list_transform(range(1, len(a) + 1), lambda k: [k]),
  lambda cur, k: list_append(cur, greatest(acc[k[1]] + (CASE WHEN a[k[1]] = b[ch[1]] THEN 1 ELSE 0 END), acc[k[1] + 1], cur[k[1]])), [0::BIGINT]), list_transform(range(len(a) + 1), lambda x: 0::BIGINT))"""

_SPACE = _WHITE[1:-2]
#: Display tokens with the white space before them, as pieces that join to the text again.
_PIECES = rf"[{_SPACE}]*(?:[\p{{L}}\p{{N}}_]+(?:[-'’][\p{{L}}\p{{N}}_]+)*|\.\.\.|[^\p{{L}}\p{{N}}_{_SPACE}])".replace("'", "''")
_TEXTS = f"""{_STORED}, {_CORPUS}, docs AS (SELECT doc_idx, 1 AS corpus, name, text FROM rec UNION ALL SELECT doc_idx, 2, name, text FROM formulary),
pieces AS (SELECT doc_idx, regexp_extract_all(coalesce(text, ''), '{_PIECES}') AS pc FROM docs),
shown AS (SELECT doc_idx, pc, list_transform(pc, lambda x: regexp_replace(x, '^{_WHITE}', '')) AS ws FROM pieces),
lnk AS (SELECT i, j FROM st WHERE score >= 0.6 AND i <> j)"""


def _blocks(pairs: str, words: str) -> str:
    """Matching blocks by longest-block recursion: maximal diagonal runs once, then clipped to what is still open."""

    def best(rectangles: str) -> str:
        clipped = f"""SELECT s.*, r.a AS ra, r.b AS rb, greatest(0, s.alo - r.a, s.blo - r.b) AS f, least(r.n, s.ahi - r.a, s.bhi - r.b) AS t
    FROM ({rectangles}) s JOIN runs r USING (i, j)"""
        return f"""SELECT i, j, alo, ahi, blo, bhi, ra + f AS a, rb + f AS b, t - f AS n FROM ({clipped}) WHERE t > f
  QUALIFY row_number() OVER (PARTITION BY i, j, alo, ahi, blo, bhi ORDER BY t - f DESC, ra + f, rb + f) = 1"""

    whole = best("SELECT i, j, 0::BIGINT AS alo, len(t1) AS ahi, 0::BIGINT AS blo, len(t2) AS bhi FROM par")
    parts = best("SELECT i, j, if(k = 0, alo, a + n) AS alo, if(k = 0, a, ahi) AS ahi, if(k = 0, blo, b + n) AS blo, if(k = 0, b, bhi) AS bhi FROM rect, (VALUES (0), (1)) v(k)")
    return f"""lists AS ({words}),
par AS (SELECT i, j, x.ws AS t1, y.ws AS t2 FROM ({pairs}) JOIN lists x ON x.doc_idx = i JOIN lists y ON y.doc_idx = j WHERE len(x.ws) > 0 AND len(y.ws) > 0),
wd AS (SELECT doc_idx, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS p FROM lists),
cell AS (SELECT i, j, x.p AS a, y.p AS b FROM par JOIN wd x ON x.doc_idx = i JOIN wd y ON y.doc_idx = j AND y.word = x.word),
runs AS (SELECT i, j, min(a) AS a, min(b) AS b, count(*) AS n FROM (SELECT *, a - row_number() OVER (PARTITION BY i, j, a - b ORDER BY a) AS g FROM cell) GROUP BY i, j, a - b, g),
rect AS ({whole}
  UNION ALL
  {parts}),
blk AS (SELECT i, j, CAST(row_number() OVER (PARTITION BY i, j ORDER BY a, b, n DESC) - 1 AS INTEGER) AS seq, a, b, n AS size FROM (
  SELECT i, j, a, b, n FROM rect UNION ALL SELECT i, j, len(t1), len(t2), 0 FROM par)),
prev AS (SELECT *, coalesce(lag(a + size) OVER o, 0) AS pa, coalesce(lag(b + size) OVER o, 0) AS pb FROM blk WINDOW o AS (PARTITION BY i, j ORDER BY seq)),
gap AS (SELECT i, j, seq, t1[pa + 1:a] AS gap1, t2[pb + 1:b] AS gap2 FROM prev JOIN par USING (i, j) WHERE size > 0)"""


_WORDWISE = _blocks("SELECT i, j FROM lnk", r"SELECT doc_idx, list_transform(list_filter(ws, lambda w: regexp_matches(w, '^[\p{L}\p{N}]+$')), lambda w: lower(w)) AS ws FROM shown")
#: Likeness of the words of equally long short gaps.
_LIKENESS = f"""short AS (SELECT * FROM gap WHERE len(gap1) BETWEEN 1 AND 5 OR len(gap2) BETWEEN 1 AND 5),
equal AS (SELECT i, j, seq, generate_subscripts(gap1, 1) - 1 AS pos, unnest(gap1) AS token_1, unnest(gap2) AS token_2 FROM short WHERE len(gap1) = len(gap2)),
tw AS (SELECT DISTINCT token_1, token_2, regexp_extract_all(token_1, '(?s).') AS a, regexp_extract_all(token_2, '(?s).') AS b FROM equal),
rt AS (SELECT token_1, token_2, 2.0::DOUBLE * ({_LCS})[-1] / (len(a) + len(b)) AS ratio FROM tw)"""
_SEGMENTS = (
    _blocks("SELECT i, j FROM lnk UNION ALL SELECT j, i FROM lnk", "SELECT doc_idx, ws FROM shown")
    + f""",
seg AS (SELECT DISTINCT i AS doc_idx, trim(regexp_replace(array_to_string(pc[a + 1:a + size], ''), '{_WHITE}', ' ', 'g'), ' ') AS segment FROM blk JOIN shown ON doc_idx = i WHERE size > 4)"""
)
_RELATED = """d AS (SELECT i, j FROM lnk UNION ALL SELECT j, i FROM lnk),
g AS (SELECT i, count(*) AS n, string_agg(coalesce(name, ''), ', ' ORDER BY coalesce(name, '')) AS r FROM d JOIN docs ON docs.doc_idx = d.j GROUP BY i)"""


def _otsu(scores: str) -> str:
    """(bin, centre, v) of the cuts of the weighted histogram of ``scores`` (score, wgt)."""
    return f"""sc AS ({scores}),
lim AS (SELECT min(score) AS lo, max(score) AS hi FROM sc),
cnt AS (SELECT CAST(least(floor((score - lo) / (hi - lo) * 256), 255) AS INTEGER) AS bin, CAST(sum(wgt) AS DOUBLE) AS c FROM sc, lim GROUP BY 1),
full_ AS (SELECT r.bin, lo + (r.bin + 0.5::DOUBLE) * ((hi - lo) / 256) AS centre, coalesce(c, 0.0) AS c FROM (SELECT unnest(range(256)) AS bin) r LEFT JOIN cnt USING (bin), lim),
run AS (SELECT bin, centre, sum(c) OVER w AS w1, sum(c * centre) OVER w AS s1, sum(c) OVER () AS n, sum(c * centre) OVER () AS s FROM full_ WINDOW w AS (ORDER BY bin ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT bin, centre, round(w1 * (n - w1) * (s1 / w1 - (s - s1) / (n - w1)) * (s1 / w1 - (s - s1) / (n - w1)), 9) AS v FROM run WHERE bin < 255 AND w1 > 0 AND w1 < n)"""


ORACLE: dict[str, str] = {
    "matching_blocks": f"WITH RECURSIVE {_TEXTS}, {_WORDWISE} SELECT i, j, seq, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(size AS INTEGER) AS size FROM blk",
    "gap_pairs": f"WITH RECURSIVE {_TEXTS}, {_WORDWISE} SELECT i, j, seq, gap1, gap2 FROM gap",
    "linguistic_variations": f"""WITH RECURSIVE {_TEXTS}, {_WORDWISE},
{_LIKENESS},
alone AS (SELECT i, j, seq, generate_subscripts(z, 1) - 1 AS pos, unnest(z) AS z FROM (SELECT i, j, seq, list_concat(
  list_transform(gap1, lambda x: {{'x': x, 'y': '-'}}), list_transform(gap2, lambda x: {{'x': '-', 'y': x}})) AS z FROM short WHERE len(gap1) <> len(gap2))),
alt AS (SELECT i, j, seq, pos, CASE WHEN ratio >= 0.75 THEN 'Similar Bridge Word' ELSE 'Different Bridge Word' END AS variation_type, token_1, token_2 FROM equal JOIN rt USING (token_1, token_2)
  UNION ALL SELECT i, j, seq, pos, 'Different Bridge Word', z.x, z.y FROM alone)
SELECT i, j, seq, CAST(pos AS INTEGER) AS pos, coalesce(x.name, '') AS file_1, coalesce(y.name, '') AS file_2, variation_type, token_1, token_2
FROM alt JOIN docs x ON x.doc_idx = i JOIN docs y ON y.doc_idx = j""",
    "long_segments": f"WITH RECURSIVE {_TEXTS}, {_SEGMENTS} SELECT doc_idx, segment FROM seg",
    "similarity_summary": f"""WITH RECURSIVE {_TEXTS}, {_SEGMENTS}, {_RELATED},
ls AS (SELECT doc_idx, string_agg('"' || segment || '"', ' | ' ORDER BY length(segment) DESC, segment) AS s FROM seg GROUP BY doc_idx)
SELECT rec.doc_idx, coalesce(rec.name, '') AS document_filename, coalesce(g.n, 0) AS similarity_frequency, coalesce(r, 'None') AS related_documents, coalesce(s, 'None') AS long_similarities
FROM rec LEFT JOIN g ON g.i = rec.doc_idx LEFT JOIN ls USING (doc_idx)""",
    "pipeline_cutoff": f"""WITH {_weights(False)}, every AS (SELECT * FROM wt WHERE df > 1),
pairs AS (SELECT a.doc_idx AS i, b.doc_idx AS j, sum(a.w * b.w) AS score FROM every a JOIN every b ON a.feature = b.feature AND a.doc_idx < b.doc_idx GROUP BY ALL),
dg AS (SELECT count(DISTINCT doc_idx) AS diagonal FROM post),
{_otsu("SELECT score, 2 AS wgt FROM pairs UNION ALL SELECT 1.0, diagonal FROM dg")},
th AS (SELECT centre FROM cut ORDER BY v DESC, bin LIMIT 1)
SELECT diagonal, (SELECT count(*) FROM pairs) AS n_pairs, round(centre, 9) AS threshold, (SELECT count(*) FROM pairs WHERE score >= centre) AS n_kept FROM dg, th""",
    "corpus_scan": f"""SELECT doc_id AS doc_idx, CAST(length(t) AS INTEGER) AS n, md5(t) AS digest FROM (
SELECT doc_id, trim(regexp_replace(text, '{_WHITE}', ' ', 'g'), ' ') AS t FROM documents) WHERE length(t) >= 150""",
    "corpus_union": f"WITH {_CORPUS} SELECT 1 AS corpus, count(*) AS n_docs, count(text) AS n_texts FROM rec UNION ALL SELECT 2, count(*), count(text) FROM formulary",
    "corpus_limit_per_source": "SELECT doc_id, source FROM documents WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10",
    "ligature_fold": f"WITH {_CORPUS} SELECT doc_idx, {_FOLD} AS folded FROM rec",
    "bigram_normalize": f"WITH {_CORPUS} SELECT doc_idx, {_chain('lower(text)', parse_bigram_rules(BIGRAM_RULES).items())} AS reduced FROM rec",
    "phonetic_reduce": f"""WITH {_NORMED} SELECT doc_idx, translate(regexp_replace(norm_text, '[^{PHONETIC_ALPHABET}{''.join(_PHON)} ]', ' ', 'g'),
'{''.join(_PHON)}', '{''.join(_PHON.values())}') AS reduced FROM norm""",
    "lost_char_histogram": rf"""WITH {_CORPUS} SELECT ch, count(*) AS freq FROM (SELECT unnest(regexp_extract_all({_FOLD}, '(?s).')) AS ch FROM rec)
WHERE NOT regexp_matches(ch, '[a-z {''.join(SINGLE_LETTERS)}\x{{10000}}-\x{{10FFFF}}]') GROUP BY ch""",
    "learned_char_map": rf"""WITH {_CORPUS} SELECT ch AS src, translate(ch, '{''.join(_MAP)}', '{''.join(_MAP.values())}') AS dst, count(*) AS freq
FROM (SELECT unnest(regexp_extract_all({_FOLD}, '(?s).')) AS ch FROM rec)
WHERE NOT regexp_matches(ch, '[a-z {''.join(SINGLE_LETTERS)}]') AND strpos('{''.join(_MAP)}', ch) > 0 GROUP BY ch""",
    "normalize_text": f"WITH {_NORMED} SELECT doc_idx, norm_text FROM norm",
    "encoding_loss": f"""WITH {_CORPUS} SELECT doc_idx, CASE WHEN length(text) > 0 THEN
round(1 - length(regexp_replace(text, '[^a-z ]', '', 'g')) / length(text), 6) WHEN text IS NOT NULL THEN 0.0 END AS loss FROM rec""",
    "alphabet_sample": f"""WITH {_CORPUS} SELECT doc_idx, CASE WHEN text IS NOT NULL THEN array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?s).'))), '') END AS alphabet FROM rec""",
    "word_frequencies": f"WITH {_WORDS} SELECT word, freq FROM words",
    "longest_word": f"WITH {_WORDS} SELECT CAST(coalesce(max(length(word)), 0) AS INTEGER) AS n_letters FROM words",
    "sample_preview": rf"""WITH {_NORMED}, {_tokens(False)}, f AS (SELECT min(doc_idx) AS doc_idx FROM rec)
SELECT doc_idx, list_filter(regexp_split_to_array(norm_text, '\s+'), lambda w: w <> '')[1:25] AS words, tokens[1:25] AS tokens FROM norm JOIN f USING (doc_idx) JOIN tok USING (doc_idx)""",
    "frequent_words": f"WITH {_WORDS} SELECT word, freq FROM freq",
    "prefix_affixes": f"WITH {_AFFIXES} SELECT affix, CAST(sum(freq) AS BIGINT) AS c FROM pre GROUP BY affix",
    "suffix_affixes": f"WITH {_AFFIXES} SELECT affix, CAST(sum(freq) AS BIGINT) AS c FROM suf GROUP BY affix",
    "affix_counts": f"WITH {_AFFIXES}, {_BOTH} SELECT affix, c FROM cnt",
    "vocab_size_suggestion": f"""WITH {_AFFIXES}, {_BOTH},
run AS (SELECT c, sum(c) OVER (ORDER BY c DESC, affix ROWS UNBOUNDED PRECEDING) AS cum, sum(c) OVER () AS total FROM cnt),
k AS (SELECT coalesce(nullif(count(*) FILTER (cum - c < 0.85::DOUBLE * total), 0) + 256, 2000) AS s FROM run)
SELECT s AS suggested, least(s, (SELECT count(*) FROM words) + 256) AS capped FROM k""",
    "token_dictionary": f"WITH {_tokens(True)} SELECT token, token_id FROM dict",
    "encoded_docs": f"WITH {_tokens(True)} SELECT doc_idx, corpus, ids FROM ids",
    "ngram_windows": f"""WITH {_tokens(False)} SELECT doc_idx, CAST(pos AS INTEGER) AS pos, {', '.join(f'ids[pos + {k + 1}] AS x{k}' for k in range(6))}
FROM (SELECT doc_idx, ids, unnest(range(len(ids) - 5)) AS pos FROM ids WHERE len(ids) >= 6)""",
    "lno_hashes": f"WITH {_features(False)} SELECT doc_idx, pos, mask, feature FROM lno",
    "feature_tf": f"WITH {_features(True)} SELECT doc_idx, corpus, feature, tf FROM post",
    "document_frequency": f"WITH {_features(True)} SELECT feature, count(*) AS df FROM post GROUP BY feature",
    "smooth_idf": f"""WITH {_features(True)}, nn AS (SELECT count(*) AS n FROM tok)
SELECT df, count(*) AS n_features, round(ln((1 + any_value(n)) / (1 + df)) + 1, 9) AS idf FROM (SELECT feature, count(*) AS df FROM post GROUP BY feature), nn GROUP BY df""",
    "tfidf_weights": f"WITH {_weights(True)} SELECT doc_idx, corpus, feature, round(w, 9) AS w FROM wt",
    "copy_classes": f"WITH {_tokens(False)}, cls AS (SELECT tokens, min(doc_idx) AS class_id, count(*) AS n_docs FROM tok GROUP BY tokens) SELECT doc_idx, class_id, n_docs FROM tok JOIN cls USING (tokens)",
    "cosine_intra": f"WITH {_INTRA} SELECT i, j, score FROM pairs",
    "cosine_inter": f"""WITH {_weights(True)} SELECT a.doc_idx AS i, b.doc_idx AS j, round(sum(a.w * b.w), 8) AS score
FROM one a JOIN wt b ON a.feature = b.feature AND b.corpus = 2 GROUP BY ALL""",
    "cosine_above": f"WITH {_EVERY} SELECT i, j, score FROM pairs WHERE score >= 0.6",
    "topk_pairs": f"WITH {_EVERY} SELECT i, j, score FROM pairs ORDER BY score DESC, i, j LIMIT 20",
    "similarity_dense": f"""WITH {_STORED}, f AS (SELECT doc_idx FROM formulary),
cells AS (SELECT i, j, score FROM st WHERE i <> j UNION ALL SELECT j, i, score FROM st WHERE i <> j UNION ALL SELECT doc_idx, doc_idx, 1.0 FROM formulary WHERE len(list_filter(tokens, lambda t: t IS NOT NULL AND t <> '')) >= 6)
SELECT a.doc_idx AS i, b.doc_idx AS j, coalesce(score, 0.0) AS score FROM f a CROSS JOIN f b LEFT JOIN cells c ON c.i = a.doc_idx AND c.j = b.doc_idx""",
    "similarity_dense_corpus": f"""WITH {_STORED}, c AS (SELECT DISTINCT doc_idx FROM corpus WHERE doc_idx IS NOT NULL),
cells AS (SELECT i, j, score FROM st UNION ALL SELECT j, i, score FROM st WHERE i <> j)
SELECT c.doc_idx AS i, f.doc_idx AS j, coalesce(score, 0.0) AS score FROM c CROSS JOIN formulary f LEFT JOIN cells ON cells.i = c.doc_idx AND cells.j = f.doc_idx""",
    "stored_pairs": f"WITH {_STORED} SELECT i, j, score FROM st",
    "otsu_threshold": f"""WITH {_STORED}, {_otsu("SELECT score, CASE WHEN i = j THEN 1 ELSE 2 END AS wgt FROM st")}
SELECT round(centre, 9) AS threshold FROM cut ORDER BY v DESC, bin LIMIT 1""",
    "percentile_threshold": f"""WITH {_STORED} SELECT round(quantile_cont(score, 0.99), 9) AS threshold FROM (
SELECT score, unnest(range(CASE WHEN i = j THEN 1 ELSE 2 END)) FROM st)""",
    "score_filter_pairs": f"WITH {_STORED} SELECT i, j, score FROM st WHERE score >= 0.6 AND i <> j",
    "score_range": f"WITH {_STORED} SELECT i, j, score FROM st WHERE score BETWEEN 0.25 AND 0.75",
    "related_pairs": f"WITH {_STORED}, k AS (SELECT i, j FROM st WHERE score >= 0.6 AND i <> j) SELECT i AS doc_idx, j AS related FROM k UNION ALL SELECT j, i FROM k",
    "related_documents": f"""WITH {_STORED}, {_DOCS}, k AS (SELECT i, j FROM st WHERE score >= 0.6 AND i <> j),
d AS (SELECT i, j FROM k UNION ALL SELECT j, i FROM k),
g AS (SELECT i, count(*) AS n, string_agg(coalesce(name, ''), ', ' ORDER BY coalesce(name, '')) AS r FROM d JOIN docs ON docs.doc_idx = d.j GROUP BY i)
SELECT rec.doc_idx, coalesce(rec.name, '') AS name, coalesce(n, 0) AS n_related, coalesce(r, 'None') AS related FROM rec LEFT JOIN g ON g.i = rec.doc_idx""",
    "filename_year": f"WITH {_CORPUS} SELECT doc_idx, name, {_YEAR} AS year FROM rec",
    "chronological_pairs": f"""WITH {_STORED}, {_DOCS}, y AS (SELECT doc_idx, {_YEAR} AS year FROM docs),
p AS (SELECT i, j, score, a.year AS ya, b.year AS yb FROM st JOIN y a ON a.doc_idx = i JOIN y b ON b.doc_idx = j WHERE score >= 0.6 AND i <> j)
SELECT i, j, score, CASE WHEN ya > yb THEN j ELSE i END AS first, CASE WHEN ya > yb THEN i ELSE j END AS second,
least(ya, yb) AS year_first, greatest(ya, yb) AS year_second FROM p""",
    "fuzzy_ratio": f"""WITH RECURSIVE {_TEXTS}, {_WORDWISE}, {_LIKENESS}
SELECT token_1, token_2, round(ratio, 9) AS ratio, CASE WHEN ratio >= 0.75 THEN 'is-similar' ELSE 'is-dissimilar' END AS kind FROM rt""",
}
