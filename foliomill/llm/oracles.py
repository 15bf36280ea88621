"""DuckDB SQL for the results of the operators that SQL can express, by brute force.

The others (token ids, packing, language models and classifiers) are beyond
SQL and tested against brute-force versions in tests/llm.
"""

from __future__ import annotations

from foliomill.llm import license_scan, pii

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _templates() -> str:
    """Word pairs of phrases and templates as VALUES (tid, label, size, at, a, b)."""
    listed = [(i, label, words) for i, (words, label) in enumerate(license_scan.PHRASES.items())] + [(1000 + i, label, words) for i, (label, words) in enumerate(license_scan.TEMPLATES)]
    return ", ".join(f"({tid}, '{label}', {len(w) - 1}, {at}, '{w[at]}', '{w[at + 1]}')" for tid, label, words in listed for w in [words.split()] for at in range(len(w) - 1))


LICENSE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM documents),
templates(tid, label, size, spot, a, b) AS (VALUES {_templates()}),
pairs AS (SELECT r, unnest(range(0, len(w) - 1)) AS place, unnest(w[1:-2]) AS a, unnest(w[2:]) AS b FROM docs WHERE len(w) > 1),
votes AS (SELECT r, tid, label, size, place - spot AS diagonal, count(*) AS votes, min(place) AS first, max(place) AS last FROM pairs JOIN templates USING (a, b) GROUP BY ALL),
steps AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w <= 2 THEN 0 ELSE 1 END AS new FROM votes WINDOW w AS (PARTITION BY r, tid ORDER BY diagonal)),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY r, tid ORDER BY diagonal) AS g FROM steps),
spans AS (SELECT r, tid, label, size, g, sum(votes) AS votes, max(last) - min(first) + 1 AS length,
 count(*) FILTER (tid < 1000 AND votes = size) AS base, min(diagonal) FILTER (tid < 1000 AND votes = size) AS first, max(diagonal) FILTER (tid < 1000 AND votes = size) AS last FROM grouped GROUP BY ALL),
judged AS (SELECT *, least(1.0, votes / size) AS share, tid >= 1000 AND least(1.0, votes / size) >= 0.8 AND length <= 1.5 * size + 1 AS confirmed FROM spans),
found AS (SELECT r, sum(base) AS n_base, min(first) AS first_word, max(last) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base > 0) AS base_labels,
 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base > 0 OR confirmed) AS labels, max(CASE WHEN base > 0 THEN 1.0 WHEN confirmed THEN share END) AS score FROM judged GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
 coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM docs LEFT JOIN found USING (r)
"""

#: The base kinds' patterns in their plain form.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substring(reverse({_DIGITS}), i, 1) AS INTEGER)
 ELSE CAST(substring(reverse({_DIGITS}), i, 1) AS INTEGER) * 2 - CASE WHEN CAST(substring(reverse({_DIGITS}), i, 1) AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
_CODES = "list_transform(string_split(substring(replace(v, ' ', ''), 5) || substring(replace(v, ' ', ''), 1, 4), ''), lambda c: CASE WHEN ord(c) >= 65 THEN ord(c) - 55 ELSE ord(c) - 48 END)"
VALID = {
    "email": "true",
    "ip": "len(list_filter(string_split(v, '.'), lambda p: coalesce(TRY_CAST(p AS HUGEINT), 256) > 255)) = 0",
    "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
    "iban": f"list_reduce(list_prepend(0::BIGINT, {_CODES}), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1",
}


def _kind(number: int, kind: str) -> str:
    """Confirmed matches of a kind: r, k, kind, s, e, score."""
    score, words = pii.KINDS[kind][2:]
    near = f"lower(substring(text, greatest(s - {pii.NEAR}, 0) + 1, s - greatest(s - {pii.NEAR}, 0)) || ' ' || substring(text, s + length(v) + 1, {pii.NEAR}))"
    rated = f"SELECT r, {number} AS k, '{kind}' AS kind, s, s + length(v) AS e, round({score} + CASE WHEN regexp_matches({near}, '(^|[^a-z])({'|'.join(words)})') THEN 0.1 ELSE 0.0 END - CASE WHEN regexp_matches({near}, '(^|[^a-z])({'|'.join(pii.AGAINST)})') THEN 0.2 ELSE 0.0 END, 2) AS score"
    if kind == "iban":
        placed = r"""SELECT r, text, s, regexp_extract(substring(text, s + 1), '^([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?:$|[^A-Za-z0-9])', 1) AS v
 FROM (SELECT r, text, unnest(range(0, length(text))) AS s FROM docs WHERE regexp_matches(text, '[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11}'))
 WHERE NOT regexp_matches(substring(text, s, CASE WHEN s > 0 THEN 1 ELSE 0 END), '[A-Za-z0-9]')"""
        return f"{rated} FROM (SELECT * FROM ({placed}) WHERE v <> '') WHERE {VALID[kind]}"
    cut = f"SELECT r, text, string_split_regex(text, '{PLAIN[kind]}') AS p, regexp_extract_all(text, '{PLAIN[kind]}') AS m FROM docs WHERE regexp_matches(text, '{PLAIN[kind]}')"
    placed = f"SELECT r, text, unnest(m) AS v, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT[]) AS s FROM ({cut})"
    return f"{rated} FROM ({placed}) WHERE {VALID[kind]}"


PII = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({' UNION ALL '.join(_kind(i, k) for i, k in enumerate(pii.KINDS))}),
joined AS (SELECT r, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.KINDS)},
 string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY k, s) FILTER (kind <> 'iban') AS base,
 string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY k, s) AS spans, string_agg(CAST(CAST(score AS DOUBLE) AS VARCHAR), ',' ORDER BY k, s) AS scores, CAST(max(score) AS DOUBLE) AS score FROM found GROUP BY r)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in pii.KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores, coalesce(score, 0.0::DOUBLE) AS score
FROM docs LEFT JOIN joined USING (r)
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(v.x AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v ON v.vec_id <> q.vec_id AND len(v.x) = len(q.x) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored QUALIFY rank <= 10
"""


def _shingles(table: str, key: str) -> str:
    words = f"SELECT row_number() OVER () AS r, {key}, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM {table}"
    return f"SELECT {key}, r, len(w) AS n_words, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM ({words})"


LEAKS = f"""
WITH items AS (SELECT * FROM ({_shingles('benchmark', 'item_id')}) WHERE len(s) > 0), texts AS ({_shingles('documents', 'doc_id')}),
i AS (SELECT item_id, r AS ir, n_words, s AS item, unnest(s) AS x, unnest(range(0, len(s))) AS spot FROM items),
t AS (SELECT doc_id, r AS tr, s AS whole, unnest(s) AS x, unnest(range(0, len(s))) AS place FROM texts),
starts AS (SELECT DISTINCT doc_id, tr, item_id, ir, n_words, greatest(0, least(place - spot, len(whole) - len(item))) AS start FROM t JOIN i USING (x)),
windows AS (SELECT DISTINCT starts.doc_id, starts.item_id, starts.n_words, start, list_slice(texts.s, start + 1, start + len(items.s)) AS w, items.s AS item FROM starts JOIN texts ON texts.r = tr JOIN items ON items.r = ir),
shared AS (SELECT *, list_sum(list_transform(list_distinct(item), lambda h: least(len(list_filter(item, lambda y: y = h)), len(list_filter(w, lambda y: y = h))))) AS n FROM windows),
scored AS (SELECT doc_id, item_id, n_words, start, round(n / (len(w) + len(item) - n), 6) AS similarity, n / (len(w) + len(item) - n) AS exact FROM shared)
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start_word, CAST(n_words AS BIGINT) AS n_words, similarity FROM scored WHERE exact >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY exact DESC, start, n_words DESC) = 1
"""

NEAR = rf"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT r, doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM docs),
flat AS (SELECT r, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.r AS a, b.r AS b, a.n AS an, b.n AS bn, count(*) AS shared FROM flat a JOIN flat b ON a.x = b.x AND a.r < b.r WHERE least(a.n, b.n) * 100 >= 85 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (an + bn - shared)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT r AS a, r AS b FROM sets UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
least AS (SELECT reach.a AS r, min(sets.doc_id) AS component_id FROM reach JOIN sets ON sets.r = reach.b GROUP BY reach.a),
same AS (SELECT list_sort(s) AS s, min(doc_id) AS class_id FROM sets WHERE len(s) > 0 GROUP BY 1)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, CASE WHEN len(sets.s) = 0 THEN doc_id ELSE component_id END AS component_id, CASE WHEN len(sets.s) = 0 THEN doc_id ELSE class_id END AS class_id
FROM sets JOIN least USING (r) LEFT JOIN same ON list_sort(sets.s) = same.s
"""
