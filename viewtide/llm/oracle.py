"""DuckDB SQL for the queries that SQL can express; the others are tested by brute force."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE = r"'[^\x20\x09-\x0D]+'"

OP1 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER}, {SPACE}) AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 2], ' ') for i in range(1, len(ws) - 1)]) END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= 85 * (na.n + nb.n - m)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, v.b FROM r JOIN both_ways v ON r.b = v.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.least AS component_id, d.doc_id = c.least AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS least FROM r GROUP BY a) c ON c.a = d.doc_id
"""

OP3 = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
    len(regexp_extract_all(coalesce(text, ''), {SPACE})) AS size FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source),
placed AS (SELECT *, ([5, 2, 1])[place % 3 + 1] AS weight, 3 * source_size AS lim FROM src),
rest AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(lim) OVER before, 0) AS l,
    sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS sh
  FROM placed WINDOW before AS (ORDER BY lim / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (SELECT l AS free_l, sh AS free_sh FROM rest WHERE l * weight <= lim * sh ORDER BY lim / weight, place LIMIT 1),
tgt AS (
  SELECT source, source_size, CASE WHEN l * weight > lim * sh OR free_sh IS NULL THEN CAST(lim AS DOUBLE)
    ELSE least(CAST(free_l * weight AS DOUBLE) / CAST(free_sh AS DOUBLE), CAST(lim AS DOUBLE)) END AS target
  FROM rest LEFT JOIN free ON true),
pos AS (
  SELECT d.*, t.source_size, t.target,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS supply
  FROM sized d JOIN tgt t ON d.source IS NOT DISTINCT FROM t.source),
part AS (
  SELECT *, target - passes * source_size AS part FROM (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM pos)),
fits AS (
  SELECT doc_id, source, k, size, source_size, target, passes, part, false AS used, 40 AS level FROM part
  UNION ALL
  SELECT doc_id, source, k, size, source_size, target, passes, part, used OR (fit AND before + size <= gap), level - 1 FROM (
    SELECT *, coalesce(sum(CASE WHEN fit THEN size ELSE 0 END) OVER (
      PARTITION BY source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
      SELECT *, NOT used AND size > 0 AND size <= 1::BIGINT << level AND gap >= 1::BIGINT << level AND gap < 2::BIGINT << level AS fit FROM (
        SELECT *, part - sum(CASE WHEN used THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM fits WHERE level >= 0)))),
gaps AS (
  SELECT *, part - sum(CASE WHEN used THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM fits WHERE level = -1),
fill AS (
  SELECT *, CASE WHEN NOT used AND size > 0 AND part > 0 AND abs(gap - size) < gap THEN
    row_number() OVER (PARTITION BY source, NOT used AND size > 0 AND part > 0 AND abs(gap - size) < gap
                       ORDER BY abs(gap - size), k, doc_id) END AS f FROM gaps)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN size > 0 THEN (passes + CASE WHEN used OR f = 1 THEN 1 ELSE 0 END) * size ELSE 0 END AS BIGINT) AS taken
FROM fill
"""

_GRAMS = "".join(rf""",
g{n} AS (
  SELECT doc_id, i, len(x) AS c, count(*) OVER (PARTITION BY doc_id, g) > 1 AND g IS NOT NULL AS rep FROM (
    SELECT doc_id, i, x, CASE WHEN i + {n - 1} <= n THEN array_to_string(ws[i:i + {n - 1}], ' ') END AS g FROM u)),
c{n} AS (
  SELECT doc_id, count(*) FILTER (hit) AS words, coalesce(sum(c) FILTER (hit), 0) AS chars FROM (
    SELECT doc_id, c, max(rep) OVER near AS hit
    FROM g{n} WINDOW near AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW))
  GROUP BY doc_id)""" for n in range(5, 11))
_LIMITS = " AND ".join(f"100 * coalesce(c{n}.chars, 0) <= {most} * word_chars" for n, most in
                       ((5, 15), (6, 14), (7, 13), (8, 12), (9, 11), (10, 10)))

OP6 = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {SPACE}) AS ws FROM documents),
u AS (SELECT doc_id, ws, len(ws) AS n, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w){_GRAMS},
lines AS (
  SELECT doc_id, line, k, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS r FROM (
    SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM w)
  WHERE regexp_matches(line, {SPACE})),
dup AS (
  SELECT doc_id, count(*) AS n_dup, sum(len(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS chars
  FROM lines WHERE r > 1 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum([len(x) for x in ws]), 0) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.n_dup, 0) AS n_dup_lines,
    coalesce(c5.words, 0) AS n_repeat_words, coalesce(dup.chars, 0) AS dup_chars
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN c5 USING (doc_id))
SELECT m.doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND (n_words < 200 OR {_LIMITS})
    AND 100 * dup_chars <= 20 * word_chars AND 100 * n_symbols <= 10 * word_chars AS kept
FROM m {" ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in range(5, 11))}
"""

OP7 = r"""
WITH toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
c AS (
  SELECT source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens,
    len(coalesce(text, '')) AS chars, doc_id FROM documents
  UNION ALL
  SELECT source, lang, 'pieces-1',
    len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[0-9]|[^\x00-\x7F]+|[!-/:-@\[-`{-~]')),
    len(coalesce(text, '')), doc_id FROM documents)
SELECT source, lang, tokenizer, count(*) AS docs, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(chars) AS BIGINT) AS chars
FROM c WHERE doc_id NOT IN (SELECT doc_id FROM toxic WHERE doc_id IS NOT NULL) GROUP BY 1, 2, 3
"""

_LETTERS = "unnest(['A', 'B', 'C', 'D', 'E'])"

OP11 = rf"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x,
    regexp_extract_all(coalesce(text, ''), {SPACE}) AS ws FROM documents),
f AS (
  SELECT doc_id, part, [CASE WHEN len(ws) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' END,
    CASE WHEN 100 * len(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * len(x) THEN 'C' END,
    CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' END,
    CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY x) THEN 'E' END] AS failed FROM t),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, list_filter(failed, lambda c: c IS NOT NULL) AS failed, count(*) AS docs,
    count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
letters AS (SELECT {_LETTERS} AS c),
orders AS (
  SELECT a.c || b.c || d.c || e.c || g.c AS filter_order FROM letters a, letters b, letters d, letters e, letters g
  WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
s AS (
  SELECT part, filter_order, step, filter_order[step] AS c,
    list_has_any(failed, string_split(filter_order[1:step - 1], '')) AS gone, list_contains(failed, filter_order[step]) AS fails,
    len(failed) AS n, docs, good, toxic FROM m, steps),
r AS (
  SELECT part, filter_order, step, c, CAST(coalesce(sum(docs) FILTER (NOT gone AND NOT fails), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(docs) FILTER (NOT gone AND fails), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(docs) FILTER (gone AND fails), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(docs) FILTER (fails AND n = 1), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (NOT gone AND fails), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (NOT gone AND fails), 0) AS BIGINT) AS toxic_lost
  FROM s GROUP BY part, filter_order, step, c)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley FROM r
"""

OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS u
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(list_dot_product(a.u, b.u) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score,
  score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY rank <= 10
"""

ORACLE = {"op1_near_dedup": OP1, "op3_source_mixing": OP3, "op6_quality_rules": OP6, "op7_token_counts": OP7,
          "op11_filter_audit": OP11, "op13_hard_negatives": OP13}
