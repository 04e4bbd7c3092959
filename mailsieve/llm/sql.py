"""DuckDB SQL for the queries whose results SQL can express."""

OP10 = r'''
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
k AS (SELECT sh AS st, min(doc_id) AS rep, len(sh) AS n FROM (SELECT doc_id, list_sort(sh) AS sh FROM s WHERE len(sh) > 0) GROUP BY sh),
x AS (SELECT rep, n, unnest(st) AS g FROM k),
p AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.rep <> b.rep GROUP BY a.rep, b.rep),
l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c)),
r(node, low) AS (SELECT rep, rep FROM k UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.node WHERE r.low < l.b),
m AS (SELECT node, min(low) AS low FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(m.low, s.doc_id) AS component_id, coalesce(m.low, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN k ON k.st = list_sort(s.sh) LEFT JOIN m ON m.node = k.rep
'''

OP2 = r'''
WITH w AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, line_no, regexp_extract_all(raw, '[^\x20\x09-\x0D]+') AS ws FROM w),
o AS (SELECT doc_id, line_no, ws, array_to_string(ws, ' ') AS line FROM l WHERE len(ws) > 0),
d AS (SELECT line, any_value(ws) AS ws, min({'d': doc_id, 'l': line_no}) AS spot FROM o GROUP BY line),
v AS (SELECT line, spot, len(ws) AS n, p, array_to_string(list_concat(ws[1:p - 1], ws[p + 1:]), ' ') AS rest FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS p FROM d WHERE len(ws) >= 2)),
k AS (
  SELECT a.line, b.line AS other, b.spot AS near FROM v a JOIN v b ON a.rest = b.rest AND a.p = b.p AND a.n = b.n AND a.line <> b.line
  UNION SELECT a.line, b.line, b.spot FROM v a JOIN d b ON a.rest = b.line
  UNION SELECT b.line, a.line, a.spot FROM v a JOIN d b ON a.rest = b.line),
m AS (SELECT line, count(DISTINCT other) AS n_links, min(near) AS near FROM k GROUP BY line),
g AS (SELECT d.line, CASE WHEN m.near < d.spot THEN m.near ELSE d.spot END AS keeper, coalesce(m.n_links, 0) AS n_links FROM d LEFT JOIN m USING (line))
SELECT o.doc_id, o.line_no, (o.doc_id = g.keeper.d AND o.line_no = g.keeper.l) AS kept, g.keeper.d AS keeper_doc_id, g.keeper.l AS keeper_line, g.n_links FROM o JOIN g USING (line)
'''

OP7 = r'''
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1),
n AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) t(k) GROUP BY doc_id),
p AS (SELECT doc_id, x, ws, ls, list_filter(ls, lambda y:
    length(regexp_replace(y, '[^#*$%&|<>]+', '', 'g')) * 20 <= length(y) AND (length(y) < 40 OR regexp_matches(right(rtrim(y), 8), @ENDINGS@)) AND NOT suffix(rtrim(y), '!!')
    AND length(y) - length(replace(y, '|', '')) < 3 AND NOT (length(y) <= 200 AND list_contains(@MENU@, lower(trim(y))))
    AND (length(y) > 200 OR NOT regexp_matches(lower(y), @BOILERPLATE@)) AND NOT (length(y) >= 40 AND y = upper(y) AND y <> lower(y))) AS ok FROM w),
f AS (SELECT p.doc_id, CAST(len(ws) AS BIGINT) AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n.n, 0) AS n_repeat_words, length(regexp_replace(array_to_string(ok, chr(10)), '[\x20\x09-\x0D]+', '', 'g')) AS kept_chars FROM p LEFT JOIN n ON n.doc_id = p.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * kept_chars >= 50 * word_chars AS kept FROM f
'''

OP8 = r'''
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE r % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight, CASE r % 3 WHEN 0 THEN 0.5e0 WHEN 1 THEN 0e0 ELSE -0.5e0 END AS tilt, row_number() OVER (ORDER BY n / CAST(CASE r % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE), r) AS k FROM s),
c AS (SELECT *, sum(2 * n) OVER (ORDER BY k) AS full_before, sum(weight) OVER (ORDER BY k DESC) AS open_weight, 1.5e0 * sum(n) OVER () AS total FROM w),
u AS (SELECT arg_min((total - (full_before - 2 * n)) / open_weight, k) FILTER (WHERE (total - (full_before - 2 * n)) / open_weight * weight <= 2 * n) AS unit, count(*) AS c FROM c),
a AS (SELECT source, n, tilt, least(CAST(2 * n AS DOUBLE), u.unit * weight) AS target FROM c, u),
p AS (SELECT d.doc_id, d.size, a.n AS source_size, a.target, a.tilt, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY CAST('0x' || substr(d.o, 1, 5) AS INT) % 1024, d.o ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS b FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source),
q AS (SELECT *, greatest(0, least(size, CAST(floor(target) AS BIGINT) - b)) AS t1, greatest(0, least(size, CAST(floor(target) AS BIGINT) - b - source_size)) AS t2 FROM p)
SELECT doc_id, size, source_size, round(target, 4) AS target, CAST(t1 + t2 AS BIGINT) AS taken, CASE WHEN t1 > 0 THEN round(2 * b / target / ((1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * b / target)), 6) END AS position, CAST((t1 > 0) AS INT) + CAST((t2 > 0) AS INT) AS passes FROM q
'''


def _filled(text: str) -> str:
    from .rules import BOILERPLATE, ENDINGS, MENU

    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return text.replace("@ENDINGS@", quote(ENDINGS)).replace("@MENU@", "[" + ", ".join(map(quote, MENU)) + "]").replace("@BOILERPLATE@", quote("|".join(BOILERPLATE)))


ORACLES = {"op2_line_dedup": OP2, "op7_line_first_rules": _filled(OP7), "op8_curriculum_mixture": OP8, "op10_minhash_odd_sketch": OP10}
