"""DuckDB SQL of the operators that SQL can express, over the driver's tables."""

OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT r, g FROM win GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM win JOIN twice USING (r, g)) GROUP BY 1),
c AS (SELECT w.r, doc_id, len(w) AS n_words,
 coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
 coalesce(n, 0) AS n_repeat_words, w, l FROM w LEFT JOIN covered USING (r)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 n_symbols > 0.25 * n_words OR len(list_filter(w, lambda x: regexp_full_match(x, '[\p{Lu}\p{P}]{2,}'))) > 0.4 * n_words
 OR len(list_filter(w, lambda x: x LIKE '%!!')) > 0.2 * n_words OR len(list_filter(w, lambda x: x = '|')) > 0.2 * n_words
 OR len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) > 0.2 * n_words OR word_chars > 40 * n_words OR 2 * n_dup_lines > len(l) AS rejected FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM v
"""

OP5 = r"""
WITH raw AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT r, doc_id, i - 1 AS line, regexp_extract_all(l[i], '[^\x20\x09-\x0D]+') AS w
 FROM (SELECT r, doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM raw)),
told AS (SELECT r, doc_id, line, w, len(w) AS n FROM lines WHERE len(w) >= 1),
classes AS (SELECT w, n, min({'d': doc_id, 'l': line}) AS first FROM told GROUP BY 1, 2),
long AS (SELECT w, n, first FROM classes WHERE n >= 6),
cut AS (SELECT w, first, i, list_concat(w[1:i - 1], w[i + 1:n]) AS v FROM (SELECT w, n, first, unnest(range(1, n + 1)) AS i FROM long)),
keys AS (SELECT w, first, 0 AS kind, md5(array_to_string(w, chr(1))) AS k FROM long
 UNION ALL SELECT w, first, 1, md5(array_to_string(v, chr(1))) FROM cut
 UNION ALL SELECT w, first, 2, md5(i || chr(2) || array_to_string(v, chr(1))) FROM cut),
gone AS (SELECT DISTINCT a.w FROM keys a JOIN keys b
 ON a.k = b.k AND b.first < a.first AND ((a.kind = 0 AND b.kind = 1) OR (a.kind = 1 AND b.kind = 0) OR (a.kind = 2 AND b.kind = 2))),
lost AS (SELECT r, list(line) AS lost FROM told JOIN classes USING (w, n) LEFT JOIN gone g ON g.w = told.w
 WHERE g.w IS NOT NULL OR classes.first < {'d': doc_id, 'l': line} GROUP BY 1),
kept AS (SELECT doc_id, len(l) AS n_lines, coalesce(len(lost), 0) AS n_dropped,
 array_to_string(list_filter(l, lambda x, i: lost IS NULL OR NOT list_contains(lost, i - 1)), chr(10)) AS text FROM raw LEFT JOIN lost USING (r))
SELECT doc_id, n_lines, n_dropped, length(text) AS n_chars_kept, sha256(text) AS text_sha256 FROM kept
"""

OP9 = r"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT *, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) + 1 AS tokens,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place FROM raw),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY place) AS upto, greatest(512 - 128 - max(CASE WHEN place = 0 AND role = 'system' THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id), 128) AS room FROM t),
starts AS (SELECT conv_id, place, upto - tokens AS base, room FROM u WHERE place = 0
 UNION ALL SELECT conv_id, place, base, room FROM (
 SELECT u.conv_id, u.place, u.upto - u.tokens AS base, u.room, row_number() OVER (PARTITION BY s.conv_id, s.place ORDER BY u.place) AS nearest
 FROM starts s JOIN u ON u.conv_id = s.conv_id AND u.place > s.place AND u.upto > s.base + s.room) WHERE nearest = 1),
spans AS (SELECT conv_id, place AS first, lead(place) OVER v AS next_first, lead(base) OVER v AS next_start
 FROM starts WINDOW v AS (PARTITION BY conv_id ORDER BY place)),
ends AS (SELECT conv_id, count(*) AS last FROM spans GROUP BY 1),
shown AS (SELECT u.conv_id, place, role, text,
 1 + CASE WHEN next_start IS NOT NULL AND NOT (place = 0 AND role = 'system') AND next_start - upto + tokens <= 128 THEN 1 ELSE 0 END
 + CASE WHEN place = 0 AND role = 'system' THEN last - 1 ELSE 0 END AS times
 FROM u JOIN spans s ON u.conv_id = s.conv_id AND place >= first AND (next_first IS NULL OR place < next_first) JOIN ends e ON e.conv_id = u.conv_id),
esc AS (SELECT *, length('<|turn|><|text|><|end|>') + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS chars
 FROM shown),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY place) AS told,
 coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS loss, sum(times * chars)::BIGINT AS formatted_chars FROM esc GROUP BY 1)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY 1),
total AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM groups LEFT JOIN c USING (lang, source) GROUP BY ALL),
whole AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n)::HUGEINT + 1) // (any_value(s.total) + any_value(v)) AS q
 FROM c JOIN (SELECT lang, sum(total) AS total FROM total GROUP BY 1) s USING (lang) JOIN v USING (lang) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (total + v) AS p
 FROM total g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
 FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
 UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
