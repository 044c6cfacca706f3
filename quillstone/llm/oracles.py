"""SQL that gives the same rows as the queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

#: Smallest node that each node reaches by links l (a, b), of nodes (id).
REACH = "walk(a, b) AS (SELECT id, id FROM nodes UNION SELECT w.a, l.b FROM walk w JOIN l ON l.a = w.b), lead AS (SELECT a AS id, min(b) AS component_id FROM walk GROUP BY a)"

LINE_FREQUENCY = rf"""
WITH d AS (SELECT doc_id, COALESCE('h' || source, '-') AS host, COALESCE(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, {WORDS.format("text")} AS ws FROM d),
base AS (SELECT doc_id, len(ws)::BIGINT AS n_words, COALESCE(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols FROM w),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM twice, range(0, 3) AS g(j) WHERE n > 1 GROUP BY doc_id),
lines AS (SELECT * FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM lines GROUP BY doc_id),
plain AS (SELECT doc_id, host, text, array_to_string({WORDS.format(f"translate(line, '{UPPER}123456789', '{LOWER}000000000')")}, ' ') AS k, len({WORDS.format("line")}) AS n FROM lines),
often AS (SELECT host, k FROM (SELECT host, k, count(DISTINCT text) AS n FROM plain GROUP BY host, k) JOIN (SELECT host, count(DISTINCT text) AS documents FROM d GROUP BY host) USING (host) WHERE n > 10 AND n > documents * 0.05),
lost AS (SELECT doc_id, sum(n)::BIGINT AS removed_words FROM plain JOIN often USING (host, k) GROUP BY doc_id),
f AS (SELECT doc_id, n_words, word_chars, n_symbols, COALESCE(n_dup_lines, 0) AS n_dup_lines, COALESCE(n_repeat_words, 0) AS n_repeat_words, COALESCE(removed_words, 0) AS removed_words FROM base LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed_words > 0 AND n_words - removed_words >= 0.3 * n_words AS kept FROM f"""

EMBEDDING_DEDUP = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), nodes AS (SELECT vec_id AS id FROM v),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
{REACH}
SELECT id AS vec_id, COALESCE(n, 0) AS n_links, component_id, id = component_id AS kept FROM lead LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) c ON c.a = id"""

JACCARD_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(f"translate(COALESCE(text, ''), '{UPPER}', '{LOWER}')")} AS ws FROM documents), nodes AS (SELECT doc_id AS id FROM w),
s AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS k FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
{REACH}
SELECT id AS doc_id, COALESCE(n, 0) AS n_shingles, component_id FROM lead LEFT JOIN n ON n.doc_id = id"""

LINE_DEDUP = rf"""
WITH l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
x AS (SELECT *, len({WORDS.format("line")}) AS words, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t FROM l),
y AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM x WHERE words > 0), z AS (SELECT *, e - words AS s FROM y),
f AS (SELECT doc_id, pos, s, e, CASE WHEN sum(words) OVER a >= 50 THEN sha256(array_to_string(list(t) OVER a, chr(10))) END AS on_key, max(e) OVER a AS on_end, CASE WHEN sum(words) OVER b >= 50 THEN sha256(array_to_string(list(t) OVER b, chr(10))) END AS back_key, min(s) OVER b AS back_start
 FROM z WINDOW a AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING), b AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
g AS (SELECT *, row_number() OVER (PARTITION BY on_key ORDER BY doc_id, s) > 1 AND on_key IS NOT NULL AS on_later, row_number() OVER (PARTITION BY back_key ORDER BY doc_id, s) > 1 AND back_key IS NOT NULL AS back_later FROM f),
m AS (SELECT *, max(CASE WHEN on_later THEN on_end END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reach, min(CASE WHEN back_later THEN back_start END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS first FROM g),
gone AS (SELECT doc_id, pos FROM m WHERE reach >= e OR first <= s),
kept AS (SELECT doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, string_agg(CASE WHEN g.pos IS NULL THEN line END, chr(10) ORDER BY pos) AS text FROM l LEFT JOIN gone g USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, COALESCE(n_lines, 0)::INTEGER AS n_lines, COALESCE(n_removed, 0)::INTEGER AS n_removed, CASE WHEN d.text IS NOT NULL THEN COALESCE(k.text, '') END AS text FROM documents d LEFT JOIN kept k USING (doc_id)"""

FILL_MIDDLE = """
WITH d AS (SELECT doc_id, COALESCE(text, '') AS text, sha256('1:' || COALESCE(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (SELECT *, length(text)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM g"""

#: Words that share what is left when one place is replaced by a mark, or lacks a letter that the other has.
SPELLING_VARIANTS = f"""
WITH RECURSIVE crc(i, k, v) AS (SELECT i, 0, i::BIGINT FROM range(0, 256) AS r(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc WHERE k < 8),
crcs AS (SELECT list(v ORDER BY i) AS t FROM crc WHERE k = 8),
runs AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents) WHERE length(w) >= 6 GROUP BY ALL),
bytes AS (SELECT *, hex(encode(COALESCE(doc_id::VARCHAR, '') || ':' || w)) AS b FROM runs),
hashed AS (SELECT w, c, xor(list_reduce(list_transform(range(0, length(b) // 2), lambda i: ('0x' || substring(b, 2 * i + 1, 2))::BIGINT), lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM bytes, crcs),
cut AS (SELECT c, CASE WHEN h % 199 = 0 THEN substring(w, 1, (h % length(w))) || substring(w, (h % length(w)) + 2) ELSE w END AS word FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
holes AS (SELECT word, n, unnest(list_distinct(list_transform(range(0, length(word)), lambda i: substring(word, 1, i) || '?' || substring(word, i + 2)))) AS k FROM words),
lacks AS (SELECT word, n, unnest(list_distinct(list_transform(range(0, length(word)), lambda i: substring(word, 1, i) || substring(word, i + 2)))) AS k FROM words),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.k = b.k AND a.word <> b.word UNION SELECT a.word, a.n, b.word, b.n FROM lacks a JOIN words b ON a.k = b.word UNION SELECT b.word, b.n, a.word, a.n FROM lacks a JOIN words b ON a.k = b.word),
best AS (SELECT word, n, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word, n),
forms AS (SELECT word, n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n FROM best),
walk(word, here) AS (SELECT word, word FROM words UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.here WHERE f.form IS NOT NULL),
roots AS (SELECT w.word, w.here AS root FROM walk w LEFT JOIN forms f ON f.word = w.here WHERE f.form IS NULL)
SELECT word, form, root, n, COALESCE(n_near, 0)::BIGINT AS n_near, form_n::BIGINT AS form_n FROM words LEFT JOIN forms USING (word) JOIN roots USING (word)"""
