"""DuckDB SQL for the queries that SQL can express, over the same tables."""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANKS = r"'[^\x20\x09-\x0D]+'"
LETTERS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

DECONTAMINATION = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all({LOWERED}, {LETTERS}) AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({LOWERED}, {LETTERS}) AS w FROM benchmark),
sized AS (SELECT item_id, w, least(13, len(w)) AS n FROM items WHERE len(w) > 0),
item_windows AS (SELECT DISTINCT item_id, n, w[p:p + n - 1] AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM sized)),
doc_windows AS (
  SELECT doc_id, p, n, w[p:p + n - 1] AS g FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)),
found AS (SELECT d.doc_id, d.p, d.n, i.item_id FROM doc_windows d JOIN item_windows i ON i.n = d.n AND i.g = d.g),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS pos FROM found) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (
  SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

REACH = """
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, other) AS (SELECT a, b FROM both_ways UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON l.a = r.other),
component AS (SELECT node, least(node, min(other)) AS component_id FROM reach GROUP BY node)"""

PIVOT_INDEX = f"""
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),{REACH}
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM both_ways GROUP BY a) ON a = vec_id LEFT JOIN component ON node = vec_id"""

LINES = """
WITH lines AS (
  SELECT doc_id, line - 1 AS line, list_sort(list_distinct(list_filter(string_split(lower(parts[line]), ' '), lambda x: x <> ''))) AS w
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))),
classes AS (SELECT w, min((doc_id, line)) AS place, row_number() OVER (ORDER BY min((doc_id, line))) AS id, len(w) AS n FROM lines WHERE len(w) > 0 GROUP BY w),
tokens AS (SELECT id, n, unnest(w) AS token FROM classes),
frequency AS (SELECT token, count(*) AS f FROM tokens GROUP BY token),
places AS (SELECT id, n, token, row_number() OVER (PARTITION BY id ORDER BY f, token) AS place FROM tokens JOIN frequency USING (token)),
prefixes AS (SELECT * FROM places WHERE place <= n - ceil(0.8 * n) + 1),
candidates AS (SELECT DISTINCT a.id AS early, b.id AS late FROM prefixes a JOIN prefixes b ON a.token = b.token AND a.id < b.id WHERE 10 * a.n >= 8 * b.n AND 10 * b.n >= 8 * a.n),
later AS (SELECT DISTINCT late FROM (
  SELECT c.late, len(list_intersect(a.w, b.w)) AS shared, a.n + b.n AS both_n FROM candidates c JOIN classes a ON a.id = c.early JOIN classes b ON b.id = c.late)
  WHERE 100 * shared >= 80 * (both_n - shared)),
gone AS (SELECT l.doc_id, l.line FROM lines l JOIN classes c ON l.w = c.w WHERE c.id IN (SELECT late FROM later) OR (l.doc_id, l.line) <> c.place),
of_doc AS (SELECT doc_id, count(*) AS n_removed, list(CAST(line AS INTEGER) ORDER BY line) AS removed FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS INTEGER) AS n_lines, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed,
  coalesce(array_to_string(removed, ','), '') AS removed_lines
FROM documents LEFT JOIN of_doc USING (doc_id)"""

SUBSTRINGS = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {BLANKS}) AS w FROM documents),
windows AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM docs WHERE len(w) >= 50)),
first AS (SELECT g, min(doc_id) AS least FROM windows GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS pos FROM windows JOIN first USING (g) WHERE least < doc_id),
words AS (SELECT doc_id, pos, w[pos] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM docs)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM (SELECT * FROM words ANTI JOIN gone USING (doc_id, pos)) GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN counted USING (doc_id) LEFT JOIN kept USING (doc_id)"""

MINHASH = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({LOWERED}, {BLANKS}) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS p FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL)
  JOIN sizes m ON m.doc_id = a JOIN sizes k ON k.doc_id = b WHERE 100 * shared >= 85 * (m.n + k.n - shared)),{REACH}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM docs d LEFT JOIN sizes USING (doc_id) LEFT JOIN component ON node = d.doc_id"""

#: crc32 of a text of ASCII characters, by its table.
CRC = """
rounds(i, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM rounds WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM rounds WHERE k = 8)"""


def scoring(strength: float) -> str:
    return rf"""
WITH RECURSIVE {CRC},
folds AS (SELECT doc_id, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 7 = 2 AS held_out FROM documents, crc),
docs AS (SELECT doc_id, held_out, list_append(regexp_extract_all({LOWERED}, {BLANKS}), ' ') AS w FROM folds),
tokens AS (SELECT doc_id, held_out, w[pos] AS token, CASE WHEN pos = 1 THEN '' ELSE w[pos - 1] END AS before FROM (SELECT *, unnest(range(1, len(w) + 1)) AS pos FROM docs)),
one AS (SELECT token, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY 1),
two AS (SELECT before, token, count(*) AS n FROM tokens WHERE NOT held_out GROUP BY ALL),
states AS (SELECT before, sum(n) AS c FROM two GROUP BY 1),
totals AS (SELECT sum(c) AS total, count(*) AS words FROM one),
scored AS (
  SELECT doc_id, held_out, coalesce(o.c, 0) AS c, total, (coalesce(o.c, 0) + 1.0) / (total + words + 1.0) AS share, coalesce(n, 0) AS arc, coalesce(s.c, 0) AS state
  FROM tokens t LEFT JOIN one o USING (token) LEFT JOIN two USING (before, token) LEFT JOIN states s USING (before), totals)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, CAST(min(total) AS BIGINT) AS train_tokens,
  round(sum(log10(share)), 6) AS base_score, round(sum(log10((arc + {strength} * share) / (state + {strength}))), 6) AS score
FROM scored GROUP BY doc_id, held_out"""

PHRASES = rf"""
WITH pieces AS (
  SELECT lang, unnest(pieces) AS piece FROM (
    SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array({LOWERED}, '[.,;:!?\x0A-\x0D]') AS pieces FROM documents)),
spans AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, array_to_string(w[p:p + k - 1], ' ') AS phrase, w[p:p + k - 1] AS g
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM spans, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
counts AS (SELECT lang, k, phrase, any_value(g) AS g, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang),
frequent AS (SELECT * FROM counts WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, k, phrase, g, f AS a, unnest(range(1, k)) AS c FROM frequent),
valued AS (
  SELECT x.*, l.f AS l, r.f AS r, CAST((1000000 * CAST(x.a AS HUGEINT) * x.a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cuts x JOIN counts l ON l.lang = x.lang AND l.phrase = array_to_string(x.g[1:x.c], ' ')
  JOIN counts r ON r.lang = x.lang AND r.phrase = array_to_string(x.g[x.c + 1:x.k], ' ')),
least AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (SELECT lang, unnest([array_to_string(g[1:2], ' '), array_to_string(g[2:3], ' ')]) AS phrase, f FROM frequent WHERE k = 3),
longer AS (SELECT lang, phrase, max(f) AS f FROM inside GROUP BY ALL),
left_over AS (SELECT x.* FROM least x LEFT JOIN longer y ON x.k = 2 AND y.lang = x.lang AND y.phrase = x.phrase WHERE y.f IS NULL OR 100 * y.f < 50 * x.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM left_over JOIN totals USING (lang) QUALIFY rank <= 2000"""

NEGATIVES = """
WITH rows AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.id % 50 = 0 AND a.id <> b.id AND len(a.v) = len(b.v)),
positives AS (SELECT anchor_id, id, score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW best AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) QUALIFY rank <= 3"""
