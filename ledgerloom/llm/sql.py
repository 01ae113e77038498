"""DuckDB SQL for the operators that SQL can express, written apart from the operators' code."""

DECONTAMINATE = r"""
WITH words AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents
  UNION ALL
  SELECT 'i', row_number() OVER (), item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM benchmark),
shingled AS (
  SELECT side, r, id, unnest(list_distinct(
    [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, greatest(len(w) - 3, 2))])) AS s
  FROM words WHERE len(w) > 0),
sets AS (
  SELECT r, any_value(id) AS item_id, list_sort(list(s)) AS ss FROM shingled WHERE side = 'i' GROUP BY r),
classes AS (
  SELECT min(item_id) AS item_id, count(*) AS items, len(ss) AS n, ss FROM sets GROUP BY ss),
wanted AS (
  SELECT item_id, items, n, unnest(ss) AS s FROM classes),
found AS (
  SELECT d.r, d.id AS doc_id, w.item_id, w.items, w.n, count(*) AS n_found
  FROM shingled d JOIN wanted w ON w.s = d.s WHERE d.side = 'd' GROUP BY ALL)
SELECT doc_id, item_id, items, n AS n_shingles, n_found, n_found / n AS containment
FROM found WHERE n_found >= 0.8 * n
"""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    CAST('0x' || substr(md5('mix-1 ' || coalesce(doc_id::VARCHAR, 'text ' || text, 'none')), 1, 13) AS BIGINT) AS draw
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][(place % 3 + 1)::INT] AS weight FROM totals),
levels AS (
  SELECT *, ((sum(source_size) OVER ()) - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE
    / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM weighed
  WINDOW before AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0.0::DOUBLE END AS rate FROM targets),
met AS (
  SELECT s.doc_id, s.source, s.size, s.draw, r.source_size, r.target, floor(r.rate) AS whole, r.rate - floor(r.rate) AS part
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source),
tried AS (
  SELECT source, turn, abs(sum(size * (whole + ((draw + turn * 140737488355328) % 4503599627370496 / 4503599627370496.0::DOUBLE < part)::INT)) - any_value(target)) AS far
  FROM met, range(32) t(turn) GROUP BY source, turn),
best AS (
  SELECT source, arg_min(turn, (far, turn)) AS turn FROM tried GROUP BY source)
SELECT doc_id, size, source_size, target,
  (size * (whole + ((draw + turn * 140737488355328) % 4503599627370496 / 4503599627370496.0::DOUBLE < part)::INT))::BIGINT AS taken
FROM met m JOIN best b ON m.source IS NOT DISTINCT FROM b.source
"""

FILL_MIDDLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
drawn AS (
  SELECT doc_id, text, u, len(u) AS n, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN range(4)] AS d FROM cut),
placed AS (
  SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 90 THEN 'plain'
      WHEN d[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parted AS (
  SELECT *, coalesce(array_to_string(u[1 : a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1 : b], ''), '') AS middle,
    coalesce(array_to_string(u[b + 1 : n], ''), '') AS suffix
  FROM placed)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parted
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
listed AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM listed GROUP BY lang),
grams AS (
  SELECT lang, m, unnest([array_to_string(w[i : i + m - 1], ' ') FOR i IN range(1, greatest(len(w) - m + 2, 1))]) AS phrase
  FROM listed, range(1, 4) t(m)),
counted AS (
  SELECT lang, m, phrase, string_split(phrase, ' ') AS w, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT lang, m, phrase, f AS a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 : m], ' ') AS tail
  FROM counted, range(1, 3) t(k) WHERE k < m),
scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.k, h.f AS l, t.f AS r, ((1000000::HUGEINT * c.a * c.a) // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM cuts c JOIN counted h ON h.lang = c.lang AND h.phrase = c.head JOIN counted t ON t.lang = c.lang AND t.phrase = c.tail),
weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, f, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS phrase FROM counted WHERE m = 3),
most AS (
  SELECT lang, phrase, max(f) AS f FROM longer GROUP BY lang, phrase)
SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY w.score DESC, w.a DESC, w.phrase) AS rank, w.phrase, w.a, w.l, w.r, s.n, w.score
FROM weakest w JOIN sizes s ON s.lang = w.lang LEFT JOIN most x ON x.lang = w.lang AND x.phrase = w.phrase AND w.m = 2
WHERE x.f IS NULL OR 100 * x.f < 50 * w.a
QUALIFY rank <= 2000
"""
