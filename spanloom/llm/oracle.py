"""DuckDB SQL for the queries that SQL can express."""

# A-Z as a-z, the separators as spaces, cut at spaces
WORDS = """regexp_split_to_array(trim(translate(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
 'abcdefghijklmnopqrstuvwxyz'), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), ' +')"""

OVERLAP_JOIN = f"""WITH RECURSIVE docs AS (
 SELECT doc_id, list_filter({WORDS}, lambda w: w <> '') AS w FROM documents),
shingles AS (
 SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
   WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
met AS (
 SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
 SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
 SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM docs d LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM edges GROUP BY a) USING (doc_id) LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)"""

PHRASES = """WITH pieces AS (
 SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9),
  'abcdefghijklmnopqrstuvwxyz '), '[.,;:!?\\n\\x0b\\x0c\\r]')) AS p FROM documents),
words AS (SELECT lang, list_filter(string_split(p, ' '), lambda w: w <> '') AS w FROM pieces),
grams AS (
 SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
 FROM words, (VALUES (1), (2), (3)) t(k)),
counted AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang),
frequent AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE f >= 10),
parts AS MATERIALIZED (
 SELECT lang, phrase, f AS a, 1 AS cut, w[1] AS left_part, array_to_string(w[2:], ' ') AS right_part FROM frequent WHERE k > 1
 UNION ALL SELECT lang, phrase, f, 2, array_to_string(w[1:2], ' '), w[3] FROM frequent WHERE k = 3),
cuts AS (
 SELECT c.lang, c.phrase, a, cut, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
 FROM parts c JOIN frequent x ON x.lang = c.lang AND x.phrase = left_part JOIN frequent y ON y.lang = c.lang AND y.phrase = right_part),
least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
 SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, f FROM frequent WHERE k = 3),
longer AS (SELECT lang, phrase, max(f) AS f FROM inside GROUP BY lang, phrase),
ranked AS (
 SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, n, score::BIGINT AS score
 FROM least s JOIN totals USING (lang) LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase
 WHERE g.f IS NULL OR 100 * g.f < 50 * a)
SELECT * FROM ranked WHERE rank <= 2000"""

# the table of the checksum follows from its polynomial; the text is folded byte by byte
SHARDING = """WITH RECURSIVE crc(i, k, c) AS (
 SELECT i, 0, i FROM range(256) t(i)
 UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM crc WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
sized AS (
 SELECT doc_id, text, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS (
 SELECT doc_id, size, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(0, size - 16),
   lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32
 FROM sized, crc_table),
placed AS (
 SELECT *, sum(size) OVER w - size AS before, sum(size) OVER () AS total FROM sums
 WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
cut AS (
 SELECT *, least(((2 * before + size) * 40 // (2 * total))::INT, 39) AS shard FROM placed)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
 row_number() OVER (PARTITION BY shard ORDER BY before) - 1 AS slot, NULL::INT AS grown_shard FROM cut"""

_CELLS = ["[aeiou]", "[b-df-hj-np-tv-z]", "[A-Z]", "[0-9]", "[ \\t]", "[\\r\\n\\x0b\\x0c]", "[.,;:?!''\"()-]", "[#*$%&|<>]", "[^\\x00-\\x7F]"]


def quality_rules_sql(words: list[str], limits: dict[str, float]) -> str:
    """The counts, the references of all languages and the least distances, over whole tables."""

    counted = [f"length(t) - length(regexp_replace(t, '{c}', '', 'g'))" for c in _CELLS]
    cells = ", ".join(counted[:8] + [f"length(t) - ({' + '.join(f'({c})' for c in counted)})", counted[8]])
    common = ", ".join(f"('{w}')" for w in words)

    def distance(name: str) -> str:
        return f""",
 {name}_q AS (
  SELECT lang, cell, n / sum(n) OVER (PARTITION BY lang) AS q FROM (
   SELECT lang, cell, sum(n) AS n FROM {name} JOIN documents USING (doc_id)
   WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY lang, cell)),
 {name}_p AS (SELECT doc_id, cell, n / greatest(sum(n) OVER (PARTITION BY doc_id), 1) AS p FROM {name}),
 {name}_d AS (
  SELECT doc_id, min(d) AS d FROM (
   SELECT doc_id, lang, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
     + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END), 0) / 2) AS d
   FROM {name}_p JOIN {name}_q USING (cell) GROUP BY doc_id, lang) GROUP BY doc_id)"""

    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(trim(translate(t, chr(9) || chr(10) || chr(11) || chr(12) || chr(13),
   '     '), ' '), ' +'), lambda w: w <> '') AS ws FROM texts),
 tok AS MATERIALIZED (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM split),
 classes AS MATERIALIZED (SELECT doc_id, unnest(c) AS n, generate_subscripts(c, 1) AS cell FROM (SELECT doc_id, [{cells}] AS c FROM texts)),
 vocabulary(cell) AS (VALUES {common}, (NULL)),
 seen AS (
  SELECT doc_id, cell, count(*) AS n FROM (
   SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM tok) LEFT JOIN vocabulary ON cell = w
  GROUP BY doc_id, cell),
 common AS MATERIALIZED (
  SELECT d.doc_id, coalesce(v.cell, '') AS cell, coalesce(n, 0) AS n
  FROM texts d CROSS JOIN vocabulary v LEFT JOIN seen s ON s.doc_id = d.doc_id AND s.cell IS NOT DISTINCT FROM v.cell),
 grams AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (
   SELECT doc_id, pos, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
  WHERE g IS NOT NULL),
 covered AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS place FROM grams WHERE n > 1) GROUP BY doc_id),
 lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM texts)
  WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
 sizes AS (SELECT doc_id, count(*) AS n, sum(length(w)) AS chars FROM tok GROUP BY doc_id){distance("classes")}{distance("common")},
 base AS (
  SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_words, coalesce(s.chars, 0)::BIGINT AS word_chars, y.n::BIGINT AS n_symbols,
   coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, length(d.t) AS all_chars
  FROM texts d LEFT JOIN sizes s USING (doc_id) LEFT JOIN lines l USING (doc_id) LEFT JOIN covered c USING (doc_id)
  JOIN classes y ON y.doc_id = d.doc_id AND y.cell = 8),
 judged AS (
  SELECT *, n_words < {limits["min_words"]} OR 100 * n_repeat_words > {limits["max_repeat_percent"]} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 round(a.d, 9) AS class_distance, round(b.d, 9) AS word_distance,
 NOT base_failed AND (all_chars < {limits["class_guard"]} OR a.d <= {limits["max_class_distance"]})
  AND (n_words < {limits["word_guard"]} OR b.d <= {limits["max_word_distance"]}) AS kept
FROM judged JOIN classes_d a USING (doc_id) JOIN common_d b USING (doc_id)"""
