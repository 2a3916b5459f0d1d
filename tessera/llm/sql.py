"""DuckDB SQL of the queries that SQL can express."""

#: ``op7_poisson_mix``: equal weights over the sources, size 1.
POISSON_MIX = """
WITH per AS (
  SELECT source, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS mass FROM documents GROUP BY source),
total AS (SELECT CAST(sum(mass) AS DOUBLE) AS mass, CAST(count(*) FILTER (mass > 0) AS DOUBLE) AS w FROM per),
rate AS (
  SELECT per.source, CASE WHEN per.mass > 0 THEN total.mass / total.w / CAST(per.mass AS DOUBLE) ELSE 0E0 END AS rate
  FROM per, total),
step AS (
  SELECT source, greatest(CAST(ceil(rate / 8E0) AS INT), 1) AS steps,
         rate / greatest(CAST(ceil(rate / 8E0) AS INT), 1) AS mean FROM rate),
cdf AS (
  SELECT source, steps, list(c ORDER BY k) AS cdf FROM (
    SELECT source, steps, k, sum(exp(-mean) * pow(mean, k) / gamma(k + 1E0)) OVER (PARTITION BY source ORDER BY k) AS c
    FROM step, (SELECT unnest(range(0, 65)) AS k) t) t GROUP BY source, steps),
draws AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
         list_sum(list_transform(range(1, steps + 1), lambda i: len(list_filter(cdf, lambda c: c <
           CAST(CAST('0x' || substr(md5(concat('mix-', coalesce(CAST(doc_id AS VARCHAR), ''), '-', i)), 1, 13) AS BIGINT) AS DOUBLE)
           / 4503599627370496E0)))) AS k
  FROM documents d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INT) AS copy,
       md5(concat('mix-order-', coalesce(CAST(doc_id AS VARCHAR), ''), '-', copy)) AS order_key
FROM (SELECT *, unnest(range(0, CAST(k AS BIGINT))) AS copy FROM draws) t
"""

#: ``op12_collocations``: phrases of 2 to 5 words, 100 times at least, 2000 a language.
COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
grams AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) ks),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT *, array_to_string(w[1:j], ' ') AS first, array_to_string(w[j + 1:], ' ') AS rest
  FROM (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM f WHERE k > 1) c),
scores AS (
  SELECT c.lang, c.phrase, c.k, c.a, j, x.f AS l, y.f AS r, total.n AS n,
         (1000::HUGEINT * c.a * total.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest
  JOIN total ON total.lang = c.lang),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_phrases AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM (
    SELECT *, unnest(range(1, k - m + 2)) AS i FROM (
      SELECT lang, k, f AS a, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS m FROM f WHERE k > 2) x) y GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inner_phrases i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 100 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""

#: ``op13_divergence_rules``: repeated rows are told apart by their place in the table.
DIVERGENCE_RULES = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, coalesce(lang, 'und') AS lang FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
place AS (SELECT row, unnest(range(1, len(w) - 1)) AS i, w FROM w),
again AS (
  SELECT row, i FROM place QUALIFY count(*) OVER (PARTITION BY row, w[i], w[i + 1], w[i + 2]) > 1),
repeated AS (SELECT row, count(DISTINCT i + o) AS n FROM again, (SELECT unnest(range(0, 3)) AS o) o GROUP BY row),
chars AS (
  SELECT row, lang, text, length(text) AS size, [
      length(regexp_replace(text, '[^a-z]+', '', 'g')), length(regexp_replace(text, '[^\x09-\x0D\x20]+', '', 'g')),
      length(regexp_replace(text, '[^A-Z]+', '', 'g')), length(regexp_replace(text, '[^0-9]+', '', 'g')),
      length(regexp_replace(text, '[^.,;:!?''\x22()-]+', '', 'g')),
      length(regexp_replace(text, '[^\x00-\x08\x0E-\x1F#-&*+/<-@\x5B-`{-\x7F]+', '', 'g'))] AS c FROM d),
classes AS (SELECT row, lang, text, list_concat(c, [size - CAST(list_sum(c) AS BIGINT)]) AS c FROM chars),
hot AS (SELECT text FROM d WHERE text <> '' GROUP BY text
        HAVING count(*) > 1 AND count(*) * 1000 > (SELECT count(*) FROM d)),
plain AS (SELECT w.* FROM w ANTI JOIN hot ON w.text = hot.text),
word AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(w) AS word FROM plain) x GROUP BY ALL),
total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS total FROM word GROUP BY lang),
top AS (SELECT lang, word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM word) x
        WHERE rank <= 100),
ref_words AS (
  SELECT t.lang, list(word ORDER BY rank) AS common, list_concat(list(n ORDER BY rank), [max(total) - CAST(sum(n) AS BIGINT)]) AS words
  FROM top t JOIN total ON total.lang = t.lang
  WHERE total >= 1000 AND total >= (SELECT sum(total) FROM total) / 1000E0 GROUP BY t.lang),
ref_chars AS (
  SELECT lang, list(n ORDER BY i) AS chars FROM (
    SELECT lang, i, CAST(sum(c[i]) AS BIGINT) AS n FROM (SELECT unnest(range(1, 8)) AS i, c.* FROM classes c ANTI JOIN hot ON c.text = hot.text) x
    GROUP BY lang, i) y GROUP BY lang),
refs AS (SELECT ref_words.*, chars FROM ref_words JOIN ref_chars ON ref_chars.lang = ref_words.lang),
found AS (
  SELECT row, list(coalesce(k, 0) ORDER BY rank) AS counts FROM (
    SELECT p.row, t.rank, k FROM (SELECT w.row, refs.lang FROM w JOIN refs ON refs.lang = w.lang) p
    JOIN top t ON t.lang = p.lang
    LEFT JOIN (SELECT row, word, count(*) AS k FROM (SELECT row, unnest(w) AS word FROM w) x GROUP BY ALL) k
      ON k.row = p.row AND k.word = t.word) y GROUP BY row),
base AS (
  SELECT w.row, w.doc_id, w.lang, w.text, len(w.w) AS n_words, length(regexp_replace(w.text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(w.text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words
  FROM w LEFT JOIN repeated r ON r.row = w.row),
hist AS (
  SELECT b.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, refs.words, refs.chars, c.c AS own_chars,
         list_concat(f.counts, [n_words - CAST(list_sum(f.counts) AS BIGINT)]) AS own_words
  FROM base b JOIN classes c ON c.row = b.row LEFT JOIN refs ON refs.lang = b.lang LEFT JOIN found f ON f.row = b.row),
share AS (
  SELECT *, list_transform(own_words, lambda x: x / list_sum(own_words)) AS p, list_transform(words, lambda x: x / list_sum(words)) AS q,
         list_transform(own_chars, lambda x: x / list_sum(own_chars)) AS u, list_transform(chars, lambda x: x / list_sum(chars)) AS v FROM hist),
apart AS (
  SELECT *, sqrt(greatest(list_sum(list_transform(range(1, len(p) + 1), lambda i:
             CASE WHEN p[i] > 0 THEN p[i] * log2(p[i] * 2 / (p[i] + q[i])) ELSE 0E0 END
           + CASE WHEN q[i] > 0 THEN q[i] * log2(q[i] * 2 / (p[i] + q[i])) ELSE 0E0 END)) / 2, 0E0)) AS by_words,
         sqrt(greatest(list_sum(list_transform(range(1, len(u) + 1), lambda i:
             CASE WHEN u[i] > 0 THEN u[i] * log2(u[i] * 2 / (u[i] + v[i])) ELSE 0E0 END
           + CASE WHEN v[i] > 0 THEN v[i] * log2(v[i] * 2 / (u[i] + v[i])) ELSE 0E0 END)) / 2, 0E0)) AS by_chars FROM share),
judged AS (
  SELECT *, CASE WHEN NOT base_failed AND n_words >= 70 THEN by_words END AS words_apart,
         CASE WHEN NOT base_failed AND length(text) >= 200 THEN by_chars END AS chars_apart FROM apart)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       round(words_apart, 6) AS words_apart, round(chars_apart, 6) AS chars_apart,
       NOT base_failed AND coalesce(words_apart < WORDS_LIMIT + CHANCE / sqrt(n_words), true) AND coalesce(chars_apart < CHARS_LIMIT, true) AS kept
FROM judged
"""
