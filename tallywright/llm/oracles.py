"""The operators that SQL can express, as DuckDB SQL."""

PHRASES = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, part
  FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part
    FROM documents
  )
),
listed AS (
  SELECT lang, piece, regexp_extract_all(part, '[^\x20\x09]+') AS words FROM pieces
),
spots AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM listed
),
grams AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM spots, (SELECT unnest([1, 2, 3, 4]) AS k)
  WHERE i + k - 1 <= len(words)
  GROUP BY ALL
),
usual AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS words, f FROM grams WHERE f >= 30),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
cuts AS (
  SELECT lang, k, phrase, f AS a,
         array_to_string(words[1:c], ' ') AS front, array_to_string(words[c + 1:], ' ') AS back, c
  FROM (SELECT *, unnest(range(1, k)) AS c FROM usual WHERE k > 1)
),
scored AS (
  SELECT x.lang, x.k, x.phrase, x.a, x.c, p.f AS l, q.f AS r,
         ((2000000::HUGEINT * x.a) // (p.f::HUGEINT + q.f))::BIGINT AS score
  FROM cuts x
  JOIN usual p ON p.lang = x.lang AND p.phrase = x.front
  JOIN usual q ON q.lang = x.lang AND q.phrase = x.back
),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
),
inner_parts AS (
  SELECT lang, array_to_string(words[i:i + m - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT *, unnest(range(2, k)) AS m FROM usual WHERE k > 2),
       (SELECT unnest([1, 2, 3]) AS i)
  WHERE i + m - 1 <= k
  GROUP BY ALL
),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inner_parts s ON s.lang = b.lang AND s.phrase = b.phrase
  WHERE s.longer IS NULL OR 100::HUGEINT * s.longer < 80::HUGEINT * b.a
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY k.score DESC, k.a DESC, encode(k.phrase)) AS rank,
       k.phrase, k.a, k.l, k.r, t.n, k.score
FROM kept k JOIN totals t ON t.lang = k.lang
QUALIFY rank <= 2000
"""

CONVERSATIONS = r"""
WITH RECURSIVE
keyed AS (
  SELECT *, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                           lambda x: ascii(x)::BIGINT) AS bytes
  FROM conversations
),
marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(
      list_concat([4294967295::BIGINT], bytes),
      lambda crc, byte: list_reduce(
        [xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295) % 20 AS kind
  FROM keyed
),
conversation_list AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
damaged AS (
  SELECT l.c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM marked m JOIN conversation_list l ON l.conv_id IS NOT DISTINCT FROM m.conv_id
  WHERE kind <> 0
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text)) AS i, left(role, 1) AS initial
  FROM damaged
),
faults AS (
  SELECT *,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
         WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
         WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated'
         ELSE 'none' END AS fault,
    lag(initial) OVER (PARTITION BY c ORDER BY i) || initial AS pair
  FROM numbered
),
figures AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows_left
  FROM faults GROUP BY c
),
inserts(state, mid, price, letters, added) AS (
  VALUES (0, 0, 0, '', ''), (0, 2, 2, 'I', E'user:\n'), (0, 3, 4, 'II', E'user:\nassistant:\n'),
         (1, 1, 0, '', ''), (1, 2, 2, 'I', E'user:\n'), (1, 3, 4, 'II', E'user:\nassistant:\n'),
         (2, 2, 0, '', ''), (2, 3, 2, 'I', E'assistant:\n'),
         (3, 3, 0, '', ''), (3, 2, 2, 'I', E'user:\n')
),
edits(letter) AS (VALUES ('D'), ('K'), ('R')),
ways AS (
  SELECT c, 0::BIGINT AS i, 0 AS state, {'cost': 0::BIGINT, 'audit': '', 'lines': ''} AS way FROM conversation_list
  UNION ALL
  SELECT c, i, state, min(way) FROM (
    SELECT w.c, w.i + 1 AS i,
      CASE letter WHEN 'D' THEN n.mid
                  WHEN 'R' THEN CASE WHEN n.mid = 2 THEN 3 ELSE 2 END
                  ELSE CASE WHEN f.initial = 's' AND n.mid = 0 THEN 1 WHEN f.initial = 'u' AND n.mid <> 2 THEN 2
                            WHEN f.initial = 'a' AND n.mid = 2 THEN 3 END END AS state,
      {'cost': w.way.cost + n.price + CASE letter WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END
               + CASE WHEN letter <> 'D' AND f.fault = 'truncated' THEN 1 ELSE 0 END,
       'audit': w.way.audit || n.letters || letter,
       'lines': w.way.lines || n.added || CASE letter WHEN 'D' THEN '' WHEN 'K' THEN f.role || ':' || f.text || E'\n'
                ELSE CASE WHEN n.mid = 2 THEN 'assistant:' ELSE 'user:' END || f.text || E'\n' END} AS way
    FROM ways w JOIN faults f ON f.c = w.c AND f.i = w.i + 1
    JOIN inserts n ON n.state = w.state
    JOIN edits e ON e.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate')
  ) WHERE state IS NOT NULL GROUP BY c, i, state
),
closings(state, price, letters, added) AS (
  VALUES (0, 0, '', ''), (1, 4, 'II', E'user:\nassistant:\n'), (2, 2, 'I', E'assistant:\n'), (3, 0, '', '')
),
best AS (
  SELECT w.c, min({'cost': w.way.cost + e.price, 'audit': w.way.audit || e.letters, 'lines': w.way.lines || e.added}) AS way
  FROM ways w JOIN closings e ON e.state = w.state LEFT JOIN figures g ON g.c = w.c
  WHERE w.i = coalesce(g.rows_left, 0) GROUP BY w.c
)
SELECT l.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, b.way.cost AS cost, b.way.audit AS audit,
  sha256(left(b.way.lines, greatest(length(b.way.lines) - 1, 0))) AS repaired_sha256
FROM conversation_list l JOIN best b ON b.c = l.c LEFT JOIN figures g ON g.c = l.c
"""
