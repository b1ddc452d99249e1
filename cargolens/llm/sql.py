"""DuckDB twins of the registered queries."""

from __future__ import annotations

TWINS: dict[str, str] = {}

TWINS["op5_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

#: crc32 by its byte table (made from the rule), jump consistent hashing by recursion.
TWINS["op3_sharding"] = """
WITH RECURSIVE
bits AS (
  SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS step FROM range(256) AS r(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
octets AS (SELECT list(c ORDER BY i) AS made FROM bits WHERE step = 8),
crc AS (
  SELECT doc_id, text, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    xor(list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT),
                   list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                                  lambda h: CAST('0x' || h AS BIGINT))),
      lambda c, b: xor(c >> 8, made[CAST(xor(c & 255, b) AS INTEGER) + 1])), 4294967295) AS text_crc32
  FROM documents, octets),
walk AS (
  SELECT n, id, CAST(-1 AS BIGINT) AS here, CAST(0 AS BIGINT) AS next,
         CAST(CASE WHEN id < 0 THEN CAST(id AS HUGEINT) + 18446744073709551616 ELSE id END AS HUGEINT) AS k
  FROM (SELECT DISTINCT coalesce(doc_id, 0) AS id FROM documents), (VALUES (8), (9)) AS t(n)
  UNION ALL
  SELECT n, id, next,
         CAST(floor((next + 1) * (CAST(2147483648 AS DOUBLE)
              / CAST((((k * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592) + 1 AS DOUBLE))) AS BIGINT),
         (k * 2862933555777941757 + 1) % 18446744073709551616
  FROM walk WHERE next < n),
ends AS (SELECT id, max(here) FILTER (n = 8) AS shard, max(here) FILTER (n = 9) AS grown_shard
         FROM walk WHERE next >= n GROUP BY id)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law,
       CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM crc JOIN ends ON id = coalesce(doc_id, 0)
"""

#: Lengths of the template's strings and the escape rule (a doubled backslash, one more in each control string).
TWINS["op1_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (
  SELECT *, length(replace(text, chr(92), chr(92) || chr(92)))
    + len(regexp_extract_all(replace(text, chr(92), chr(92) || chr(92)),
      '<[|]document[|]>|<[|]image[|]>|<[|]audio[|]>|<</SYS>>|<[|]turn[|]>|<[|]text[|]>|\[/INST\]|<<SYS>>|<[|]end[|]>|\[INST\]|</s>|<s>'))
    AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + length(role) + 23) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

TWINS["op8_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
v AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 12], ' ') AS passage, i
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)),
f AS (SELECT passage, min(doc_id) AS first FROM v GROUP BY passage),
g AS (SELECT doc_id, list_sort(list_distinct(flatten(list(range(i, i + 13))))) AS gone
      FROM v JOIN f USING (passage) WHERE first < doc_id GROUP BY doc_id),
k AS (SELECT w.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
        CASE WHEN gone IS NULL THEN words
             ELSE list_filter(words, lambda x, i: NOT list_contains(gone, CAST(i AS BIGINT))) END AS kept
      FROM w LEFT JOIN g ON w.doc_id = g.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

TWINS["op7_jaccard_join"] = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ')
                                   ELSE array_to_string(words[i:i + 4], ' ') END AS shingle
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
      FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y
      WHERE 100 * common >= 80 * (a.size + b.size - common)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM documents
      UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reached = e.x)
SELECT d.doc_id, CAST(coalesce(n.size, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents AS d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) AS c ON c.doc_id = d.doc_id
"""

TWINS["op11_lexical_search"] = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM f GROUP BY doc_id),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
m AS (SELECT doc_id, 25 + (75 * n * docs) // terms AS m FROM d, g),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM f GROUP BY term), g),
q AS (SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark) GROUP BY item_id, term),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
      FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

#: Every word is joined with its equals at most a quarter of the text away; neighbouring matches of one distance are a run.
TWINS["op12_run_detection"] = r"""
WITH RECURSIVE
bits AS (
  SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS step FROM range(256) AS r(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
octets AS (SELECT list(c ORDER BY i) AS made FROM bits WHERE step = 8),
d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    xor(list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                                                              lambda h: CAST(ord(h) AS BIGINT))),
      lambda c, b: xor(c >> 8, made[CAST(xor(c & 255, b) AS INTEGER) + 1])), 4294967295) AS h
  FROM documents, octets),
e AS (SELECT *, len(words) AS n, h // 10 AS g FROM d),
b AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM e),
o AS (SELECT doc_id, n, CASE WHEN a = n THEN words ELSE list_transform(range(n),
        lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS words FROM b),
p AS (SELECT doc_id, n, unnest(words) AS word, unnest(range(n)) AS i FROM o),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM p AS x JOIN p AS y
      ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length
      FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m)
      GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id
           ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS k FROM r) WHERE k = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), ''
             ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS words
         FROM p LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.i = p.i WHERE gone.i IS NULL GROUP BY p.doc_id)
SELECT e.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start,
  CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.words, '')) AS collapsed_sha256
FROM e LEFT JOIN listed ON listed.doc_id = e.doc_id LEFT JOIN best ON best.doc_id = e.doc_id
LEFT JOIN kept ON kept.doc_id = e.doc_id
"""

#: The stream of each source and pass in the order of the same digests; slots only say when a block is played, not whether.
TWINS["op13_source_mixing"] = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * CAST(sum(size) AS DOUBLE) AS cap,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w
      FROM d GROUP BY source),
o AS (SELECT *, sum(cap) OVER f - cap AS caps, sum(w) OVER f - w AS ws, sum(w) OVER () AS weights,
        1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS goal
      FROM s WINDOW f AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, cap * (weights - ws) <= w * (goal - caps) AS capped FROM o),
l AS (SELECT coalesce((max(goal) - coalesce(sum(cap) FILTER (capped), 0)) / nullif(max(weights) - coalesce(sum(w) FILTER (capped), 0), 0), 0) AS level FROM c),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE w * level END AS target FROM c, l),
q AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM t),
p AS (SELECT doc_id, size, quota, turn * source_size + sum(size) OVER (PARTITION BY d.source, turn
        ORDER BY md5('mix:' || turn || ':' || doc_id), doc_id, size ROWS UNBOUNDED PRECEDING) AS past
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source CROSS JOIN range(2) r(turn) WHERE size > 0),
k AS (SELECT doc_id, sum(greatest(least(past, quota) - (past - size), 0)) AS taken FROM p GROUP BY doc_id)
SELECT d.doc_id, d.size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN k ON k.doc_id = d.doc_id
"""
