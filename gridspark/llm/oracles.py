"""DuckDB SQL for the queries that SQL can express."""

LINES = """
WITH lines AS (
  SELECT doc_id, n AS n_lines, i AS pos, l[i] AS line,
         translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, l, len(l) AS n, unnest(range(1, len(l) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
shared AS (SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
marked AS (SELECT lines.*, shared.first IS NOT NULL AND doc_id > shared.first AS gone FROM lines LEFT JOIN shared USING (key))
SELECT doc_id, n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id, n_lines
"""

DECONTAMINATION = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
patterns AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS p
  FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM patterns),
windows AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS p
  FROM (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM words, lengths WHERE len(w) >= m)),
found AS (SELECT doc_id, item_id, m, i FROM windows JOIN patterns USING (m, p)),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM found, (SELECT unnest(range(0, 10)) AS k) WHERE k < m GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

NEAR = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS id, doc_id AS met FROM documents UNION SELECT id, b FROM reach JOIN links ON a = met)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT id AS doc_id, min(met) AS component_id FROM reach GROUP BY id) USING (doc_id)
"""

EMBEDDINGS = """
WITH RECURSIVE fine AS MATERIALIZED (
  SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
  WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM fine x JOIN fine y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_dot_product(x.v, y.v) / (x.norm * y.norm) >= 0.9),
reach AS (SELECT vec_id AS id, vec_id AS met FROM embeddings UNION SELECT id, b FROM reach JOIN links ON a = met)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN (SELECT id AS vec_id, min(met) AS component_id FROM reach GROUP BY id) USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
"""

_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
SECRETS = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
patterns AS (
  SELECT doc_id, text, unnest([
    {{'rank': 0, 'kind': 'assign', 'm': regexp_extract_all(text, '{_ASSIGN}'), 'v': regexp_extract_all(text, '{_ASSIGN}', 2), 'g': string_split_regex(text, '{_ASSIGN}'), 'least': 6}},
    {{'rank': 1, 'kind': 'access', 'm': regexp_extract_all(text, 'AKIA[A-Z0-9]+'), 'v': regexp_extract_all(text, 'AKIA[A-Z0-9]+'), 'g': string_split_regex(text, 'AKIA[A-Z0-9]+'), 'least': 20}},
    {{'rank': 2, 'kind': 'hex', 'm': regexp_extract_all(text, '[0-9a-f]+'), 'v': regexp_extract_all(text, '[0-9a-f]+'), 'g': string_split_regex(text, '[0-9a-f]+'), 'least': 24}},
    {{'rank': 3, 'kind': 'entropy', 'm': regexp_extract_all(text, '[A-Za-z0-9+/_=-]{{20,}}'), 'v': regexp_extract_all(text, '[A-Za-z0-9+/_=-]{{20,}}'), 'g': string_split_regex(text, '[A-Za-z0-9+/_=-]{{20,}}'), 'least': 20}}]) AS p FROM t),
each AS (
  SELECT doc_id, p.rank AS rank, p.kind AS kind, p.least AS least, unnest(p.m) AS m, unnest(p.v) AS v, unnest(p.g[:len(p.m)]) AS g, unnest(range(len(p.m))) AS i FROM patterns),
placed AS (
  SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS stop FROM each),
spans AS (SELECT doc_id, rank, kind, v, (stop - length(m))::INT AS start, stop::INT AS stop FROM placed WHERE length(v) >= least),
base AS (SELECT * FROM spans WHERE rank < 3),
likely AS (
  SELECT * FROM spans s WHERE rank = 3
  AND NOT regexp_matches(v, '[Ee]xample|EXAMPLE|[Pp]laceholder|[Cc]hangeme|[Dd]ummy') AND NOT regexp_matches(v, '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$')
  AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = s.doc_id AND b.start < s.stop AND s.start < b.stop)),
windows AS (SELECT doc_id, start, stop, v, w, substr(v, w, 20) AS s FROM (SELECT *, unnest(range(1, length(v) - 18)) AS w FROM likely)),
counted AS (SELECT doc_id, start, stop, v, w, c, count(*) AS n FROM (SELECT *, unnest(string_split(s, '')) AS c FROM windows) GROUP BY ALL),
entropy AS (SELECT doc_id, start, stop, v, w, -sum(n / 20.0 * log2(n / 20.0)) AS h FROM counted GROUP BY doc_id, start, stop, v, w),
high AS (
  SELECT doc_id, 3 AS rank, 'entropy' AS kind, start, stop FROM entropy GROUP BY doc_id, start, stop, v
  HAVING max(h) >= CASE WHEN regexp_full_match(v, '[0-9a-fA-F]+') THEN 3.0 ELSE 3.7 END),
every AS (SELECT doc_id, rank, kind, start, stop FROM base UNION ALL SELECT * FROM high)
SELECT t.doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank < 3), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '') AS spans
FROM t LEFT JOIN every USING (doc_id) GROUP BY t.doc_id
"""

CONVERSATIONS = r"""
WITH RECURSIVE crc(n, k, c) AS (
  SELECT n, 0, n FROM (SELECT unnest(range(256)) AS n)
  UNION ALL SELECT n, k + 1, CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM crc WHERE k < 8),
digests AS (SELECT list(c ORDER BY n) AS t FROM crc WHERE k = 8),
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
                         lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS what
  FROM conversations, digests),
damaged AS (
  SELECT conv_id, turn, CASE what WHEN 4 THEN 'user' ELSE role END AS role,
         CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM given, (SELECT unnest([0, 1]) AS copy) WHERE what <> 0 AND (copy = 0 OR what = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
judged AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
totals AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
-- Next state of an inserted or renamed turn: 0 nothing, 1 system, 2 user, 3 assistant.
inserts(p, k, here, added) AS (
  SELECT p, 0, p, []::VARCHAR[] FROM (SELECT unnest([0, 1, 2, 3]) AS p)
  UNION ALL SELECT p, k + 1, CASE here WHEN 2 THEN 3 ELSE 2 END, added || [CASE here WHEN 2 THEN 'assistant:' ELSE 'user:' END] FROM inserts WHERE k < 2),
best(conv_id, i, state, cost, audit, lines) AS (
  SELECT conv_id, 0::BIGINT, 0, 0::BIGINT, '', []::VARCHAR[] FROM totals
  UNION ALL
  SELECT conv_id, i, state, cost, audit, lines FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) AS place FROM (
      SELECT b.conv_id, j.i,
             CASE e WHEN 'D' THEN here WHEN 'R' THEN CASE here WHEN 2 THEN 3 ELSE 2 END ELSE CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS state,
             b.cost + 5 * k + CASE e WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN e <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END AS cost,
             b.audit || repeat('I', k) || e AS audit,
             b.lines || added || CASE e WHEN 'D' THEN []::VARCHAR[] WHEN 'R' THEN [CASE here WHEN 2 THEN 'assistant:' ELSE 'user:' END || j.text] ELSE [j.role || ':' || j.text] END AS lines
      FROM best b JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.i = b.i + 1 JOIN inserts ON p = b.state, (SELECT unnest(['D', 'K', 'R']) AS e)
      WHERE e = 'D' OR fault NOT IN ('blank', 'duplicate') AND (e = 'R' OR initial = 's' AND here = 0 OR initial = 'u' AND here <> 2 OR initial = 'a' AND here = 2)))
  WHERE place = 1),
ended AS (
  SELECT b.conv_id, b.cost + 5 * k AS cost, b.audit || repeat('I', k) AS audit, b.lines || added AS lines,
         row_number() OVER (PARTITION BY b.conv_id ORDER BY b.cost + 5 * k, b.audit || repeat('I', k)) AS place
  FROM best b JOIN totals t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.n = b.i JOIN inserts ON p = b.state WHERE here IN (0, 3))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN totals t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id AND e.place = 1
"""

HARD_NEGATIVES = """
WITH fine AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM fine a JOIN fine b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3
"""

ORACLES = {"op12_hard_negatives": HARD_NEGATIVES, "op11_conversation_repair": CONVERSATIONS, "op6_secret_scan": SECRETS, "op8_embedding_near_dedup": EMBEDDINGS, "op3_minhash_near_dedup": NEAR, "op2_line_dedup": LINES, "op9_benchmark_decontamination": DECONTAMINATION}
