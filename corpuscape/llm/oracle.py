"""The queries that SQL can express, as DuckDB SQL; plain and quadratic, for small tables."""

from __future__ import annotations

from corpuscape.llm import mixing, quality

_SPACE = r"[^\x20\x09-\x0D]+"

_GRID = ", ".join(
    f"('{rule}', {i}, {c})" for rule, (_, _, grid) in quality.RULES.items() for i, c in enumerate(grid)
)
_SHARES = ", ".join(
    f"{what} / greatest({per}, 1) AS {rule}" for rule, (what, per, _) in quality.RULES.items()
)
_LONG = " UNION ALL ".join(f"SELECT doc_id, stratum, '{r}' AS rule, {r} AS share FROM shares" for r in quality.RULES)
_RATE = quality.RISK / len(quality.RULES)

OP1 = rf"""
WITH words AS (
  SELECT doc_id, lang AS stratum, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS ws
  FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM words WHERE len(ws) > 7),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i:i+7]) AS n FROM starts),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM
    (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM windows WHERE n > 1) GROUP BY doc_id),
lines AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_SPACE}')) AS ls FROM words),
m AS (
  SELECT w.doc_id, stratum, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) AS n_lines,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]')
             AND strlen(x) > 2)) AS n_caps_words
  FROM words w JOIN lines l ON w.doc_id = l.doc_id LEFT JOIN covered c ON w.doc_id = c.doc_id),
base AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed FROM m),
shares AS (SELECT doc_id, stratum, base_failed, {_SHARES} FROM base),
long AS ({_LONG}),
grid(rule, i, cut) AS (VALUES {_GRID}),
given AS (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
counts AS (
  SELECT stratum, l.rule, i, any_value(cut) AS cut, sum((q > 0)::INT) AS n_good,
         sum((q > 0 AND share > cut)::INT) AS good, sum((q = 0 AND share > cut)::INT) AS bad
  FROM long l JOIN given USING (doc_id) JOIN shares s USING (doc_id, stratum) JOIN grid g ON g.rule = l.rule
  WHERE NOT s.base_failed GROUP BY stratum, l.rule, i),
tested AS (
  SELECT *, n_good > 0 AND good <= n_good * {_RATE} AND list_sum(list_transform(range(0, good::BIGINT + 1), lambda k:
      exp(lgamma(n_good + 1) - lgamma(k + 1) - lgamma(n_good - k + 1) + k * ln({_RATE}) + (n_good - k) * ln(1 - {_RATE}))))
      <= {quality.ERROR} / ((SELECT count(DISTINCT coalesce(stratum, '')) FROM counts) * {len(quality.RULES)}) AS passed
  FROM counts),
chain AS (
  SELECT *, bool_and(passed) OVER (PARTITION BY stratum, rule ORDER BY i) AS certified FROM tested),
best AS (
  SELECT stratum, rule, arg_max(cut, (bad - {quality.PRICE} * good) * 1000 - i) AS cut FROM chain
  WHERE certified AND bad - {quality.PRICE} * good > 0 GROUP BY stratum, rule),
rejected AS (
  SELECT DISTINCT l.doc_id FROM long l JOIN best b ON l.rule = b.rule AND l.stratum IS NOT DISTINCT FROM b.stratum
  WHERE l.share > b.cut)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept
FROM base
"""

OP3 = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS w
            FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM docs)),
firsts AS (SELECT w, min(doc_id) AS f FROM windows GROUP BY w),
late AS (SELECT doc_id, p FROM windows JOIN firsts USING (w) WHERE f < doc_id),
marked AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM late),
runs AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM runs GROUP BY doc_id, run),
edges AS (
  SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans
  UNION ALL
  SELECT d.doc_id, length(any_value(h)) // 2, coalesce(max(b), 0) FROM docs d LEFT JOIN spans s ON d.doc_id = s.doc_id GROUP BY d.doc_id),
kept AS (
  SELECT d.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS k
  FROM edges e JOIN docs d ON d.doc_id = e.doc_id GROUP BY d.doc_id),
sums AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS n FROM spans GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed,
       coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM docs d JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""

OP5 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}') AS ws
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, ws[i:i+3] AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM words WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY x, y),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM words UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
comps AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM comps LEFT JOIN sizes USING (doc_id)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
items AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, ws[i:i+9] AS w
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM b WHERE len(ws) > 0)),
lengths AS (SELECT DISTINCT n FROM items),
windows AS (
  SELECT doc_id, n, i, ws[i:i+n-1] AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lengths WHERE len(ws) >= n)),
hits AS (SELECT doc_id, item_id, i, n FROM windows JOIN items USING (n, w)),
covered AS (SELECT doc_id, count(DISTINCT p) AS k FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS k, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(c.k, 0)::BIGINT AS n_hit, coalesce(m.k, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(c.k, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN named m ON m.doc_id = d.doc_id
"""

OP8 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
sized AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS digest FROM p),
ranked AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS original FROM sized)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> original THEN original END AS refers_to
FROM ranked
"""

_NORMAL = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"

OP9 = rf"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
lines AS (
  SELECT conv_id, turn, pos, line, length(regexp_extract(line, '^(?:[ \t]*>)+')) - length(replace(regexp_extract(line, '^(?:[ \t]*>)+'), '>', '')) AS level
  FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '\r?\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) AS pos FROM m)),
own AS (
  SELECT m.*, coalesce(n_quoted, 0) AS n_quoted, regexp_replace(coalesce(kept, ''), '^\s+|\s+$', '', 'g') AS body
  FROM m LEFT JOIN (
    SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY pos) FILTER (level = 0) AS kept, count(*) FILTER (level > 0) AS n_quoted
    FROM lines GROUP BY conv_id, turn) l ON l.conv_id = m.conv_id AND l.turn = m.turn),
parts AS (
  SELECT conv_id, turn, unnest(list_concat([body], regexp_split_to_array(body, '\n\s*\n'), string_split(body, chr(10)))) AS part FROM own),
origin AS (SELECT conv_id, {_NORMAL.format('part')} AS words, min(turn) AS origin FROM parts GROUP BY ALL HAVING words <> ''),
runs AS (
  SELECT *, pos - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY pos) AS run,
         {_NORMAL.format("regexp_replace(line, '^(?:[ \t]*>)+', '')")} AS body
  FROM lines WHERE level > 0),
asked AS (
  SELECT conv_id, turn, level, body AS words FROM runs WHERE body <> ''
  UNION ALL
  SELECT conv_id, turn, level, string_agg(body, ' ' ORDER BY pos) FROM runs WHERE body <> '' GROUP BY conv_id, turn, level, run),
votes AS (
  SELECT conv_id, turn, level, origin, sum(length(words)) AS size FROM asked JOIN origin USING (conv_id, words)
  WHERE origin < turn GROUP BY conv_id, turn, level, origin),
linked AS (
  SELECT conv_id, turn, origin FROM votes
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, size DESC, origin DESC) = 1),
parents AS (
  SELECT o.conv_id, o.turn, coalesce(l.origin, lag(o.turn) OVER (PARTITION BY o.conv_id ORDER BY o.turn)) AS parent, l.origin IS NOT NULL AS quoted
  FROM own o LEFT JOIN linked l ON l.conv_id = o.conv_id AND l.turn = o.turn),
placed AS (
  SELECT *, parent IS NOT NULL AND turn = min(turn) OVER (PARTITION BY conv_id, parent) AS on_branch FROM parents),
walk AS (
  SELECT conv_id, turn, turn AS branch, 0 AS position FROM placed WHERE NOT on_branch
  UNION ALL
  SELECT p.conv_id, p.turn, w.branch, w.position + 1 FROM walk w JOIN placed p ON p.conv_id = w.conv_id AND p.parent = w.turn AND p.on_branch)
SELECT o.conv_id, o.turn, role, parent AS parent_turn, quoted, branch AS branch_turn, position::BIGINT AS position,
       n_quoted::BIGINT AS n_quoted, body AS text
FROM own o JOIN placed p ON p.conv_id = o.conv_id AND p.turn = o.turn JOIN walk w ON w.conv_id = o.conv_id AND w.turn = o.turn
"""

OP10 = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_SPACE}'))::BIGINT AS size,
         length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')) AS symbols
  FROM documents),
keyed AS (
  SELECT *, -ln((('0x' || substr(md5('0|' || doc_id), 1, 12))::BIGINT::DOUBLE + 0.5) / {float(2**48)})
            / CASE WHEN size > 0 THEN size / (size + 4 * symbols) ELSE {mixing.DEFAULT_WEIGHT} END AS key
  FROM sized),
coded AS (SELECT *, floor(key / (key + 1) * {float(2**mixing.KEY_BITS)})::BIGINT AS code FROM keyed),
totals AS (
  SELECT source, sum(size)::BIGINT AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sized GROUP BY source),
levels AS (
  SELECT *, (sum(s) OVER () - coalesce(sum({mixing.EPOCHS} * s) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM totals WINDOW o AS (ORDER BY {mixing.EPOCHS} * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, s, CASE WHEN level > {mixing.EPOCHS} * s / w THEN ({mixing.EPOCHS} * s)::DOUBLE
    ELSE w * max(CASE WHEN level <= {mixing.EPOCHS} * s / w THEN level END) OVER () END AS target
  FROM levels),
epochs AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s)::BIGINT ELSE 0 END AS e FROM targets),
running AS (
  SELECT doc_id, size, s, target, e, sum(size) OVER (PARTITION BY c.source ORDER BY code, doc_id) AS upto
  FROM coded c JOIN epochs t ON c.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, s AS source_size, target,
       (size * (e + (upto - size / 2 <= target - e * s)::INT))::BIGINT AS taken
FROM running
"""

#: floor(64 * x) of the usable vectors, rounds of nearest centroid and floored means, all in integers.
OP11_HEAD = """kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS k, x AS c FROM
    (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, x FROM kept ORDER BY h LIMIT 16))"""


def op11_round(i: int) -> str:
    return f"""a{i} AS (SELECT vec_id, x, arg_min(k, (d, k)) AS k, min(d) AS d FROM
    (SELECT vec_id, x, k, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{i}) GROUP BY vec_id, x),
  s{i} AS (SELECT k, j, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT k, generate_subscripts(x, 1) AS j, unnest(x) AS v FROM a{i}) GROUP BY k, j),
  m{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS m FROM s{i} GROUP BY k),
  c{i + 1} AS (SELECT k, coalesce(m, c) AS c FROM c{i} LEFT JOIN m{i} USING (k))"""


OP11 = f"""WITH {OP11_HEAD}, {", ".join(op11_round(i) for i in range(4))}
  SELECT vec_id, CAST(a3.k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a3.k) AS BIGINT) AS cluster_inertia,
    CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
  FROM a3 JOIN c3 USING (k)"""

#: crc32 of ASCII text, byte by byte and bit by bit.
CRC_BYTE = """list_reduce([xor(acc, b) & 255, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"""
CRC = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(t) + 1), lambda i: ascii(substr(t, i, 1))::BIGINT)),
    lambda acc, b: xor({CRC_BYTE}, acc >> 8)), 4294967295)"""

#: The cheapest repair row by row: states are what was put out last (0 nothing, 1 system, 2 user, 3 assistant).
OP13 = f"""WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS t FROM conversations),
  marked AS (SELECT *, {CRC} % 20 AS way FROM keyed),
  damaged AS (SELECT conv_id, turn, CASE way WHEN 4 THEN 'user' ELSE role END AS role,
      CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(CASE way WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM marked WHERE way <> 0),
  placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
      row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS same FROM damaged),
  told AS (SELECT conv_id, turn, i, role, text, substr(role, 1, 1) AS initial, CASE
      WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN same > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault FROM placed),
  pairs AS (SELECT conv_id, initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS two FROM told),
  illegal AS (SELECT conv_id, count(*) AS illegal FROM pairs WHERE two IS NOT NULL AND two NOT IN ('su', 'ua', 'au') GROUP BY conv_id),
  counts AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
      count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, max(i) AS n FROM told GROUP BY conv_id),
  added(p, q, k, letters, lines) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
      (0, 2, 5, 'I', ['user:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 2, 5, 'I', ['user:']), (1, 3, 10, 'II', ['user:', 'assistant:']),
      (2, 3, 5, 'I', ['assistant:']), (2, 2, 10, 'II', ['assistant:', 'user:']), (3, 2, 5, 'I', ['user:']), (3, 3, 10, 'II', ['user:', 'assistant:'])),
  put(p, q, initial, role) AS (VALUES (0, 1, 's', NULL), (0, 2, 'u', 'user'), (1, 2, 'u', 'user'), (2, 3, 'a', 'assistant'), (3, 2, 'u', 'user')),
  edits AS (SELECT conv_id, i, p, p AS q, 2 AS k, 'D' AS letter, []::VARCHAR[] AS lines FROM told, (SELECT unnest([0, 1, 2, 3]) AS p)
    UNION ALL SELECT conv_id, i, p, q, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, 'K', [told.role || ':' || text]
      FROM told JOIN put USING (initial) WHERE fault NOT IN ('blank', 'duplicate')
    UNION ALL SELECT conv_id, i, p, q, 1 + CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, 'R', [put.role || ':' || text]
      FROM told, put WHERE put.role IS NOT NULL AND fault NOT IN ('blank', 'duplicate')),
  steps AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, q, k AS cost, letters AS audit, lines FROM counts, added WHERE p = 0
    UNION ALL SELECT conv_id, i, q, s.cost, s.audit, s.lines FROM
      (SELECT s.conv_id, e.i, a.q, min({{'cost': s.cost + e.k + a.k, 'audit': s.audit || e.letter || a.letters, 'lines': s.lines || e.lines || a.lines}}) AS s
       FROM steps s JOIN edits e ON e.conv_id IS NOT DISTINCT FROM s.conv_id AND e.i = s.i + 1 AND e.p = s.q JOIN added a ON a.p = e.q
       GROUP BY s.conv_id, e.i, a.q)),
  ended AS (SELECT c.conv_id, min({{'cost': s.cost, 'audit': s.audit, 'lines': s.lines}}) AS s FROM steps s
    JOIN counts c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.n = s.i WHERE q IN (0, 3) GROUP BY c.conv_id),
  convs AS (SELECT DISTINCT conv_id FROM conversations)
  SELECT v.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(s.cost, 0) AS BIGINT) AS cost, coalesce(s.audit, '') AS audit,
    sha256(coalesce(array_to_string(s.lines, chr(10)), '')) AS repaired_sha256
  FROM convs v LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN illegal l ON l.conv_id IS NOT DISTINCT FROM v.conv_id
    LEFT JOIN ended d ON d.conv_id IS NOT DISTINCT FROM v.conv_id"""

ORACLES = {
    "op1_quality_rules": OP1,
    "op3_repeats": OP3,
    "op5_near_dups": OP5,
    "op7_decontaminate": OP7,
    "op8_warc": OP8,
    "op9_quote_links": OP9,
    "op11_centroids": OP11,
    "op13_repair": OP13,
    "op10_mixing": OP10,
}
