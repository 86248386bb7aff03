"""SQL (DuckDB) that gives the same rows as the operators' queries, for those that SQL can express.

The others learn a model, tokenize, hash with XXH64 or store media, which SQL can't express; they are tested against brute force.
"""

from __future__ import annotations

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_STRIPPED = r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"

#: Windows are compared as lists of words; the lengths that items have are few (1 to 10).
DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
items AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
wins AS (SELECT DISTINCT item_id, n, ws[i:i + n - 1] AS win FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM items)),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
ahead AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ws FROM words),
dwins AS (SELECT doc_id, i, n, ws[1:n] AS win FROM ahead, (SELECT DISTINCT n FROM wins) WHERE len(ws) >= n),
hits AS (SELECT doc_id, i, n, item_id FROM dwins JOIN wins USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, range(10) AS r(k) WHERE k < n GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""

#: The template escapes each backslash and control string with one character; turns have 8 characters around role and text.
CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS said,
    8 + length(role || text) + len(regexp_extract_all(role, '\\|\n|</?s>|\[/?INST\]')) + len(regexp_extract_all(text, '\\|</?s>|\[/?INST\]')) AS n
  FROM c
), p AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position FROM m),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    string_agg(said, '' ORDER BY turn NULLS FIRST, role, text) AS loss, string_agg(position::VARCHAR, ',' ORDER BY turn NULLS FIRST, role, text) AS positions, sum(n)::BIGINT AS formatted_chars
  FROM p GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, sha256(positions) AS positions_sha256 FROM g"""

LINES = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, line, i, translate({_STRIPPED}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, line, i, keeper IS NOT NULL AND keeper <> k.doc_id AS gone FROM k LEFT JOIN hot USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""

#: Texts as two hexadecimal digits a byte. A string's first start stays, the bytes under all its later ones go.
SUBSTRINGS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 99)) AS i FROM d),
t AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS hash FROM s JOIN d USING (doc_id)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY hash ORDER BY doc_id, i) AS r FROM t) WHERE r > 1),
begun AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 100, TRUE) AS begins FROM later),
spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM begun) GROUP BY doc_id, span
),
cuts AS (SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, length(h) // 2, length(h) // 2 FROM d),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS since FROM cuts),
kept AS (SELECT g.doc_id, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a, b) AS k, count(*) - 1 AS n_spans, any_value(length(h) // 2) AS n FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, (n - length(k) // 2)::BIGINT AS n_removed, n_spans, sha256(unhex(k)) AS kept_sha256 FROM kept"""

#: The CRC-32 of a short text in ASCII, bit by bit.
def _crc32(text: str) -> str:
    bits = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    signs = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(({text})[i])::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {signs}), lambda c, b: {bits}), 4294967295)"


#: States as the repair's recursion has them: nothing yet (0), after the system's (1), the user's (2), the assistant's turn (3). At most two turns
#: are added at a place, as a third leads where the first led; the least of equal costs is the least audit, as texts are compared after them.
REPAIR = rf"""
WITH RECURSIVE kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), faulty AS MATERIALIZED (SELECT *, {_crc32("name")} % 20 AS kind FROM kinds),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
  FROM faulty, range(2) AS r(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS said FROM damaged
), seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM placed),
rows_ AS MATERIALIZED (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS previous,
    CASE WHEN said = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(said, 1) IN ('.', '!', '?') THEN '-' ELSE 't' END AS fault FROM seen
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM rows_ GROUP BY conv_id
), added(state, k, entered, letters, told) AS (
  VALUES (0, 0, 0, '', ''), (1, 0, 1, '', ''), (2, 0, 2, '', ''), (3, 0, 3, '', ''), (0, 1, 2, 'I', 'user:' || chr(10)), (1, 1, 2, 'I', 'user:' || chr(10)), (3, 1, 2, 'I', 'user:' || chr(10)),
    (2, 1, 3, 'I', 'assistant:' || chr(10)), (0, 2, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 2, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10))
), keeps(entered, initial, state) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
reroles(entered, role, state) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
ways AS MATERIALIZED (
  SELECT r.conv_id, i, a.state AS since, a.entered AS state, 3 * k + 4 AS cost, letters || 'D' AS letters, told FROM rows_ r, added a
  UNION ALL SELECT r.conv_id, i, a.state, e.state, 3 * k + 3 * (fault = 't')::INT, letters || 'K', told || role || ':' || text || chr(10) FROM rows_ r, added a JOIN keeps e USING (entered) WHERE e.initial = r.initial AND fault NOT IN ('b', 'd')
  UNION ALL SELECT r.conv_id, i, a.state, e.state, 3 * k + 3 + 3 * (fault = 't')::INT, letters || 'R', told || e.role || ':' || text || chr(10) FROM rows_ r, added a JOIN reroles e USING (entered) WHERE fault NOT IN ('b', 'd')
), best AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS state, {{'cost': 0::BIGINT, 'audit': '', 'told': ''}} AS b FROM conversations
  UNION ALL
  SELECT b.conv_id, b.i + 1, w.state, min({{'cost': b.b.cost + w.cost, 'audit': b.b.audit || w.letters, 'told': b.b.told || w.told}})
  FROM best b JOIN ways w ON w.conv_id IS NOT DISTINCT FROM b.conv_id AND w.i = b.i + 1 AND w.since = b.state GROUP BY ALL
), ended AS (
  SELECT b.conv_id, min({{'cost': b.b.cost + 3 * k, 'audit': b.b.audit || letters, 'told': b.b.told || told}}) AS b
  FROM best b JOIN added USING (state) LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id WHERE b.i = coalesce(c.n, 0) AND entered IN (0, 3) GROUP BY b.conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  e.b.cost AS cost, e.b.audit AS audit, sha256(left(e.b.told, greatest(0, length(e.b.told) - 1))) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""

PRODUCTS = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5"""

#: All stretches in which words some distance apart are equal, of at least four distances and six words; those of a smaller period go first.
RUNS = rf"""
WITH split AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, doc_id::VARCHAR AS name FROM documents),
h AS MATERIALIZED (SELECT doc_id, ws, len(ws) AS n, {_crc32("name")} AS h FROM split),
g AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a, h // 10 AS g FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
words AS MATERIALIZED (SELECT doc_id, n, i, CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END AS word FROM (SELECT *, unnest(range(0, n)) AS i FROM p)),
same AS (SELECT x.doc_id, y.i - x.i AS period, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, period, i, i - row_number() OVER (PARTITION BY doc_id, period ORDER BY i) AS island FROM same),
stretches AS (SELECT doc_id, period, min(i) AS start, count(*) + period AS length FROM islands GROUP BY doc_id, period, island HAVING count(*) + period >= greatest(6, 4 * period)),
runs AS MATERIALIZED (SELECT doc_id, start, length, min(period) AS period FROM stretches GROUP BY doc_id, start, length),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
summed AS (
  SELECT doc_id, count(*) AS n_runs, max({{'length': length, 'start': -start, 'period': -period}}) AS top,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, -top.start AS start, top.length AS length, -top.period AS period, 1000 * top.length // -top.period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM documents d LEFT JOIN summed USING (doc_id) LEFT JOIN kept USING (doc_id)"""

ORACLE_SQL: dict[str, str] = {
    "op3_decontaminate": DECONTAMINATE,
    "op5_chat_tree": CHAT,
    "op7_substring_dedup": SUBSTRINGS,
    "op8_line_dedup": LINES,
    "op11_chat_repair": REPAIR,
    "op12_cover_search": PRODUCTS,
    "op13_periodic_runs": RUNS,
}
