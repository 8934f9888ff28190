"""DuckDB SQL of the queries over ``conversations``, from the definitions: turn by turn and prefix by
prefix, without grammars or blocks."""

#: CRC-32 of an ASCII text (fixed values: its polynomial and its start), byte by byte and bit by bit.
CRC = ("xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda x: ascii(x)::BIGINT)), "
       "lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), "
       "lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)))")
WORDS = r"len(regexp_extract_all({}, '[^\x20\x09-\x0D]+'))"

ORACLES: dict[str, str] = {
    # one step per turn: the cheapest way to each state, then up to two inserted turns
    "op12_structure_repair": f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS draw FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM raw, unnest(range(CASE WHEN draw = 0 THEN 0 WHEN draw = 3 THEN 2 ELSE 1 END)) AS t(copy)),
ids AS (SELECT conv_id, row_number() OVER () AS k FROM (SELECT DISTINCT conv_id FROM conversations)),
placed AS (
  SELECT k, turn, role, text, left(role, 1) AS r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]') AS ink,
         row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, md5(text)) AS i
  FROM hurt JOIN ids ON hurt.conv_id IS NOT DISTINCT FROM ids.conv_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY k, role, text ORDER BY i) AS nth, lag(r) OVER (PARTITION BY k ORDER BY i) AS before FROM placed),
turns AS (
  SELECT *, CASE WHEN len(ink) = 0 THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                 WHEN ink[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM ranked),
facts AS (
  SELECT k, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE i > 1 AND NOT (length(before) = 1 AND length(r) = 1 AND before || r IN ('su', 'ua', 'au'))) AS illegal,
         count(*) AS n FROM turns GROUP BY k),
emit(a, r, b) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
ins(b, c, n) AS (VALUES (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)),
edits AS (
  SELECT k, i, a, a AS b, 3 AS cost, 'D' AS e FROM turns, (VALUES (0), (1), (2), (3)) AS s(a)
  UNION ALL SELECT k, i, a, b, (fault <> '')::INT, 'K' FROM turns JOIN emit USING (r) WHERE fault IN ('', 'truncated')
  UNION ALL SELECT k, i, a, b, 2 + (fault <> '')::INT, 'R' FROM turns, emit WHERE emit.r <> 's' AND fault IN ('', 'truncated')),
moves AS (
  SELECT k, i, a, c, min({{'cost': cost + 2 * n, 'e': e || repeat('I', n)}}) AS best FROM edits JOIN ins USING (b) GROUP BY k, i, a, c),
ways(k, i, c, best) AS (
  SELECT k, 0::BIGINT, c, {{'cost': 2 * n, 'e': repeat('I', n)}} FROM ids, ins WHERE b = 0
  UNION ALL
  SELECT w.k, w.i + 1, m.c, min({{'cost': w.best.cost + m.best.cost, 'e': w.best.e || m.best.e}})
  FROM ways w JOIN moves m ON m.k = w.k AND m.i = w.i + 1 AND m.a = w.c GROUP BY w.k, w.i + 1, m.c),
found AS (
  SELECT ids.k, min(best) AS best FROM ids LEFT JOIN facts ON facts.k = ids.k JOIN ways w ON w.k = ids.k
  WHERE w.i = coalesce(n, 0) AND c IN (0, 3) GROUP BY ids.k),
letters AS (SELECT k, p, substr(best.e, p, 1) AS e FROM found, unnest(range(1, length(best.e) + 1)) AS t(p)),
numbered AS (
  SELECT *, count(*) FILTER (WHERE e <> 'I') OVER (PARTITION BY k ORDER BY p) AS i,
         count(*) FILTER (WHERE e <> 'D') OVER (PARTITION BY k ORDER BY p) AS o FROM letters),
kept AS (
  SELECT l.k, p, e, o, t.role, CASE WHEN e = 'I' THEN '' ELSE t.text END AS text,
         max((o = 1 AND e = 'K' AND t.r = 's')::INT) OVER (PARTITION BY l.k) AS lead
  FROM numbered l LEFT JOIN turns t ON t.k = l.k AND t.i = l.i WHERE e <> 'D'),
repaired AS (
  SELECT k, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS x
  FROM kept GROUP BY k)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.cost::BIGINT AS cost, best.e AS audit,
       sha256(coalesce(x, '')) AS repaired_sha256
FROM ids JOIN found USING (k) LEFT JOIN facts USING (k) LEFT JOIN repaired USING (k)""",
    "op13_prefix_trie": f"""
WITH turns AS (
  SELECT conv_id AS c, turn, coalesce(text, '') AS text,
         md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, t, {WORDS.format("text")} AS w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, t) AS n FROM turns),
ids AS (SELECT c, c - c % 20 AS base, {CRC.format("c::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT c FROM turns)),
parts AS (
  SELECT i.c, 0 AS kind, n, t, w FROM ids i JOIN own o ON o.c = i.base AND n <= h WHERE i.base <> i.c
  UNION ALL SELECT i.c, 1, n, t, w FROM ids i JOIN own o ON o.c = i.c WHERE n > h OR i.base = i.c),
path AS (SELECT c, t, w, row_number() OVER (PARTITION BY c ORDER BY kind, n) AS d FROM parts),
prefix AS (
  SELECT c, d, w, string_agg(t, '') OVER (PARTITION BY c ORDER BY d) AS node FROM path
  UNION ALL SELECT c, 0, 0, '' FROM ids),
nodes AS (SELECT node, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w FROM prefix GROUP BY node),
children AS (SELECT left(node, 32 * (depth - 1)) AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (
  SELECT left(u.node, 32 * a) AS node, sum((n_convs - 1) * w) AS saved, count(*) FILTER (WHERE n IS NULL) AS leaves
  FROM nodes u LEFT JOIN children k ON k.node = u.node, unnest(range(depth + 1)) AS r(a) GROUP BY 1),
ends AS (
  SELECT node, string_agg(c::VARCHAR, ',' ORDER BY c) AS x FROM (SELECT c, max_by(node, d) AS node FROM prefix GROUP BY c) GROUP BY node)
SELECT v.conv_id, v.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs::BIGINT AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(x, '')) AS ends_sha256
FROM nodes v LEFT JOIN nodes p ON v.depth > 0 AND p.node = left(v.node, 32 * (v.depth - 1)) LEFT JOIN children k ON k.node = v.node
JOIN below b ON b.node = v.node LEFT JOIN ends e ON e.node = v.node""",
}
