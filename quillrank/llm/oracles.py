"""SQL (DuckDB) for the operators that SQL can express, written from their definitions."""

OP1 = r"""
WITH raw AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, p, ls[p] AS line, len(regexp_extract_all(ls[p], '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS p FROM raw)
), words AS (
  SELECT *, row_number() OVER w AS i, sum(n) OVER w AS c FROM lines WHERE n > 0
  WINDOW w AS (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING)
), bounds AS (
  SELECT a.doc_id, a.i AS s, min(b.i) AS e
  FROM words a JOIN words b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.n >= 50 GROUP BY ALL
  UNION
  SELECT a.doc_id, max(b.i) AS s, a.i AS e
  FROM words a JOIN words b ON a.doc_id = b.doc_id AND b.i <= a.i AND a.c - b.c + b.n >= 50 GROUP BY a.doc_id, a.i
), windows AS (
  SELECT b.doc_id, b.s, b.e, min(w.p) AS lo, max(w.p) AS hi, md5(string_agg(w.line, chr(10) ORDER BY w.i)) AS content
  FROM bounds b JOIN words w ON w.doc_id = b.doc_id AND w.i BETWEEN b.s AND b.e GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, s) AS r FROM windows
), dead AS (
  SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS p FROM ranked WHERE r > 1
), rest AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.p) AS text, count(*) AS n
  FROM lines l ANTI JOIN dead USING (doc_id, p) GROUP BY l.doc_id
)
SELECT raw.doc_id, len(raw.ls)::BIGINT AS n_lines, (len(raw.ls) - coalesce(rest.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(rest.text, '')) AS kept_sha256
FROM raw LEFT JOIN rest USING (doc_id)
"""

OP6 = r"""
WITH rules(r_host, r_path, action) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), best AS (
  SELECT page_id, arg_max(r_host || r_path, length(r_host || r_path)) AS rule,
         arg_max(action, length(r_host || r_path)) AS action
  FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)
"""

OP10 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM sized GROUP BY source
), filled AS (
  SELECT *, (sum(source_size) OVER ()
             - coalesce(sum(3.0::DOUBLE * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
            (sum(weight) OVER ()
             - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM sources WINDOW w AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST)
), targets AS (
  SELECT source, source_size, least((max(level) OVER ()) * weight, 3.0::DOUBLE * source_size)::DOUBLE AS target FROM filled
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(s.source, '')), 1, 13))::BIGINT
           / 4503599627370496.0::DOUBLE AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""

def _more(path: str, cost: str, letter: str) -> str:
    """A path, as its cost in eight digits and its letters, behind one more edit."""
    return f"lpad((left({path}, 8)::INT + {cost})::VARCHAR, 8, '0') || '{letter}' || substr({path}, 9)"


def _inserts(p: list[str]) -> str:
    user = f"least({p[2]}, {_more(p[3], '2', 'I')})"
    return f"""least({p[0]}, {_more(user, '2', 'I')}) AS p0, least({p[1]}, {_more(user, '2', 'I')}) AS p1,
           {user} AS p2, least({p[3]}, {_more(p[2], '2', 'I')}) AS p3"""


def _edits(state: int) -> str:
    """The least path from before a row in a state: 0 at the start, 1 after system, 2 after user, 3 after assistant."""
    to = 3 if state == 2 else 2
    keeps = {0: [1, 2], 1: [2], 2: [3], 3: [2]}[state]
    keep = " ".join(f"WHEN kind = {k} THEN {_more(f'p{k}', 'late', 'K')}" for k in keeps)
    none = "'99999999'"
    return f"""least({_more(f'p{state}', '3', 'D')}, CASE WHEN gone THEN {none} ELSE {_more(f'p{to}', '2 + late', 'R')} END,
           CASE WHEN gone THEN {none} {keep} ELSE {none} END) AS e{state}"""


# Paths are built from the last row back; the least string is the cheapest path, and of these the ASCII-least.
OP11 = rf"""
WITH RECURSIVE coded AS (
  SELECT coalesce(conv_id, -9223372036854775808) AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), summed AS (
  -- DuckDB has no CRC-32: bit by bit, over the bytes of an ASCII key.
  SELECT key, 1 AS pos, 4294967295::BIGINT AS crc FROM (SELECT DISTINCT key FROM coded)
  UNION ALL
  SELECT key, pos + 1, list_reduce([xor(crc, ascii(key[pos])::BIGINT)] || range(8),
         lambda x, i: CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)
  FROM summed WHERE pos <= length(key)
), hit AS (
  SELECT c, turn, role, text, xor(crc, 4294967295::BIGINT) % 20 AS what FROM coded JOIN summed USING (key) WHERE pos = length(key) + 1
), damaged AS (
  SELECT c, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN what = 1 THEN '' WHEN what = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN what = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hit WHERE what <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i, count(*) OVER (PARTITION BY c) AS n,
         coalesce(instr('sua', nullif(left(role, 1), '')), 0) AS kind, regexp_replace(text, '[ 	-
]+$', '') AS said
  FROM damaged
), faults AS (
  SELECT *, CASE WHEN said = '' THEN 1 WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 2
                 WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(kind) OVER (PARTITION BY c ORDER BY i) * 4 + kind AS pair
  FROM placed
), paths AS (
  SELECT c, n AS i, '00000000' AS p0, '00000004II' AS p1, '00000002I' AS p2, '00000000' AS p3 FROM (SELECT DISTINCT c, n FROM faults)
  UNION ALL
  SELECT c, i, {_inserts(["e0", "e1", "e2", "e3"])}
  FROM (SELECT c, i - 1 AS i, {", ".join(map(_edits, range(4)))}
        FROM (SELECT p.*, f.kind, f.fault IN (1, 2) AS gone, (f.fault = 3)::INT AS late FROM paths p JOIN faults f ON p.c = f.c AND p.i = f.i))
), best AS (
  SELECT c, left(p0, 8)::BIGINT AS cost, substr(p0, 9) AS audit FROM paths WHERE i = 0
), letters AS (
  SELECT c, pos, audit[pos] AS edit, length(replace(left(audit, pos), 'I', '')) AS i, length(replace(left(audit, pos), 'D', '')) AS m
  FROM (SELECT c, audit, unnest(range(1, length(audit) + 1)) AS pos FROM best)
), turns AS (
  SELECT l.*, f.role, f.text, max((m = 1 AND edit = 'K' AND f.kind = 1)::INT) OVER (PARTITION BY l.c) AS led
  FROM letters l LEFT JOIN faults f ON f.c = l.c AND f.i = l.i AND edit <> 'I' WHERE edit <> 'D'
), repaired AS (
  SELECT c, string_agg(CASE WHEN edit = 'K' THEN role WHEN (m - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
                       CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS lines
  FROM turns GROUP BY c
), counted AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum((fault = 1)::INT) AS blank, sum((fault = 2)::INT) AS duplicate,
         sum((fault = 3)::INT) AS truncated, sum((pair IS NOT NULL AND pair NOT IN (6, 11, 14))::INT) AS illegal
  FROM faults GROUP BY c
)
SELECT nullif(g.c, -9223372036854775808) AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT c FROM coded) g LEFT JOIN counted USING (c) LEFT JOIN best USING (c) LEFT JOIN repaired USING (c)
"""

OP12 = r"""
WITH judged AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), split AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(j.toxic, 0) AS toxic,
         [(len(ws) < 50)::INT, (100 * len(list_distinct(ws)) < 65 * len(ws))::INT,
          (100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text))::INT,
          regexp_matches(text, '[#$%&*|]')::INT, (s.doc_id > min(s.doc_id) OVER (PARTITION BY text))::INT] AS f
  FROM split s LEFT JOIN judged j ON s.doc_id = j.doc_id
), masks AS (
  SELECT part, f[1] + 2 * f[2] + 4 * f[3] + 8 * f[4] + 16 * f[5] AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM failed GROUP BY ALL
), subsets AS (SELECT unnest(range(32)) AS s
), survivors AS (
  SELECT p.part, s, coalesce(sum(n) FILTER ((mask & s) = 0), 0) AS n, coalesce(sum(good) FILTER ((mask & s) = 0), 0) AS good,
         coalesce(sum(toxic) FILTER ((mask & s) = 0), 0) AS toxic
  FROM (SELECT DISTINCT part FROM masks) p CROSS JOIN subsets JOIN masks m ON m.part = p.part GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step, 1 << (instr('ABCDE', filter_order[step]) - 1) AS own,
         list_sum([0] || list_transform(range(1, step), lambda i: 1 << (instr('ABCDE', filter_order[i]) - 1)))::INT AS before
  FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders)
), counted AS (
  SELECT b.part, filter_order, step, own, a.n AS kept, b.n - a.n AS removed, b.good - a.good AS good_lost, b.toxic - a.toxic AS toxic_lost
  FROM steps JOIN survivors b ON b.s = before JOIN survivors a ON a.part = b.part AND a.s = before + own
)
SELECT c.part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       (z.n - o.n - removed)::BIGINT AS redundant, (r.n - l.n)::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY c.part, own))::BIGINT AS shapley
FROM counted c JOIN survivors z ON z.part = c.part AND z.s = 0 JOIN survivors o ON o.part = c.part AND o.s = own
JOIN survivors r ON r.part = c.part AND r.s = 31 - own JOIN survivors l ON l.part = c.part AND l.s = 31
"""

OP13 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[i:i + 9], ' ') AS gram
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), found AS (
  SELECT d, item_id, k, i FROM (
    SELECT d, k, i, array_to_string(ws[i:i + k - 1], ' ') AS gram
    FROM (SELECT d, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM grams) WHERE len(ws) >= k)
  ) JOIN grams USING (k, gram)
), hit AS (
  SELECT d, count(DISTINCT w) AS n FROM (SELECT d, unnest(range(i, i + k)) AS w FROM found) GROUP BY d
), items AS (
  SELECT d, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT d, item_id::VARCHAR AS item FROM found) GROUP BY d
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (d) LEFT JOIN items USING (d)
"""

ORACLES = {"op1_line_dedup": OP1, "op6_url_filter": OP6, "op10_mixing": OP10, "op11_conversation_repair": OP11, "op12_filter_audit": OP12, "op13_decontamination": OP13}
