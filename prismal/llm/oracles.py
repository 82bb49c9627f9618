"""DuckDB SQL of the training-data queries that SQL can express."""

OP3 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
l AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS raw FROM d),
n AS (SELECT doc_id, source, t, raw, lower(trim(regexp_replace(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'))) AS line, len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS nw FROM l),
dl AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM n WHERE nw > 0 GROUP BY doc_id),
h AS (SELECT source, count(DISTINCT t) AS docs FROM d GROUP BY source),
f AS (SELECT n.source, n.line FROM n JOIN h ON n.source IS NOT DISTINCT FROM h.source WHERE nw > 0 GROUP BY n.source, n.line, h.docs HAVING count(DISTINCT t) > 5 AND count(DISTINCT t) > 0.05 * h.docs),
x AS (SELECT n.doc_id, sum(nw) AS gone FROM n JOIN f ON n.line = f.line AND n.source IS NOT DISTINCT FROM f.source GROUP BY n.doc_id),
b AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(list_aggregate(list_concat(w, ['']), 'string_agg', '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dl.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone, 0) AS BIGINT) AS gone
  FROM d LEFT JOIN rw USING (doc_id) LEFT JOIN dl USING (doc_id) LEFT JOIN x USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 2 * gone <= n_words AS kept FROM v
"""

OP7 = r"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, w[a:a + least(len(w), 10) - 1] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS a FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT doc_id, a, n, w[a:a + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS a FROM d, (SELECT DISTINCT len(win) AS n FROM iw))),
m AS (SELECT doc_id, a, n, item_id FROM dw JOIN iw ON dw.win = iw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(a, a + n)) AS p FROM m) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS c, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.c, 0) AS BIGINT) AS n_hit, CAST(coalesce(k.c, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(h.c, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
"""

#: Unsigned crc32 of a decimal number: bit by bit over its digits.
CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

OP11 = rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(struct_pack(r := r, t := t) ORDER BY k) AS own, {CRC.format("conv_id")} % 4 AS h FROM t GROUP BY conv_id),
b AS (SELECT c.conv_id, list_concat(coalesce(o.own[1:c.h], []), c.own[c.h + 1:]) AS seq FROM c LEFT JOIN c o ON o.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, len(seq) = d AS ends, d, seq[1:d] AS pre FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM b)),
n AS (SELECT d, pre, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY d, pre),
k AS (SELECT d - 1 AS d, pre[1:d - 1] AS pre, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(kids, 0) AS kids, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.pre[n.d].t, '[^\x20\x09-\x0D]+')) END AS saved FROM n LEFT JOIN k ON n.d = k.d AND n.pre = k.pre),
s AS (SELECT j, pre[1:j] AS pre, sum(saved) AS saved, count(*) FILTER (kids = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM m) GROUP BY j, pre[1:j])
SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.kids AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN s ON s.j = m.d AND s.pre = m.pre LEFT JOIN n u ON m.d > 0 AND u.d = m.d - 1 AND u.pre = m.pre[1:m.d - 1]
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{chars}", "text")) + ")"
_SIDE = "CASE WHEN {0}.node IS NULL THEN '' WHEN {0}.i < {1} THEN 'L' || {0}.node ELSE 'R' || {0}.node END"

OP12 = f"""
WITH RECURSIVE f AS (SELECT doc_id, lang, {_LEAF.format(chars="n_chars")} AS leaf, {_LEAF.format(chars="(n_chars + 1)")} AS longer, doc_id IS NOT NULL AND {CRC.format("coalesce(doc_id, 0)")} % 7 = 0 AS picked FROM documents),
l AS (SELECT doc_id, lang, leaf, CASE WHEN picked THEN longer ELSE leaf END AS shown, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM f),
up AS (SELECT lang, 0 AS lvl, i, leaf AS node FROM l
  UNION ALL SELECT lang, lvl + 1, i // 2, sha256(string_agg(node, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM up) WHERE n > 1 GROUP BY lang, lvl, i // 2),
h AS (SELECT lang, max(lvl) AS top FROM up GROUP BY lang),
sub AS (SELECT up.lang, node, row_number() OVER (ORDER BY up.lang NULLS FIRST) - 1 AS i FROM up JOIN h ON up.lang IS NOT DISTINCT FROM h.lang AND lvl = top),
over_ AS (SELECT 0 AS lvl, i, node FROM sub
  UNION ALL SELECT lvl + 1, i // 2, sha256(string_agg(node, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM over_) WHERE n > 1 GROUP BY lvl, i // 2),
root AS (SELECT node AS root, lvl AS top FROM over_ ORDER BY lvl DESC LIMIT 1),
a AS (SELECT l.lang, l.i, list({_SIDE.format("s", "l.i >> e.lvl")} ORDER BY e.lvl) AS path
  FROM l JOIN h ON l.lang IS NOT DISTINCT FROM h.lang JOIN (SELECT DISTINCT lvl FROM up) e ON e.lvl < h.top
  LEFT JOIN up s ON s.lang IS NOT DISTINCT FROM l.lang AND s.lvl = e.lvl AND s.i = xor(l.i >> e.lvl, 1) GROUP BY l.lang, l.i),
o AS (SELECT sub.lang, list({_SIDE.format("s", "sub.i >> e.lvl")} ORDER BY e.lvl) AS path
  FROM sub JOIN root ON true JOIN (SELECT DISTINCT lvl FROM over_) e ON e.lvl < root.top LEFT JOIN over_ s ON s.lvl = e.lvl AND s.i = xor(sub.i >> e.lvl, 1) GROUP BY sub.lang),
w AS (SELECT l.*, sub.node AS subroot, root.root, list_concat(coalesce(a.path, []), coalesce(o.path, [])) AS path
  FROM l JOIN sub ON l.lang IS NOT DISTINCT FROM sub.lang JOIN root ON true LEFT JOIN a ON a.lang IS NOT DISTINCT FROM l.lang AND a.i = l.i LEFT JOIN o ON o.lang IS NOT DISTINCT FROM l.lang),
z AS (SELECT *, list_reduce(list_concat([shown], path), lambda x, s: CASE WHEN s = '' THEN sha256(x) WHEN s[1] = 'L' THEN sha256(s[2:] || x) ELSE sha256(x || s[2:]) END) AS folded_root FROM w)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM z
"""

ORACLES: dict[str, str] = {"op3_line_quality": OP3, "op7_decontamination": OP7, "op11_conversation_trie": OP11, "op12_merkle_manifest": OP12}
