"""The operators in DuckDB SQL, over whole tables, where SQL can say them."""

from __future__ import annotations


def crc32(number: str) -> str:
    """Unsigned CRC-32 of the decimal text of a number, bit by bit."""
    text = f"({number})::VARCHAR"
    chars = f"list_transform(range(0, 1 + length({text})), lambda k: CASE WHEN k = 0 THEN 4294967295 ELSE ascii(substr({text}, k, 1)) END::BIGINT)"
    byte = "list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce({chars}, lambda c, b: {byte}), 4294967295)"


def _leaf(text: str) -> str:
    def part(v: str) -> str:
        return f"coalesce(strlen(({v})::VARCHAR) || ':' || ({v})::VARCHAR, '-')"

    return f"sha256({' || '.join(part(v) for v in ('doc_id', 'source', 'lang', 'n_chars', text))})"


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MERKLE = f"""
WITH RECURSIVE leaves AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
    FROM (SELECT doc_id, lang, {_leaf('text')} AS leaf, CASE WHEN {crc32('doc_id')} % 3 = 0 THEN {_leaf(LOWER)} END AS claimed FROM documents)),
places AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k, count(*) AS n FROM leaves GROUP BY lang),
inner_nodes AS (
    SELECT k, 0 AS level, i, leaf AS h, n FROM leaves JOIN places ON leaves.lang IS NOT DISTINCT FROM places.lang
    UNION ALL
    SELECT k, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 7) // 8) FROM inner_nodes WHERE n > 1 GROUP BY k, level, i // 8),
outer_nodes AS (
    SELECT 0 AS level, k AS i, h, (SELECT count(*) FROM places) AS n FROM inner_nodes WHERE n = 1
    UNION ALL
    SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 7) // 8) FROM outer_nodes WHERE n > 1 GROUP BY level, i // 8),
ways AS (
    SELECT doc_id, leaf, claimed, k, i, row_number() OVER () AS r FROM leaves JOIN places ON leaves.lang IS NOT DISTINCT FROM places.lang),
siblings AS (
    SELECT r, 0 AS tree, level, x.i < (w.i // (8 ** level)::BIGINT) AS before, x.i, h
    FROM ways w JOIN inner_nodes x ON x.k = w.k AND x.n > 1 AND x.i // 8 = w.i // (8 ** (level + 1))::BIGINT AND x.i <> w.i // (8 ** level)::BIGINT
    UNION ALL
    SELECT r, 1, level, x.i < (w.k // (8 ** level)::BIGINT), x.i, h
    FROM ways w JOIN outer_nodes x ON x.n > 1 AND x.i // 8 = w.k // (8 ** (level + 1))::BIGINT AND x.i <> w.k // (8 ** level)::BIGINT),
proofs AS (SELECT r, sha256(string_agg(h, '' ORDER BY tree, level, i)) AS proof_sha256 FROM siblings GROUP BY r),
-- every level of a way, those without siblings too, numbered from the leaf to the root
heights AS (SELECT k, max(level) AS up FROM inner_nodes GROUP BY k),
runs AS (
    SELECT r, step, string_agg(h, '' ORDER BY i) FILTER (before) AS lo, string_agg(h, '' ORDER BY i) FILTER (NOT before) AS hi
    FROM (SELECT w.r, CASE s.tree WHEN 0 THEN s.level ELSE up + s.level END AS step, s.before, s.i, s.h
          FROM ways w JOIN heights USING (k) JOIN siblings s ON s.r = w.r) GROUP BY r, step),
folds AS (
    SELECT r, k, 0 AS step, coalesce(claimed, leaf) AS h FROM ways
    UNION ALL
    SELECT f.r, f.k, f.step + 1, sha256(coalesce(lo, '') || h || coalesce(hi, ''))
    FROM folds f JOIN heights t ON t.k = f.k LEFT JOIN runs u ON u.r = f.r AND u.step = f.step
    WHERE f.step < t.up + (SELECT max(level) FROM outer_nodes))
SELECT w.doc_id, w.leaf, s.h AS subroot, t.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified, w.k::INTEGER AS tree, w.i AS idx
FROM ways w JOIN heights g USING (k) JOIN outer_nodes t ON t.n = 1 JOIN inner_nodes s ON s.k = w.k AND s.n = 1
JOIN folds f ON f.r = w.r AND f.step = g.up + t.level LEFT JOIN proofs p ON p.r = w.r
"""

TRIE = f"""
WITH own AS (
    SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS seq
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
built AS (
    SELECT o.conv_id, list_concat(coalesce(b.seq, [])[1:h], o.seq[h + 1:]) AS seq
    FROM (SELECT *, {crc32('conv_id')} % 9 AS h FROM own) o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
nodes AS (
    SELECT d, seq[1:d] AS key, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = len(seq)), '')) AS ends_sha256
    FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM built) GROUP BY ALL),
kids AS (SELECT d - 1 AS d, key[1:d - 1] AS key, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
valued AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children, coalesce((n_convs - 1) * strlen(key[d].t), 0) AS own FROM nodes LEFT JOIN kids USING (d, key)),
sums AS (
    SELECT a AS d, key[1:a] AS key, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
    FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM valued) GROUP BY ALL)
SELECT v.conv_id, d AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM valued v JOIN sums USING (d, key) LEFT JOIN nodes p ON p.d = v.d - 1 AND p.key = v.key[1:v.d - 1]
"""

SQL = {"op12_merkle": MERKLE, "op13_trie": TRIE}
