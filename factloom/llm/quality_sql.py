"""DuckDB SQL of the quality query."""

WORDS = r"[^\x20\x09-\x0D]+"


def quality_sql(common: int = 20, class_limit: float = 0.25, word_limit: float = 0.30, least_chars: int = 200,
                least_words: int = 50) -> str:
    def jensen_shannon(p: str, q: str) -> str:
        def part(x: str) -> str:
            return f"CASE WHEN {x}[i] > 0 THEN {x}[i] * log2({x}[i] / (({p}[i] + {q}[i]) / 2)) ELSE 0.0 END"
        return f"sqrt(greatest(0.0, list_sum([({part(p)} + {part(q)}) / 2 FOR i IN range(1, len({q}) + 1)])))"

    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '\\p{{L}}+', '', 'g') AS r,
                  regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS ls FROM documents),
c AS (SELECT doc_id, lang, t, ws, ls, r, len(t) AS n, len(r) AS left_, len(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS up,
             len(regexp_replace(r, '[^\\p{{Nd}}]+', '', 'g')) AS di, len(regexp_replace(r, '[^.,]+', '', 'g')) AS st,
             len(regexp_replace(r, '[^\\x20\\x09-\\x0D]+', '', 'g')) AS bl FROM d),
k AS (SELECT doc_id, lang, t, ws, ls, r, n, bl, [n - left_ - up, up, di, bl, st, left_ - di - bl - st]::DOUBLE[] AS cc FROM c),
rc AS (SELECT lang AS l1, [sum(cc[1]), sum(cc[2]), sum(cc[3]), sum(cc[4]), sum(cc[5]), sum(cc[6])] AS cs
       FROM k GROUP BY lang),
u AS (SELECT lang, unnest(regexp_extract_all(lower(t), '\\p{{L}}+')) AS w FROM k),
s AS (SELECT lang, w, count(*) AS m FROM u GROUP BY ALL),
o AS (SELECT lang, w, m, sum(m) OVER (PARTITION BY lang) AS a, row_number() OVER (PARTITION BY lang ORDER BY m DESC, w) AS rk FROM s),
rw AS (SELECT lang AS l2, list(w ORDER BY rk) AS common, list(m / a ORDER BY rk) AS sh FROM o WHERE rk <= {common} GROUP BY lang),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS g FROM k, LATERAL (SELECT unnest(range(1, len(ws) - 6)) AS i)),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n_rep FROM dup, range(0, 8) x(j) GROUP BY doc_id),
dw AS (SELECT doc_id, w, count(*) AS m FROM (SELECT doc_id, unnest(regexp_extract_all(lower(t), '\\p{{L}}+')) AS w FROM k) GROUP BY ALL),
f AS (SELECT k.doc_id, list(coalesce(dw.m, 0)::DOUBLE ORDER BY o.rk) AS found FROM k JOIN o ON o.lang IS NOT DISTINCT FROM k.lang AND o.rk <= {common}
      LEFT JOIN dw ON dw.doc_id = k.doc_id AND dw.w = o.w GROUP BY k.doc_id),
a AS (SELECT k.doc_id, len(ws)::BIGINT AS n_words, (n - bl)::BIGINT AS word_chars,
             len(regexp_replace(r, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_rep, 0)::BIGINT AS n_repeat_words, n, cc,
             [x / greatest(1.0, list_sum(cs)) FOR x IN cs] AS cq, list_append(found, greatest(0.0, len(ws) - list_sum(found))) AS wc,
             list_append(sh, 1.0 - list_sum(sh)) AS wq
      FROM k LEFT JOIN rep ON rep.doc_id = k.doc_id JOIN rc ON rc.l1 IS NOT DISTINCT FROM k.lang
      LEFT JOIN rw ON rw.l2 IS NOT DISTINCT FROM k.lang LEFT JOIN f ON f.doc_id = k.doc_id),
p AS (SELECT *, [x / list_sum(cc) FOR x IN cc] AS cp, [x / list_sum(wc) FOR x IN wc] AS wp,
             n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a),
v AS (SELECT *, CASE WHEN n >= {least_chars} THEN round({jensen_shannon('cp', 'cq')}, 6) END AS class_distance,
             CASE WHEN n_words >= {least_words} THEN round({jensen_shannon('wp', 'wq')}, 6) END AS word_distance FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance,
       NOT base_failed AND coalesce(class_distance, 0) <= {class_limit} AND coalesce(word_distance, 0) <= {word_limit} AS kept
FROM v"""
