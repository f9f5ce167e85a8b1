"""DuckDB SQL for the queries that SQL can express on whole tables."""

_LINES = """
    lines AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
    keyed AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
    bad AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    marked AS (SELECT k.doc_id, k.pos, k.line, b.last IS NOT NULL AND k.doc_id <> b.last AS dropped FROM keyed k LEFT JOIN bad b ON k.key = b.key)"""

_WORDS = "list_filter(regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_PLAIN = _WORDS.format(text="coalesce(text, '')")
_LOWER = _WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

ORACLE = {
    "op5_substring_dedup": f"""
    WITH words AS (SELECT doc_id, generate_subscripts({_PLAIN}, 1) AS pos, unnest({_PLAIN}) AS word FROM documents),
    starts AS (SELECT *, string_agg(word, ' ') OVER w AS seq, count(*) OVER w AS n FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
    first AS (SELECT seq, min(doc_id) AS d FROM starts WHERE n = 13 GROUP BY seq),
    marked AS (SELECT s.doc_id, s.pos, s.word, coalesce(f.d < s.doc_id, FALSE) AS hit FROM starts s LEFT JOIN first f ON s.n = 13 AND f.seq = s.seq),
    covered AS (SELECT doc_id, pos, word, max(hit::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) = 1 AS gone FROM marked),
    done AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS r, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM covered GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN done USING (doc_id)""",
    "op8_near_dedup": f"""
    WITH RECURSIVE w AS (SELECT doc_id, {_LOWER} AS ws FROM documents),
    seqs AS (SELECT doc_id, CASE WHEN len(ws) >= 2 THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) WHEN len(ws) = 1 THEN ws ELSE [] END AS s FROM w),
    size AS (SELECT doc_id, len(s) AS n FROM seqs),
    same AS (SELECT s, min(doc_id) AS class_id FROM (SELECT doc_id, list_sort(s) AS s FROM seqs WHERE len(s) > 0) GROUP BY s),
    class AS (SELECT q.doc_id, class_id FROM seqs q JOIN same ON list_sort(q.s) = same.s),
    item AS (SELECT doc_id, unnest(s) AS x FROM seqs WHERE doc_id IN (SELECT class_id FROM same)),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM item a JOIN item b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
    link AS (SELECT a, b FROM shared JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
    both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach(id, r) AS (SELECT class_id, class_id FROM same UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r),
    comp AS (SELECT id, min(r) AS c FROM reach GROUP BY id),
    degree AS (SELECT a AS id, count(*) AS links FROM both_ways GROUP BY a)
    SELECT z.doc_id, z.n::BIGINT AS n_shingles, coalesce(c, z.doc_id) AS component_id, coalesce(c, z.doc_id) = z.doc_id AS kept, coalesce(class_id, z.doc_id) AS class_id,
        coalesce(links, 0)::BIGINT AS links
    FROM size z LEFT JOIN class USING (doc_id) LEFT JOIN comp ON comp.id = class_id LEFT JOIN degree ON degree.id = class_id""",
    "op4_line_dedup": f"""
    WITH {_LINES}
    SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE dropped))::BIGINT AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
    FROM marked GROUP BY doc_id""",
    "op6_exact_dedup": """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, (count(*) OVER w)::BIGINT AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
