"""SQL for the queries of this subpackage that SQL can express over whole tables."""

from __future__ import annotations

_TASKS = "t AS (SELECT DISTINCT ON (example_id) * FROM filtered)"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


_WORDS = r"regexp_extract_all(lower(x), '[\p{L}\p{N}_]+')"

SQL = {
    "p1_found": f"""WITH {_TASKS}, k AS (SELECT DISTINCT example_id AS id, {_strip('x')} AS tok FROM (SELECT example_id, unnest(list_concat(list_concat(coalesce(dependency.intra_class, []), coalesce(dependency.intra_file, [])), coalesce(dependency.cross_file, []))) AS x FROM t)
        WHERE {_strip('x')} <> ''), n AS (SELECT id, count(*) AS n FROM k GROUP BY id HAVING count(*) >= 3), o AS (SELECT a.id AS a, b.id AS b, count(*) AS o FROM k a JOIN k b ON a.tok = b.tok AND a.id < b.id GROUP BY ALL)
        SELECT a AS example_id_a, b AS example_id_b FROM o JOIN n x ON a = x.id JOIN n y ON b = y.id WHERE o >= 0.6 * (x.n + y.n - o) - 1e-9""",
    "p3_found": rf"""WITH {_TASKS}, c AS (SELECT split_part(replace(lower({_strip('project_path')}), '\', '/'), '/', 1) AS domain, replace(lower({_strip('type')}), '\', '/') AS type FROM t WHERE project_path IS NOT NULL AND type IS NOT NULL),
        n AS (SELECT domain, type, count(*) AS n FROM c GROUP BY ALL)
        SELECT lower(s.domain) AS domain, lower(s.type) AS type FROM sample_targets s LEFT JOIN n ON lower(s.domain) = n.domain AND lower(s.type) = n.type
        WHERE coalesce(n, 0) < greatest(coalesce(min_rows, 0), (coalesce(target_permille, 0)::BIGINT * coalesce(sample_size, 0) + 999) // 1000)""",
    "p7_found": rf"""WITH RECURSIVE {_TASKS}, l AS (SELECT DISTINCT replace(lower({_strip('project_path')}), '\', '/') AS p, lower(split_part(namespace, '.', 1)) AS k FROM t WHERE project_path IS NOT NULL AND split_part(namespace, '.', 1) <> ''),
        e AS (SELECT DISTINCT x.p AS a, y.p AS b FROM l x JOIN l y ON x.k = y.k AND x.p <> y.p), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT DISTINCT a AS project_a, b AS project_b FROM r WHERE a < b""",
    "p10_figures": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), w AS (SELECT doc_id, x, {_WORDS} AS w, list_filter(regexp_split_to_array(x, '\r\n|\n|\r'), lambda s: length(regexp_replace(s, '\s', '', 'g')) > 0) AS ls FROM d),
        c AS (SELECT list(DISTINCT lower(word)) AS c FROM common_words)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(list_sum(list_transform(w, lambda s: length(s))) / nullif(len(w), 0)::DOUBLE, 0), 6) AS mean_word_len,
        round(coalesce(length(regexp_replace(x, '[\p{{L}}\p{{N}}\s]', '', 'g')) / nullif(length(regexp_replace(x, '\s', '', 'g')), 0)::DOUBLE, 0), 6) AS symbol_ratio,
        round(coalesce(len(list_filter(ls, lambda s: regexp_matches(s, '[.!?]\s*$'))) / nullif(len(ls), 0)::DOUBLE, 0), 6) AS punct_line_share,
        round(coalesce(len(list_filter(w, lambda s: list_contains(c, s))) / nullif(len(w), 0)::DOUBLE, 0), 6) AS common_share FROM w, c""",
}
