"""The contamination rule in DuckDB, by joining all windows of words."""

WORDS = "list_filter(string_split_regex(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

CONTAMINATION_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS.format(t='text')} AS ws FROM documents),
b AS (SELECT item_id, {WORDS.format(t='text')} AS ws FROM benchmark),
pats AS (SELECT DISTINCT item_id, least(len(ws), 13) AS m, array_to_string(ws[i + 1 : i + least(len(ws), 13)], ' ') AS p FROM (SELECT item_id, ws, unnest(range(0, greatest(1, len(ws) - 12))) AS i FROM b WHERE len(ws) > 0)),
spots AS (SELECT rid, ws, m, unnest(range(0, len(ws) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM pats) WHERE len(ws) >= m),
occ AS (SELECT rid, i, spots.m, item_id FROM (SELECT rid, i, m, array_to_string(ws[i + 1 : i + m], ' ') AS p FROM spots) spots JOIN pats ON spots.m = pats.m AND spots.p = pats.p),
hit AS (SELECT rid, count(DISTINCT w) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS w FROM occ) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM occ GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)"""
