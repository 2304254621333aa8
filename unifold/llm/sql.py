"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

SUBSTRING = f"""
WITH w AS (SELECT row_number() OVER () rn, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') ws FROM documents),
u AS (SELECT rn, unnest(list_transform(range(1, len(ws) - 33), lambda i: md5(array_to_string(ws[i:i+34], ' ')))) h, unnest(range(1, len(ws) - 33)) i FROM w WHERE len(ws) >= 35),
twice AS (SELECT h FROM u GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT rn, i + o.range k FROM u SEMI JOIN twice USING (h), range(35) o),
t AS (SELECT rn, unnest(ws) word, unnest(range(1, len(ws) + 1)) k FROM w),
left_ AS (SELECT rn, string_agg(word, ' ' ORDER BY k) kept, count(*) n FROM t ANTI JOIN gone USING (rn, k) GROUP BY rn)
SELECT doc_id, len(ws)::BIGINT n_words, len(ws)::BIGINT - coalesce(n, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM w LEFT JOIN left_ USING (rn)
"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') ws FROM documents),
s AS (SELECT DISTINCT rn, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: md5(array_to_string(ws[i:i+4], ' '))) ELSE [md5(array_to_string(ws, ' '))] END) h FROM w WHERE len(ws) > 0),
n AS (SELECT rn, count(*) n FROM s GROUP BY rn),
link AS (SELECT a.rn a, b.rn b FROM s a JOIN s b ON a.h = b.h AND a.rn <> b.rn JOIN n x ON x.rn = a.rn JOIN n y ON y.rn = b.rn GROUP BY a.rn, b.rn, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach(rn, other) AS (SELECT rn, rn FROM w UNION SELECT r.rn, link.b FROM reach r JOIN link ON link.a = r.other)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT n_shingles, c.component_id FROM w LEFT JOIN n USING (rn) JOIN (SELECT reach.rn, min(o.doc_id) component_id FROM reach JOIN w o ON o.rn = reach.other GROUP BY 1) c USING (rn)
"""

ORACLE = {"op1_substring_dedup": SUBSTRING, "op5_ngram_jaccard": JACCARD}
