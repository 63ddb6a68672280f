"""DuckDB SQL of the operators whose rows SQL can state."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Size, source_size and target of the mix: what op1 aims at. The shares are found by taking the sources
#: that reach their most in turn; a source that is full at some share stays full as the share grows.
MIX_TARGETS = r"""WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
n AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM s),
-- by the share at which a source is full
o AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS place FROM n),
f AS (SELECT *, ((SELECT sum(source_size) FROM n) - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY place DESC) AS share FROM o),
e AS (SELECT coalesce(min(place) FILTER (3 * source_size / weight >= share), 0) AS first FROM f),
t AS (SELECT source, source_size, CASE WHEN first = 0 OR place < first THEN 3.0 * source_size ELSE weight * (SELECT share FROM f WHERE place = first) END AS target FROM f, e)
SELECT d.doc_id, size, source_size, round(target, 4) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source"""

NEIGHBOURS = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
w AS (SELECT * FROM v WHERE len(v) = (SELECT mode(len(v)) FROM v) AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(c.v, q.v) AS score FROM w q JOIN w c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p QUALIFY rank <= 20"""

REPEATS = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
g AS (SELECT doc_id, i, md5(h[i:i + 99]) AS k FROM d, unnest(generate_series(1, octet_length(h) - 99)) AS u(i)),
r AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
e AS (SELECT *, lag(i) OVER w AS before, lead(i) OVER w AS after FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT *, count(*) FILTER (before IS NULL OR i > before + 100) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM e),
s AS (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS b FROM m GROUP BY ALL),
c AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM s GROUP BY 1)
SELECT d.doc_id, octet_length(h) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN starts IS NULL THEN h ELSE unhex(array_to_string(list_transform(generate_series(1, len(starts) + 1), lambda k: hex(h[CASE WHEN k = 1 THEN 1 ELSE ends[k - 1] END:CASE WHEN k > len(starts) THEN octet_length(h) ELSE starts[k] - 1 END])), '')) END) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)"""

NEAR_GROUPS = rf"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, t.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT v AS doc_id, min(root) AS component_id FROM r GROUP BY 1) t USING (doc_id)"""
