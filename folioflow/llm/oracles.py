"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

from . import decontaminate, mixing, quality, substring

UPPER, LOWER = decontaminate.UPPER, decontaminate.LOWER
SPACED = r"[^\x20\x09-\x0D]+"

OP5 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - {substring.WIDTH - 2})) AS i FROM d WHERE len(w) >= {substring.WIDTH}),
k AS (SELECT doc_id, i, array_to_string(w[i:i + {substring.WIDTH - 1}], ' ') AS key FROM p),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY key) < doc_id AS again FROM k),
gone AS (SELECT DISTINCT doc_id, i + unnest(range({substring.WIDTH})) AS j FROM f WHERE again),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS s FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP7 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
bw AS (SELECT item, w, least(len(w), {decontaminate.WINDOW}) AS n FROM b WHERE len(w) > 0),
keys AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS key FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bw) q),
dw AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM keys) x WHERE len(w) >= n),
hit AS (SELECT doc_id, i, dw.n, item FROM dw JOIN keys ON keys.n = dw.n AND keys.key = array_to_string(w[i:i + dw.n - 1], ' ')),
places AS (SELECT doc_id, count(DISTINCT i + o) AS c FROM (SELECT doc_id, i, unnest(range(n)) AS o FROM hit) q GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS c, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) q GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(places.c, 0) AS n_hit, coalesce(items.c, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(places.c, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP8 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
r3 AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2) q),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS c FROM (SELECT doc_id, i, unnest(range(3)) AS o FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM r3) q WHERE n > 1) s GROUP BY doc_id),
ln AS (SELECT doc_id, source, md5(text) AS t, line, regexp_extract_all(translate(line, '{UPPER}', '{LOWER}'), '{SPACED}') AS lw FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d) q),
lines AS (SELECT *, array_to_string(lw, ' ') AS norm FROM ln WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS c FROM lines GROUP BY doc_id),
freq AS (SELECT source, norm, min(doc_id) AS first_doc FROM lines GROUP BY source, norm HAVING count(DISTINCT t) > {quality.MIN_DOCS}),
gone AS (SELECT doc_id, CAST(sum(len(lw)) AS BIGINT) AS c FROM lines l JOIN freq f ON f.source IS NOT DISTINCT FROM l.source AND f.norm = l.norm WHERE doc_id <> first_doc GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.c, 0) AS n_dup_lines, coalesce(rep.c, 0) AS n_repeat_words, coalesce(gone.c, 0) AS n_removed_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= {quality.KEEP_SHARE} * n_words AS kept FROM m
"""


def _seeded(*parts: str) -> str:
    return f"CAST('0x' || substr(md5('{mixing.SEED}'" + "".join(f" || '|' || coalesce(CAST({p} AS VARCHAR), 'null')" for p in parts) + "), 1, 15) AS BIGINT)"


OP9 = rf"""
WITH z AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{SPACED}')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM z GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, source_size * {mixing.LIMIT}::DOUBLE AS cap, sum(source_size) OVER () * {mixing.SHARE}::DOUBLE AS total FROM s0),
s2 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
s3 AS (SELECT *, (SELECT level FROM s2 WHERE cap / weight > level ORDER BY cap / weight, source NULLS LAST LIMIT 1) AS cut FROM s2),
src AS (SELECT source, source_size, n_docs, CASE WHEN cap / weight > level THEN weight * cut ELSE cap END AS target, CAST(ceil(n_docs / {mixing.SHARD_DOCS}) AS BIGINT) AS shards FROM s3),
b AS (SELECT greatest(1, least({mixing.MAX_BLOCK}, CAST(floor(min(target) / 1000) AS BIGINT))) AS block, sum(target) AS total FROM src WHERE target > 0),
n AS (SELECT block, CAST(floor(total / block + 0.5) AS BIGINT) AS seats FROM b),
quota AS (SELECT source, count(*) FILTER (WHERE rn <= seats) AS quota FROM (SELECT source, seats, row_number() OVER (ORDER BY target / (2 * a + 1) DESC, source NULLS LAST, a) AS rn FROM (SELECT source, target, seats, unnest(range(CAST(ceil(target / block) AS BIGINT) + 3)) AS a FROM src, n WHERE target > 0) q) r GROUP BY source),
p AS (SELECT z.*, source_size, target, {_seeded("doc_id")} AS draw, {_seeded("'shard'", "doc_id")} % shards AS shard FROM z JOIN src ON src.source IS NOT DISTINCT FROM z.source),
ps AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS shard_size FROM p GROUP BY 1, 2),
pq AS (SELECT ps.*, coalesce(quota, 0) AS quota FROM ps LEFT JOIN quota ON quota.source IS NOT DISTINCT FROM ps.source),
won AS (SELECT source, shard, count(*) FILTER (WHERE rn <= quota) AS blocks FROM (SELECT source, shard, quota, row_number() OVER (PARTITION BY source ORDER BY shard_size / (2 * a + 1) DESC, shard, a) AS rn FROM (SELECT *, unnest(range(quota + 1)) AS a FROM pq WHERE shard_size > 0) q) r GROUP BY 1, 2),
l AS (SELECT p.*, shard_size, CAST(ceil(shard_size / block) AS BIGINT) AS cells, block, sum(size) OVER (PARTITION BY p.source, p.shard ORDER BY draw, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS stop FROM p JOIN ps ON ps.source IS NOT DISTINCT FROM p.source AND ps.shard = p.shard, n),
k AS (SELECT l.*, stop - size AS start, least(coalesce(blocks, 0), 2 * cells) AS blocks, {_seeded("'arc'", "l.source", "l.shard")} % greatest(cells, 1) AS first FROM l LEFT JOIN won ON won.source IS NOT DISTINCT FROM l.source AND won.shard = l.shard),
g AS (SELECT *, CASE WHEN blocks >= cells THEN blocks - cells ELSE blocks END AS arc FROM k)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE CASE WHEN blocks >= cells THEN size ELSE 0 END + greatest(least(stop, least(first + arc, cells) * block) - greatest(start, first * block), 0) + greatest(least(stop, greatest(first + arc - cells, 0) * block) - greatest(start, 0), 0) END AS BIGINT) AS taken FROM g
"""

_FINITE = "len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0"

OP11 = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND {_FINITE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""

OP12 = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND {_FINITE}),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.x, c.x) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) <= 10
"""


def _leaf(text: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v}) || ':' || {v} END" for v in values) + ")"


_BITS = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))"
_CRC = f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)), lambda c, b: {_BITS}), 4294967295)"
_FOLD = "sha256(array_to_string(hs[1:(f.i - f.i // 8 * 8)] || [f.h] || hs[(f.i - f.i // 8 * 8) + 2:], ''))"

OP13 = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf("text")} AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS seen FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
up AS (SELECT lang, 0 AS level, i, leaf AS h, n FROM l UNION ALL SELECT lang, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM up WHERE n > 1 GROUP BY lang, level, i // 8, n),
subs AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS t, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS level, t AS i, subroot AS h, n FROM subs UNION ALL SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM top WHERE n > 1 GROUP BY level, i // 8, n),
runs AS (SELECT t, level, i // 8 AS run, list(h ORDER BY i) AS hs FROM up JOIN subs ON subs.lang IS NOT DISTINCT FROM up.lang WHERE up.n > 1 GROUP BY ALL),
tops AS (SELECT level, i // 8 AS run, list(h ORDER BY i) AS hs FROM top WHERE n > 1 GROUP BY ALL),
a AS (SELECT l.*, t, subroot, row_number() OVER () AS k FROM l JOIN subs ON subs.lang IS NOT DISTINCT FROM l.lang),
f AS (SELECT k, t, 0 AS level, i, coalesce(seen, leaf) AS h, '' AS p FROM a
  UNION ALL SELECT f.k, f.t, f.level + 1, f.i // 8, {_FOLD}, f.p || array_to_string(hs[1:(f.i - f.i // 8 * 8)] || hs[(f.i - f.i // 8 * 8) + 2:], '') FROM f JOIN runs r ON r.t = f.t AND r.level = f.level AND r.run = f.i // 8),
g AS (SELECT k, 0 AS level, t AS i, h, p FROM (SELECT *, max(level) OVER (PARTITION BY k) AS last FROM f) q WHERE level = last
  UNION ALL SELECT f.k, f.level + 1, f.i // 8, {_FOLD}, f.p || array_to_string(hs[1:(f.i - f.i // 8 * 8)] || hs[(f.i - f.i // 8 * 8) + 2:], '') FROM g f JOIN tops r ON r.level = f.level AND r.run = f.i // 8),
e AS (SELECT k, h, p FROM (SELECT *, max(level) OVER (PARTITION BY k) AS last FROM g) q WHERE level = last)
SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(p) AS proof_sha256, h AS folded_root, h = (SELECT h FROM top WHERE n = 1) AS verified FROM a JOIN e USING (k)
"""
