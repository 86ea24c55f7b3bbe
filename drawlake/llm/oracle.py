"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_WORDS2 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = rf"""
WITH item AS (SELECT item_id, {_WORDS2} AS w FROM benchmark),
phrase AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS p, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)
),
doc AS (SELECT doc_id, {_WORDS2} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM phrase),
part AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n)
),
found AS (SELECT doc_id, i, part.n, item_id FROM part JOIN phrase USING (p, n)),
hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id
),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

OP3 = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
split AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
),
rules(verdict, h, p) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')
),
fit AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN fit USING (page_id)
"""

OP4 = r"""
WITH doc AS (SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents),
win AS (
  SELECT doc_id, i, lines[i:i + 2] AS w
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM doc WHERE len(lines) >= 3)
),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
gone AS (SELECT doc_id, list(DISTINCT place) AS place FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM later) GROUP BY doc_id)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(len(place), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(
    CASE WHEN place IS NULL THEN lines ELSE list_filter(lines, lambda x, k: NOT list_contains(place, k)) END, chr(10)), '')) AS kept_sha256
FROM doc LEFT JOIN gone USING (doc_id)
"""

OP6 = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM doc WHERE len(w) >= 20)
),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
gone AS (SELECT doc_id, place FROM (SELECT doc_id, unnest(range(i, i + 20)) AS place FROM later) GROUP BY doc_id, place),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS place FROM doc),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY place) AS t FROM word ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id
),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""

OP7 = r"""
WITH conv AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, 'unknown'), text := coalesce(text, ''))
    ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
same AS (SELECT t, min(conv_id) AS conv_id, count(*) AS copies FROM conv GROUP BY t),
prefix AS (SELECT DISTINCT t[1:n] AS t FROM (SELECT t, unnest(range(1, len(t))) AS n FROM conv))
SELECT conv_id, CAST(len(t) AS BIGINT) AS n_turns, copies,
  array_to_string(list_transform(t, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), '') AS chat
FROM same ANTI JOIN prefix USING (t)
"""

OP8 = r"""
WITH doc AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM doc WINDOW g AS (PARTITION BY text_sha256)
"""

OP11 = r"""
WITH doc AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
),
src AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM doc GROUP BY source)
),
-- Sources in the order in which a rising level fills them; the level after the first k are full.
filling AS (
  SELECT *, (3 * source_size) / CAST(weight AS DOUBLE) AS full_at,
    coalesce(sum(3 * source_size) OVER before, 0) AS given, coalesce(sum(weight) OVER before, 0) AS used,
    sum(source_size) OVER () AS words, sum(weight) OVER () AS all_weights
  FROM src
  WINDOW before AS (ORDER BY (3 * source_size) / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
level AS (
  SELECT min_by(level, used) AS level
  FROM (SELECT CAST(words - given AS DOUBLE) / CAST(all_weights - used AS DOUBLE) AS level, used, full_at FROM filling)
  WHERE level < full_at
),
target AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), coalesce(level, 0) * weight) AS target FROM src, level
),
plan AS (
  SELECT *, CAST('0x' || substr(md5('mix:' || coalesce('s' || source, 'n')), 1, 7) AS HUGEINT) * 4 AS shift,
    CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * 1073741824) AS HUGEINT) ELSE 0 END AS rate
  FROM target
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS LAST) AS number FROM doc
)
SELECT doc_id, ranked.source, size, source_size, target,
  CASE WHEN size > 0 THEN copies ELSE 0 END AS copies, size * copies AS taken
FROM (
  SELECT ranked.*, source_size, target,
    CAST((shift + rate * number) // 1073741824 - (shift + rate * (number - 1)) // 1073741824 AS BIGINT) AS copies
  FROM ranked JOIN plan ON ranked.source IS NOT DISTINCT FROM plan.source
) AS ranked
"""

OP12 = r"""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
met AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row, b.vec_id, a.label = b.label AS same,
    CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.vec_id % 50 = 0 AND a.row <> b.row
),
positive AS (
  SELECT anchor, anchor_id, row AS positive, vec_id AS positive_id, score AS positive_score FROM met WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) <= 5
)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor, positive ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positive AS p JOIN met AS n ON p.anchor = n.anchor AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

ORACLE = {
    "op2_decontamination": OP2,
    "op3_url_filter": OP3,
    "op4_line_dedup": OP4,
    "op6_substring_dedup": OP6,
    "op7_chat_format": OP7,
    "op8_exact_dedup": OP8,
    "op11_mix": OP11,
    "op12_hard_negatives": OP12,
}
