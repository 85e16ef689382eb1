"""The same results in SQL, for the queries that SQL can express."""

from __future__ import annotations

from tallyspring.llm.quality import MARKS, STOP_WORDS, THRESHOLDS

MIXING = r"""
WITH slim AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(md5(text), '')), 1, 15))::BIGINT AS h FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_rows FROM slim GROUP BY source),
ranked AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM by_source),
levels AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
free AS (SELECT arg_min(level, cap / weight) AS free FROM levels WHERE cap > level * weight),
stats AS (SELECT source AS s2, source_size, CASE WHEN free IS NULL THEN cap ELSE least(cap, free * weight) END AS target, least(65536, ceil(n_rows / 2000.0))::BIGINT AS buckets FROM levels, free),
dues AS (SELECT *, floor(target + 0.5)::BIGINT AS due FROM stats),
totals AS (SELECT sum(due)::BIGINT AS budget FROM dues),
queued AS (SELECT *, h % buckets AS bucket FROM slim JOIN dues ON source IS NOT DISTINCT FROM s2),
placed AS (SELECT *, row_number() OVER (PARTITION BY source, bucket ORDER BY h, doc_id NULLS FIRST, size) AS n,
  (sum(size) OVER (PARTITION BY source ORDER BY bucket, h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start FROM queued),
copies AS (SELECT source, bucket, n, k AS round, o AS piece, least(128, size - o)::BIGINT AS part, k * source_size + start + o AS begin_, target FROM placed, (VALUES (0), (1)) v(k), unnest(range(0, size, 128)) u(o)),
live AS (SELECT *, (begin_ + part)::DOUBLE / target AS finish FROM copies WHERE target > 0),
ordered AS (SELECT *, (sum(part) OVER (ORDER BY finish, source NULLS FIRST, bucket, n, round, piece ROWS UNBOUNDED PRECEDING) - part)::BIGINT AS pos FROM live),
cut AS (SELECT *, least(part, budget - pos) AS got FROM ordered, totals),
mixed AS (SELECT source AS s3, bucket AS b3, n AS n3, sum(got)::BIGINT AS taken, min(pos) FILTER (round = 0) AS first_at, min(pos) FILTER (round > 0) AS again_at FROM cut WHERE got > 0 GROUP BY ALL)
SELECT doc_id, source, size, source_size, target, coalesce(taken, 0) AS taken, first_at, again_at
FROM placed LEFT JOIN mixed ON source IS NOT DISTINCT FROM s3 AND bucket = b3 AND n = n3
"""

VECTORS = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
edges AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
walk(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT w.a, e.b FROM walk w JOIN edges e ON w.b = e.a)
SELECT vec_id, (SELECT count(*) FROM edges WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT a AS vec_id, min(b) AS component_id FROM walk GROUP BY a)
"""

CHAT = r"""
WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
parts AS (SELECT *, replace(replace(text, '\', '\b'), '<', '\l') AS t, replace(replace(replace(role, '\', '\b'), '<', '\l'), chr(10), '\n') AS r FROM rows_),
placed AS (SELECT *, (lag(r) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t)) IS DISTINCT FROM r AS opens FROM parts)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(t) + CASE WHEN opens THEN length(r) + 15 ELSE 6 END)::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id
"""


def _holds(rule) -> str:
    part, whole = f"{rule.part} * {rule.factor}", rule.whole
    tests = ([f"{part} >= {whole} * {rule.least}"] if rule.least is not None else []) + ([f"{part} <= {whole} * {rule.most}"] if rule.most is not None else [])
    return f"(({' AND '.join(tests)}) OR n_words < {rule.from_words})"


QUALITY = rf"""
WITH d AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], chr(1)) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM again) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}')))::BIGINT AS n_letter_words,
  len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]')))::BIGINT AS n_latin_words,
  len(list_filter(w, lambda x: list_contains({STOP_WORDS!r}, trim(lower(x), '{MARKS}'))))::BIGINT AS n_stop_words, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')))::BIGINT AS n_ellipsis_lines,
  len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]')))::BIGINT AS n_bullet_lines
  FROM d LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {' AND '.join(map(_holds, THRESHOLDS))} AS kept FROM b
"""

AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, doc_id > min(doc_id) OVER (PARTITION BY t) AS again FROM d),
l AS (SELECT doc_id AS id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b, 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
  coalesce(again, false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l ON id = doc_id),
fails AS (SELECT *, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS failed FROM f),
groups AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, failed),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS x, filter_order[1:step - 1] AS earlier FROM orders, (SELECT unnest(range(1, 6))::INT AS step)),
judged AS (SELECT part, filter_order, step, failed, n, good, toxic, x, contains(failed, x) AS hit, len(list_intersect(string_split(failed, ''), string_split(earlier, ''))) > 0 AND failed <> '' AND earlier <> '' AS gone FROM groups, steps),
told AS (SELECT part, filter_order, step, any_value(x) AS x, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failed = x), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost FROM judged GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM told
"""

NEGATIVES = """
WITH ok AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM ok a JOIN ok b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank
  FROM p JOIN pairs USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

ORACLES = {"op11_hard_negatives": NEGATIVES, "op12_filter_audit": AUDIT, "op5_mixing": MIXING, "op6_vector_dedup": VECTORS, "op8_chat_formatting": CHAT, "op10_quality_rules": QUALITY}
