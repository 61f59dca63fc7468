"""SQL that checks queries of this subpackage."""

#: Word counts, hashed features, gains, noise and ranks of the resampled documents; CRC-32 from its polynomial.
RESAMPLED = r"""
WITH steps AS (
    SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
        ORDER BY i) AS step
    FROM (SELECT unnest(range(256)) AS i) b
), words AS (
    SELECT 0 AS kind, row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
    UNION ALL
    SELECT 1, 0, NULL, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), sums AS (
    SELECT word, xor(list_reduce(
        list_concat([4294967295], [CAST('0x' || substr(h, 2 * k - 1, 2) AS BIGINT) FOR k IN range(1, len(h) // 2 + 1)]),
        lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM words) x) y, steps
), counted AS (
    SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM words JOIN sums USING (word) GROUP BY bucket
), gains AS (
    SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + 10000) / ((s + 1.0::DOUBLE) * (sum(t) OVER () + 10000)))) AS BIGINT)
        AS gain FROM counted
), weights AS (
    SELECT r, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
    FROM words JOIN sums USING (word) JOIN gains USING (bucket) WHERE kind = 0 GROUP BY r
), scores AS (
    SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h
    FROM (SELECT row_number() OVER () AS r, doc_id FROM documents) d LEFT JOIN weights USING (r)
), noisy AS (
    SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scores
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS turn,
        count(*) OVER (PARTITION BY n_features >= 20) AS n FROM noisy
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND turn <= 10 * n // 100 THEN turn END AS rank FROM ranked
"""

#: Every filter at every place of every order, from counts per part and verdict.
AUDITED = r"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
    FROM documents
), marked AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT)
        + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) AS INT)
        + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(doc_id > first AS INT) AS failed
    FROM d LEFT JOIN (
        SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id
    ) l USING (doc_id)
), counts AS (
    SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM marked GROUP BY part, failed
), f(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
    SELECT [a, b, c, d, e] AS o FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
        AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), steps AS (
    SELECT list_reduce([x.name FOR x IN o], lambda x, y: x || y) AS filter_order, k AS step, o[k].bit AS own,
        CAST(coalesce(list_sum([x.bit FOR x IN o[1:k - 1]]), 0) AS INT) AS before
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS k) s
)
SELECT part, filter_order, step,
    CAST(sum(CASE WHEN failed & (own | before) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN failed & own > 0 AND failed & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN failed & own > 0 AND failed & before > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN failed = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN failed & own > 0 AND failed & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN failed & own > 0 AND failed & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
    CAST(sum(CASE WHEN failed & own > 0 THEN n * (120 // bit_count(failed)) ELSE 0 END) AS BIGINT) AS shapley
FROM counts, steps GROUP BY part, filter_order, step
"""
