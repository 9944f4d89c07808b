"""DuckDB SQL for the text queries that SQL can express at test size.

The others are held against brute-force versions in tests/llm: learned models
(op1, op2, op3, op5), keyed permutations (op7), packings of which many are right
(op6), byte strings (op9) and merges (op10).
"""

from __future__ import annotations

#: Smallest id that each node of links(a, b) reaches.
_REACH = """
reach(id, r) AS (
    SELECT DISTINCT a, a FROM links
    UNION
    SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a
),
least AS (SELECT id, min(r) AS r FROM reach GROUP BY id)"""

#: crc32 of a decimal id, bit by bit.
_CRC = """xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT],
        flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_concat([-ascii(c)::BIGINT], repeat([-1000::BIGINT], 8))))),
        lambda h, x: CASE WHEN x > -1000 THEN xor(h, -x) WHEN h % 2 = 1 THEN xor(h // 2, 3988292384::BIGINT) ELSE h // 2 END))"""

ORACLE: dict[str, str] = {
    "op4_set_join": f"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w
    FROM documents
),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
    FROM words
),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
shared AS (
    SELECT p.doc_id AS a, q.doc_id AS b, any_value(p.n) AS na, any_value(q.n) AS nb, count(*) AS k
    FROM each p JOIN each q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY 1, 2
),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 85 * (na + nb - k)),
{_REACH}
SELECT doc_id, len(s) AS n_shingles, coalesce(r, doc_id) AS component_id, coalesce(r, doc_id) = doc_id AS kept
FROM sets LEFT JOIN least ON id = doc_id""",
    "op8_vector_join": f"""
WITH RECURSIVE vectors AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
    SELECT p.vec_id AS a, q.vec_id AS b FROM vectors p
    JOIN vectors q ON p.label = q.label AND len(p.e) = len(q.e) AND p.vec_id <> q.vec_id
    WHERE list_cosine_similarity(p.e, q.e) >= 0.93
),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
{_REACH}
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(r, vec_id) AS component_id, coalesce(r, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN least ON id = vec_id LEFT JOIN counts ON a = vec_id""",
    "op11_periodic_runs": f"""
WITH split AS (
    SELECT doc_id, {_CRC} AS h, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w
    FROM documents
),
cut AS (SELECT *, CASE WHEN len(w) > 0 THEN h // 10 % len(w) END AS a FROM split),
texts AS (
    SELECT doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN list_transform(range(len(w)),
        lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(w) - a) // (3 + h // 10 % 8)) END]) ELSE w END AS w
    FROM cut
),
words AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS i FROM texts),
pairs AS (
    SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y
    ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
),
marked AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS n FROM marked GROUP BY doc_id, q, island),
runs AS (
    SELECT doc_id, s AS start, n AS length, min(q) AS period FROM stretches WHERE n >= greatest(6, 4 * q) GROUP BY doc_id, s, n
),
found AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines,
        first(struct_pack(start, length, period) ORDER BY length DESC, start, period) AS best
    FROM runs GROUP BY doc_id
),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
left_over AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
    1000 * best.length // best.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
    sha256(coalesce(t.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id LEFT JOIN left_over t ON d.doc_id = t.doc_id""",
    "op12_hard_negatives": """
WITH vectors AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.vec_id AS anchor_id, x.vec_id AS id, x.label = a.label AS equal, list_inner_product(a.e, x.e)::BIGINT AS score
    FROM vectors a JOIN vectors x ON a.vec_id <> x.vec_id AND len(a.e) = len(x.e) WHERE a.vec_id % 100 = 0
),
positives AS (
    SELECT * FROM scored WHERE equal
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
    n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.equal
    AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5""",
    "op13_warc": """
WITH payloads AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
digests AS (SELECT page_id, payload, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS original FROM payloads),
bits AS (
    SELECT *, list_transform(range(4), lambda k: ('0x' || substr(hex, 1 + 10 * k, 10))::BIGINT) AS parts FROM digests
)
SELECT page_id, octet_length(payload) AS payload_bytes,
    list_aggregate(flatten(list_transform(parts, lambda x: list_transform(range(8), lambda k:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((x >> (35 - 5 * k)) % 32)::INTEGER, 1)))), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> original THEN original END AS refers_to
FROM bits""",
}
