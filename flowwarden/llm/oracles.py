"""The same queries as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op2_minhash"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE
        WHEN w IS NULL OR len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s
    FROM words
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
    SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
    WHERE 100 * shared.n >= 75 * (p.n + q.n - shared.n)
), both_ways AS (
    SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
    SELECT doc_id AS x, doc_id AS y FROM documents
    UNION
    SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.y
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, min(r.y)::BIGINT AS component_id, d.doc_id = min(r.y) AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN reach r ON r.x = d.doc_id
GROUP BY d.doc_id, s.n
"""

ORACLES["op1_warc"] = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages
), s AS (
    SELECT payload, max(page_id) AS response FROM p WHERE payload_bytes >= 1000 GROUP BY payload
)
SELECT page_id, payload_bytes, sha1(p.payload) AS payload_digest,
    CASE WHEN response IS NULL OR response = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN response <> page_id THEN response END AS refers_to
FROM p LEFT JOIN s ON s.payload = p.payload
"""

ORACLES["op8_vectors"] = """
WITH RECURSIVE good AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b
        ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
    SELECT vec_id AS x, vec_id AS y FROM embeddings
    UNION
    SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
), counts AS (
    SELECT x, count(*) AS n FROM links GROUP BY x
)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, min(r.y)::BIGINT AS component_id, e.vec_id = min(r.y) AS kept
FROM embeddings e LEFT JOIN counts c ON c.x = e.vec_id JOIN reach r ON r.x = e.vec_id
GROUP BY e.vec_id, c.n
"""

ORACLES["op12_hard_negatives"] = """
WITH good AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
    FROM good a JOIN good b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

ORACLES["op13_quality"] = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents
), w AS (
    SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM d
), windows AS (
    SELECT r, unnest(range(1, len(words) - 1)) AS i, unnest([array_to_string(words[i:i + 2], ' ') FOR i IN range(1, len(words) - 1)]) AS s
    FROM w WHERE len(words) >= 3
), twice AS (
    SELECT r, s FROM windows GROUP BY r, s HAVING count(*) > 1
), places AS (
    SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS i FROM windows JOIN twice USING (r, s)
), repeats AS (
    SELECT r, count(*) AS n FROM places GROUP BY r
), counts AS (
    SELECT r, doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN repeats USING (r)
), judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
), measures AS (
    SELECT r, lang, source, base_failed, unnest([
        {'m': 1, 'v': word_chars * 1000 // greatest(n_words, 1)}, {'m': 2, 'v': n_symbols * 1000 // greatest(n_words, 1)},
        {'m': 3, 'v': n_dup_lines * 1000 // greatest(n_lines, 1)}, {'m': 4, 'v': n_repeat_words * 1000 // greatest(n_words, 1)}], recursive := true)
    FROM judged
), cells AS (
    SELECT *, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS cell FROM measures WHERE NOT base_failed
), groups AS (
    SELECT 1 AS level, lang, source, m, cell, count(*) AS n FROM cells GROUP BY ALL
    UNION ALL SELECT 2, lang, NULL, m, cell, count(*) FROM cells GROUP BY ALL
    UNION ALL SELECT 3, NULL, NULL, m, cell, count(*) FROM cells GROUP BY ALL
), running AS (
    SELECT *, sum(n) OVER (PARTITION BY level, lang, source, m ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY level, lang, source, m) AS docs
    FROM groups
), quartiles AS (
    SELECT level, lang, source, m, max(docs) AS docs, min(cell) FILTER (4 * upto >= docs) AS q1, min(cell) FILTER (4 * upto >= 3 * docs) AS q3
    FROM running GROUP BY level, lang, source, m
), fences AS (
    SELECT *, q3 + greatest(3 * (q3 - q1), CASE m WHEN 1 THEN 2000 WHEN 2 THEN 100 WHEN 3 THEN 500 ELSE 300 END) AS high,
        CASE WHEN m = 1 THEN q1 - greatest(3 * (q3 - q1), 2000) ELSE 0 END AS low
    FROM quartiles
), verdicts AS (
    SELECT x.r, bool_and(CASE WHEN a.docs >= 100 THEN v BETWEEN a.low AND a.high WHEN b.docs >= 100 THEN v BETWEEN b.low AND b.high
        ELSE v BETWEEN c.low AND c.high END) AS inside
    FROM measures x JOIN fences a ON a.level = 1 AND a.m = x.m AND a.lang IS NOT DISTINCT FROM x.lang AND a.source IS NOT DISTINCT FROM x.source
    JOIN fences b ON b.level = 2 AND b.m = x.m AND b.lang IS NOT DISTINCT FROM x.lang JOIN fences c ON c.level = 3 AND c.m = x.m
    GROUP BY x.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(inside, false) AS kept
FROM judged LEFT JOIN verdicts USING (r)
"""

ORACLES["op11_treap_search"] = r"""
WITH docs AS (
    SELECT doc_id, row_number() OVER () AS r,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), items AS (
    SELECT DISTINCT item_id, text, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
    FROM benchmark
), corpus AS (
    SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM docs WHERE len(terms) > 0
), postings AS (
    SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM docs) GROUP BY ALL
), weights AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, corpus GROUP BY term, n_docs
), scores AS (
    SELECT i.item_id, i.text, p.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM items i JOIN weights USING (term) JOIN postings p USING (term), corpus GROUP BY i.item_id, i.text, p.doc_id, p.r
)
SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""
