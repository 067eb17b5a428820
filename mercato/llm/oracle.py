"""DuckDB statements that recompute operators over the same tables."""

from __future__ import annotations

from mercato.llm.license_scan import COVERAGE, NEIGHBOUR, PHRASES, STATEMENTS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP2 = rf"""
WITH RECURSIVE cut AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                              '[^\x20\x09-\x0D]+') AS w
    FROM documents),
sets AS (
    SELECT r, doc_id, list_sort(list_distinct(
        CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
             WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
        END)) AS s
    FROM cut),
alike AS (SELECT s, min(r) AS node, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
grams AS (SELECT node, n, unnest(s) AS g FROM alike),
shared AS (
    SELECT a.node AS a, b.node AS b, a.n AS na, b.n AS nb, count(*) AS k
    FROM grams a JOIN grams b ON a.g = b.g AND a.node < b.node
    WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    GROUP BY ALL),
links AS (
    SELECT a, b FROM shared WHERE 100 * k >= 90 * (na + nb - k)
    UNION ALL SELECT b, a FROM shared WHERE 100 * k >= 90 * (na + nb - k)),
reach AS (
    SELECT node, node AS other FROM alike
    UNION SELECT links.b, reach.other FROM reach JOIN links ON links.a = reach.node),
rows_of AS (SELECT alike.node, sets.doc_id FROM alike JOIN sets ON sets.s = alike.s),
smallest AS (
    SELECT reach.node, min(rows_of.doc_id) AS component_id
    FROM reach JOIN rows_of ON rows_of.node = reach.other GROUP BY reach.node)
SELECT sets.doc_id, len(sets.s) AS n_shingles,
       coalesce(smallest.component_id, sets.doc_id) AS component_id
FROM sets LEFT JOIN alike ON alike.s = sets.s LEFT JOIN smallest ON smallest.node = alike.node
"""

OP5 = """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM usable q JOIN usable c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
    WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank,
       vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

OP6 = """
WITH RECURSIVE usable AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_dot_product(a.v, b.v)
          / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.93),
reach AS (
    SELECT vec_id, vec_id AS other FROM embeddings
    UNION SELECT links.b, reach.other FROM reach JOIN links ON links.a = reach.vec_id),
smallest AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
degree AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT smallest.vec_id, coalesce(n_links, 0) AS n_links, component_id,
       smallest.vec_id = component_id AS kept
FROM smallest LEFT JOIN degree USING (vec_id)
"""

OP8 = rf"""
WITH word_lists AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
templates(label, body, phrase) AS (VALUES
    {", ".join(f"({_quoted(label)}, {_quoted(text)}, {phrase})"
               for given, phrase in ((PHRASES, "true"), (STATEMENTS, "false"))
               for label, text in given)}),
template_words AS (
    SELECT row_number() OVER () AS t, label, phrase,
           regexp_extract_all(lower(body), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS tw
    FROM templates),
places AS (
    SELECT r, t, label, i - 1 AS start
    FROM (SELECT r, w, t, label, tw, unnest(list_filter(range(1, len(w) - len(tw) + 2),
                                                        lambda i: w[i : i + len(tw) - 1] = tw)) AS i
          FROM word_lists JOIN template_words ON phrase AND list_has_all(w, tw))),
text_pairs AS (
    SELECT r, i, w[i] AS a, w[i + 1] AS b
    FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM word_lists)),
pattern_pairs AS (
    SELECT t, label, len(tw) - 1 AS pairs, i, tw[i] AS a, tw[i + 1] AS b
    FROM (SELECT *, unnest(range(1, len(tw))) AS i FROM template_words WHERE NOT phrase)),
votes AS (
    SELECT DISTINCT r, t, label, pairs, p.i AS spot, x.i - p.i AS diagonal
    FROM text_pairs x JOIN pattern_pairs p ON x.a = p.a AND x.b = p.b),
diagonals AS (SELECT DISTINCT r, t, diagonal FROM votes),
steps AS (
    SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY r, t ORDER BY diagonal) AS gap FROM diagonals),
spans AS (
    SELECT *, sum(CASE WHEN gap IS NULL OR gap > {NEIGHBOUR} THEN 1 ELSE 0 END)
              OVER (PARTITION BY r, t ORDER BY diagonal) AS span FROM steps),
shares AS (
    SELECT votes.r, votes.t, label, span, count(DISTINCT spot) / max(pairs)::DOUBLE AS share
    FROM votes JOIN spans USING (r, t, diagonal) GROUP BY votes.r, votes.t, label, span),
per_text AS (
    SELECT word_lists.r, doc_id, len(w) AS n_words,
           (SELECT count(*) FROM places p WHERE p.r = word_lists.r) AS n_base
    FROM word_lists),
base AS (
    SELECT r, min(start) AS first_word, max(start) AS last_word,
           string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY r),
every_label AS (
    SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
    FROM (SELECT r, label FROM places UNION SELECT r, label FROM shares WHERE share >= {COVERAGE})
    GROUP BY r),
best AS (SELECT r, max(share) AS share FROM shares GROUP BY r)
SELECT doc_id, n_words, n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best.share, 0.0::DOUBLE) END AS score
FROM per_text LEFT JOIN base USING (r) LEFT JOIN every_label USING (r) LEFT JOIN best USING (r)
"""

OP11 = rf"""
WITH cut AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents),
scale AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS all_terms
          FROM cut WHERE len(w) > 0),
item_terms AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE item_id IS NOT NULL),
counts AS (
    SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM cut)
    WHERE term IN (SELECT term FROM item_terms) GROUP BY ALL),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS weight
    FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), scale),
lengths AS (SELECT r, doc_id, 10 + ((90 * len(w) * n_docs) // all_terms) AS m FROM cut, scale
            WHERE doc_id IS NOT NULL),
scored AS (
    SELECT item_id, r, doc_id,
           CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
    FROM item_terms JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (r)
    GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank,
       doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

OP12 = """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
           CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE a.vec_id % 50 = 0),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""

ORACLE = {
    "op2_ngram_join": OP2,
    "op5_topk_search": OP5,
    "op6_embedding_dedup": OP6,
    "op8_license_scan": OP8,
    "op11_ranked_search": OP11,
    "op12_hard_negatives": OP12,
}
