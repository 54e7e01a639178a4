"""DuckDB SQL of the queries that SQL can express."""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

# Every document word sequence of a window's length is compared with every window, by its text.
_DECONTAMINATION = f"""
    WITH docs AS MATERIALIZED (
        SELECT row_number() OVER () AS doc, doc_id, {_WORDS} AS words FROM documents
    ), items AS (
        SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS words FROM benchmark
    ), sized AS (
        SELECT item_id, words, least(len(words), 10) AS size FROM items WHERE len(words) > 0
    ), starts AS (
        SELECT item_id, words, size, unnest(range(1, len(words) - size + 2)) AS start FROM sized
    ), windows AS MATERIALIZED (
        SELECT DISTINCT item_id, size, array_to_string(words[start:start + size - 1], ' ') AS passage FROM starts
    ), sizes AS (
        SELECT DISTINCT size FROM windows
    ), places AS (
        SELECT doc, words, size, unnest(range(1, len(words) - size + 2)) AS start FROM docs, sizes WHERE len(words) >= size
    ), hits AS MATERIALIZED (
        SELECT doc, start, p.size AS size, item_id
        FROM places p JOIN windows w ON w.size = p.size AND w.passage = array_to_string(p.words[start:start + p.size - 1], ' ')
    ), words_hit AS (
        SELECT doc, count(DISTINCT word) AS n_hit
        FROM (SELECT doc, unnest(range(start, start + size)) AS word FROM hits) GROUP BY doc
    ), items_hit AS (
        SELECT doc, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT doc, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY doc
    )
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN words_hit USING (doc) LEFT JOIN items_hit USING (doc)
"""


def _clustering(rounds: int = 10, clusters: int = 8, size: int = 64) -> str:
    """One step for each round: assignment to the nearest centroid, then floors of the means."""

    def assigned(centroids: str) -> str:
        return f"""
            SELECT row, min(struct_pack(distance := distance, cluster := cluster)) AS nearest
            FROM (
                SELECT row, cluster,
                       CAST(list_sum(list_transform(range(1, {size + 1}), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT) AS distance
                FROM vectors, {centroids}
            ) GROUP BY row"""

    steps = [
        f"""vectors AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id,
                   list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings
            WHERE len(embedding) = {size}
              AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {size}
        )""",
        f"""centroids0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS cluster, x AS c
            FROM vectors ORDER BY sha256('3:' || vec_id), x LIMIT {clusters}
        )""",
    ]
    for number in range(rounds):
        steps.append(f"assigned{number} AS MATERIALIZED ({assigned(f'centroids{number}')})")
        steps.append(
            f"""sums{number} AS (
                SELECT nearest.cluster AS cluster, i, CAST(sum(x[i]) AS BIGINT) AS total, count(*) AS n
                FROM assigned{number} JOIN vectors USING (row), range(1, {size + 1}) AS axes(i) GROUP BY ALL
            ), moved{number} AS (
                SELECT cluster, list((total - ((total % n) + n) % n) // n ORDER BY i) AS c FROM sums{number} GROUP BY cluster
            ), centroids{number + 1} AS MATERIALIZED (
                SELECT cluster, coalesce(m.c, o.c) AS c FROM centroids{number} o LEFT JOIN moved{number} m USING (cluster)
            )"""
        )
    steps.append(f"last AS MATERIALIZED ({assigned(f'centroids{rounds}')})")
    return f"""
        WITH {", ".join(steps)}
        SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, nearest.distance AS distance,
               CAST(sum(nearest.distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(nearest.distance) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM last JOIN vectors USING (row) JOIN centroids{rounds} ON cluster = nearest.cluster
    """


# All pairs that share a shingle, then what can be reached over links.
_NEAR_TEXTS = f"""
    WITH RECURSIVE words AS MATERIALIZED (
        SELECT doc_id, regexp_extract_all({_FOLD}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
    ), sets AS MATERIALIZED (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN w
            ELSE list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) END AS shingles
        FROM words
    ), spread AS MATERIALIZED (
        SELECT doc_id, len(shingles) AS size, unnest(shingles) AS shingle FROM sets
    ), links AS MATERIALIZED (
        SELECT a.doc_id AS a, b.doc_id AS b
        FROM spread a JOIN spread b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            AND 100 * least(a.size, b.size) >= 80 * greatest(a.size, b.size)
        GROUP BY a.doc_id, b.doc_id, a.size, b.size
        HAVING 100 * count(*) >= 80 * (a.size + b.size - count(*))
    ), reached AS (
        SELECT doc_id AS a, doc_id AS b FROM sets
        UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
    ), components AS (
        SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a
    )
    SELECT doc_id, len(shingles) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM sets JOIN components USING (doc_id)
"""

_NEAR_VECTORS = """
    WITH RECURSIVE usable AS MATERIALIZED (
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)
          AND len(list_filter(embedding, lambda c: c <> 0)) > 0
    ), links AS MATERIALIZED (
        SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
        WHERE list_cosine_similarity(a.v, b.v) >= 0.9
    ), reached AS (
        SELECT vec_id AS a, vec_id AS b FROM embeddings
        UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
    ), components AS (
        SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a
    )
    SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
    FROM components
"""


ORACLE_SQL = {
    "op1_exact_dedup": f"""
        WITH folded AS (SELECT doc_id, {_FOLD} AS folded FROM documents)
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY folded) AS keep_id,
               count(*) OVER (PARTITION BY folded) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY folded) AS kept,
               sha256(folded) AS text_sha256
        FROM folded
    """,
    "op6_minhash_dedup": _NEAR_TEXTS,
    "op7_embedding_dedup": _NEAR_VECTORS,
    "op10_warc": """
        WITH payloads AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
        ), described AS (
            SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest,
                   max(page_id) OVER (PARTITION BY payload) AS largest
            FROM payloads
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN largest END AS refers_to
        FROM described
    """,
    "op11_decontamination": _DECONTAMINATION,
    "op12_clustering": _clustering(),
}
