"""DuckDB answers for the operators whose results SQL can express."""

from __future__ import annotations

from .centroid_clustering import CENTROIDS, DIM, ROUNDS, SCALE, SEED
from .decontamination import WINDOW
from .fill_in_middle import SUFFIX_FIRST, TRANSFORMED

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = rf"coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"


def decontamination() -> str:
    """Windows of documents, of every length that items have, joined with those of items."""
    run = "array_to_string(w[i:i + k - 1], ' ')"
    return (
        f"WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents), "
        f"items AS (SELECT item_id, {WORDS} AS w, least(len(w), {WINDOW}) AS k FROM benchmark), "
        f"item_windows AS MATERIALIZED (SELECT DISTINCT item_id, k, {run} AS s FROM "
        "(SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM items WHERE k > 0)), "
        f"doc_windows AS (SELECT rid, i, k, {run} AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i "
        "FROM docs, (SELECT DISTINCT k FROM item_windows) WHERE len(w) >= k)), "
        "hits AS MATERIALIZED (SELECT rid, i, k, item_id FROM doc_windows JOIN item_windows USING (k, s)), "
        "hit_words AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS place FROM hits) GROUP BY rid), "
        "hit_items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS named FROM "
        "(SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY rid) "
        "SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, "
        "sha256(coalesce(named, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated "
        "FROM docs LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)"
    )


def fill_in_middle() -> str:
    def number(k: int) -> str:
        return f"CAST('0x' || substr(h, {1 + 8 * k}, 8) AS BIGINT)"

    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(t) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents), "
        f"c AS (SELECT *, {number(0)} % (n + 1) AS a, {number(1)} % (n + 1) AS b, "
        f"CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {number(2)} % 100 >= {TRANSFORMED} THEN 'plain' "
        f"WHEN {number(3)} % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM d), "
        "p AS (SELECT *, substr(t, 1, least(a, b)) AS pre, substr(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS mid, "
        "substr(t, greatest(a, b) + 1) AS suf FROM c) "
        "SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars, "
        "CASE WHEN form <> 'plain' THEN greatest(a, b) - least(a, b) END AS middle_chars, "
        "sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid "
        "ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"
    )


def centroid_clustering() -> str:
    """Every round as two table expressions: the vectors' centroids, and the centroids that follow."""
    order = f"sha256('{SEED}' || coalesce(CAST(vec_id AS VARCHAR), '')), q"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS q "
        f"FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY {order}) - 1 AS INTEGER) AS cluster, q AS c FROM v ORDER BY {order} LIMIT {CENTROIDS})",
    ]
    for n in range(ROUNDS + 1):
        parts.append(
            f"a{n} AS MATERIALIZED (SELECT rid, cluster, list_sum(list_transform(range(1, {DIM + 1}), lambda i: (q[i] - c[i]) * (q[i] - c[i]))) AS d "
            f"FROM v, c{n} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, cluster) = 1)"
        )
        if n < ROUNDS:
            parts.append(
                f"c{n + 1} AS MATERIALIZED (SELECT cluster, coalesce(u.c, o.c) AS c FROM c{n} o LEFT JOIN (SELECT cluster, list(mean ORDER BY place) AS c FROM "
                "(SELECT cluster, place, CAST((s - ((s % m) + m) % m) // m AS BIGINT) AS mean FROM (SELECT cluster, place, sum(x) AS s, count(*) AS m FROM "
                f"(SELECT cluster, unnest(q) AS x, generate_subscripts(q, 1) AS place FROM a{n} JOIN v USING (rid)) GROUP BY ALL)) GROUP BY cluster) u USING (cluster))"
            )
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 "
        f"FROM a{ROUNDS} JOIN v USING (rid) JOIN c{ROUNDS} USING (cluster)"
    )


def statements() -> dict[str, str]:
    return {
        "op11_decontamination": decontamination(),
        "op12_fill_in_middle": fill_in_middle(),
        "op13_centroid_clustering": centroid_clustering(),
    }
