"""SQL twins of the operators that run in rounds over ``embeddings``: one set of named tables a round."""

from __future__ import annotations

_INTEGERS = """
    v AS MATERIALIZED (
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0{more}
    )"""
_SQUARES = "CAST(list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i]))) AS BIGINT)"
#: Mean rounded down, in integers.
_FLOOR = "CAST((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT)"


def _decimals(column: str) -> str:
    return f"array_to_string(list_transform({column}, lambda x: CAST(x AS VARCHAR)), ',')"


def centroids_sql(k: int = 16, rounds: int = 3, scale: int = 64, width: int = 64, salt: str = "1") -> str:
    tables = [_INTEGERS.format(scale=scale, more=f" AND len(embedding) = {width}")]
    tables.append(f"seeds AS (SELECT v, sha256('{salt}:' || vec_id) AS h FROM v ORDER BY h LIMIT {k})")
    tables.append("c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM seeds)")
    for r in range(rounds + 1):
        near = _SQUARES.format(a="v.v", b="c.v")
        tables.append(
            f"""a{r} AS MATERIALIZED (
        SELECT vec_id, v, near.c AS c, near.d AS d
        FROM (SELECT v.vec_id, any_value(v.v) AS v, min({{'d': {near}, 'c': c.c}}) AS near FROM v CROSS JOIN c{r} c GROUP BY v.vec_id)
    )"""
        )
        if r < rounds:
            tables.append(
                f"""m{r} AS (
        SELECT c, list(m ORDER BY i) AS v
        FROM (SELECT c, i, {_FLOOR} AS m FROM (SELECT c, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{r}) GROUP BY c, i) GROUP BY c
    ),
    c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.c = c.c)"""
            )
    return f"""
    WITH {", ".join(tables)}
    SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
        CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256({_decimals("c.v")}) AS centroid_sha256
    FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c
    """


def codes_sql(parts: int = 8, k: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    tables = [_INTEGERS.format(scale=scale, more="")]
    tables.append(
        f"""p AS MATERIALIZED (
        SELECT vec_id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v FROM v CROSS JOIN (SELECT unnest(range({parts})) AS p)
    )"""
    )
    tables.append(f"seeds AS (SELECT vec_id FROM v ORDER BY vec_id LIMIT {k})")
    tables.append("b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM p JOIN seeds USING (vec_id))")
    for r in range(rounds + 1):
        near = _SQUARES.format(a="p.v", b="b.v")
        tables.append(
            f"""a{r} AS MATERIALIZED (
        SELECT vec_id, label, p, v, near.e AS e, near.d AS d
        FROM (SELECT p.vec_id, p.p, any_value(p.label) AS label, any_value(p.v) AS v, min({{'d': {near}, 'e': b.e}}) AS near FROM p JOIN b{r} b ON p.p = b.p GROUP BY p.vec_id, p.p)
    )"""
        )
        if r < rounds:
            tables.append(
                f"""m{r} AS (
        SELECT p, e, list(m ORDER BY i) AS v
        FROM (SELECT p, e, i, {_FLOOR} AS m FROM (SELECT p, e, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{r}) GROUP BY p, e, i) GROUP BY p, e
    ),
    b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.e = b.e)"""
            )
    return f"""
    WITH {", ".join(tables)},
    book AS (SELECT sha256(string_agg({_decimals("v")}, ',' ORDER BY p, e)) AS digest FROM b{rounds}),
    coded AS (
        SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id
    )
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM coded CROSS JOIN book
    """
