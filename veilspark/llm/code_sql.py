"""SQL of op11: the same codebooks by a full search, round by round."""

from __future__ import annotations

_START = """
    WITH kept AS MATERIALIZED (
        SELECT vec_id, label, embedding FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c)))
    ), flat AS MATERIALIZED (
        SELECT vec_id, (place - 1) // width AS part, (place - 1) % width AS place, floor(4096 * c::DOUBLE)::BIGINT AS v
        FROM (SELECT vec_id, unnest(embedding) AS c, generate_subscripts(embedding, 1) AS place, len(embedding) // 8 AS width FROM kept)
    ), book0 AS MATERIALIZED (
        SELECT part, entry, place, v AS e FROM flat
        JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 16) USING (vec_id)
    )"""
_NEAREST = """, near{r} AS MATERIALIZED (
        SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d
        FROM (SELECT vec_id, part, entry, sum((v - e) * (v - e))::BIGINT AS d FROM flat JOIN book{r} USING (part, place) GROUP BY ALL)
        GROUP BY ALL
    )"""
_MOVED = """, moved{r} AS (
        SELECT part, entry, place, sum(v)::BIGINT AS s, count(*) AS n FROM flat JOIN near{r} USING (vec_id, part) GROUP BY ALL
    ), book{next} AS MATERIALIZED (
        SELECT part, entry, place, coalesce((s - ((s % n) + n) % n) // n, e) AS e FROM book{r} LEFT JOIN moved{r} USING (part, entry, place)
    )"""
_END = """, coded AS MATERIALIZED (
        SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{r} GROUP BY vec_id
    )
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
           (SELECT sha256(string_agg(e::VARCHAR, ',' ORDER BY part, entry, place)) FROM book{r}) AS codebooks_sha256
    FROM coded JOIN kept USING (vec_id)
"""


def text(rounds: int = 6) -> str:
    middle = "".join(_NEAREST.format(r=r) + _MOVED.format(r=r, next=r + 1) for r in range(rounds))
    return _START + middle + _NEAREST.format(r=rounds) + _END.format(r=rounds)
