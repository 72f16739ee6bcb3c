"""SQL of the derived tables, for the oracle queries, and the registry of queries."""

from __future__ import annotations

import re
from collections.abc import Callable

VIEWS = {
    "ev": """SELECT event_id AS id, 'scan-' || user_id AS scan_id, (epoch_us(ts) // 1000)::BIGINT AS at_ms, event_type AS action, props AS details, user_id, value FROM events""",
    "ses": """SELECT 'scan-' || user_id AS scan_id, 'video-' || (user_id % 9) || '.mp4' AS video,
      ['proposed','validated','tracking','completed','failed'][(user_id % 5 + 1)::INT] AS status, CASE WHEN user_id % 3 <> 0 THEN user_id % 7 END AS expected_count,
      user_id % 2 = 0 AS review_ready, max(epoch_us(ts) // 1000)::BIGINT AS updated_at_ms, user_id FROM events GROUP BY user_id""",
    "bx": """SELECT l_orderkey AS frame_index, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS box_id,
      (l_partkey * 7 % 120)::DOUBLE AS x1, (l_suppkey * 13 % 120)::DOUBLE AS y1, (l_partkey * 7 % 120)::DOUBLE + 80 + l_quantity::DOUBLE AS x2,
      (l_suppkey * 13 % 120)::DOUBLE + 120 + l_quantity::DOUBLE * 2 AS y2, l_extendedprice::DOUBLE / (l_extendedprice::DOUBLE + 50000) AS confidence FROM lineitem""",
    "obs": """SELECT *, (p % 97)::DOUBLE / 97 AS similarity, (p * 7 % 89)::DOUBLE / 178 AS margin, (p % 97)::DOUBLE / 97 - (p * 7 % 89)::DOUBLE / 178 AS impostor_similarity,
      CASE WHEN p % 4 <> 0 THEN (p % 83)::DOUBLE / 41.5 - 1 END AS body_similarity FROM (SELECT *, frame_index * 31 + box_id * 17 AS p FROM bx)""",
    "fr": """SELECT o_orderkey AS frame_index, (CASE WHEN o_orderkey % 2 = 0 THEN 1920 ELSE 1080 END)::BIGINT AS width, (CASE WHEN o_orderkey % 2 = 0 THEN 1080 ELSE 1920 END)::BIGINT AS height,
      CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey * 37 % 1900)::DOUBLE END AS cx, CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey * 53 % 1050)::DOUBLE END AS cy,
      o_totalprice::DOUBLE % 700 AS half_size, ['observed','predicted','held'][(o_orderkey % 3 + 1)::INT] AS source, o_orderkey % 23 AS miss_count FROM orders""",
    "cand": """SELECT vec_id AS id, 'scan-' || label AS scan_id, label::BIGINT AS label, (vec_id * 37 % 60)::DOUBLE / 100 + 0.4::DOUBLE AS confidence, vec_id % 9 + 1 AS observations,
      vec_id * 3 AS first_frame, vec_id * 3 + vec_id % 50 AS last_frame, (vec_id * 7 % 100)::DOUBLE / 1000 AS anchor_x, (vec_id * 13 % 100)::DOUBLE / 1000 AS anchor_y,
      (vec_id * 11 % 60)::DOUBLE / 100 + 0.3::DOUBLE AS face_presence, (vec_id * 17 % 50)::DOUBLE / 100 + 0.4::DOUBLE AS thumbnail_score, embedding FROM embeddings""",
    "msg": """SELECT CASE WHEN action IN ('error', 'purchase') THEN 'rescan' ELSE 'discovery' END AS queue, id AS seq, action AS message_type, 'job-' || id AS job_id,
      user_id || ':' || action AS idempotency_key, at_ms AS created_at_ms, id % 4 AS attempt FROM ev""",
    "art": """SELECT 'diag-' || doc_id || '.json' AS file_name, '/data/bundles/' || source || '/diag-' || doc_id || '.json' AS path, octet_length(encode(text))::BIGINT AS bytes,
      doc_id * 7919 % 1000 AS modified_at_ms, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS sha256, text, doc_id, source FROM documents""",
}
DOT = "(SELECT sum(({a})[i]::DOUBLE * ({b})[i]::DOUBLE) FROM range(1, least(len({a}), len({b})) + 1) t(i))"


def iou_sql(a: str, b: str) -> str:
    both = f"(greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0::DOUBLE) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0::DOUBLE))"
    area = lambda t: f"({t}.x2 - {t}.x1) * ({t}.y2 - {t}.y1)"
    return f"(CASE WHEN {both} > 0 THEN {both} / ({area(a)} + {area(b)} - {both}) ELSE 0::DOUBLE END)"


def clamp_sql(x: str, low: float = 0, high: float = 1) -> str:
    return f"least(greatest({x}, {low}::DOUBLE), {high}::DOUBLE)"


def with_views(sql: str) -> str:
    """The query with the derived tables that it names in front of it."""
    needed, todo = [], [sql]
    while todo:
        text = todo.pop()
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                needed.append(name)
                todo.append(body)
    if not needed:
        return sql
    order = [n for n in ("ev", "ses", "bx", "obs", "fr", "cand", "msg", "art") if n in needed]
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)
    body = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return f"{start}{head}, {body[len(start):]}"
    return f"WITH {head} {body}"


class Plans:
    """Queries by name, with their SQL where they have one."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        def put(f: Callable) -> Callable:
            self.queries[name] = f
            if sql:
                self.sql[name] = with_views(sql)
            return f

        return put
