"""SQL of live holds, the streaming scan, and the functions in SQL."""

from __future__ import annotations

from .catalog_sql import _CUSTOMER_TEXT, _HOLDS, _LINE, _LUHN, _NETWORK, _RAW, _STRINGS, _candidates, _key_matches, _kind, _repaired, _wallets


def _live(auto_return: bool = True) -> str:
    """CTE live(user_id, hold_start, hold_end, n_triggers, early, return_scene)."""
    timed = "shot + INTERVAL 24 HOURS < ts OR" if auto_return else ""
    due = "max(ts) FILTER (kind = 0) + INTERVAL 24 HOURS" if auto_return else "NULL::TIMESTAMP"
    early = "coalesce(cut < due, false)" if auto_return else "cut IS NOT NULL"
    return f"""
    marks AS (SELECT user_id, ts, CASE event_type WHEN 'error' THEN 0 ELSE 1 END AS kind FROM events WHERE event_type IN ('error', 'login') AND ts IS NOT NULL),
    before AS (
        SELECT *, max(CASE WHEN kind = 0 THEN ts END) OVER w AS shot, max(CASE WHEN kind = 1 THEN ts END) OVER w AS back FROM marks
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), dealt AS (
        SELECT *, sum(CASE WHEN kind = 0 AND (shot IS NULL OR {timed} coalesce(back >= shot, false)) THEN 1 ELSE 0 END)
                  OVER (PARTITION BY user_id ORDER BY ts, kind ROWS UNBOUNDED PRECEDING) AS number FROM before
    ), spans AS (
        SELECT user_id, min(ts) FILTER (kind = 0) AS hold_start, {due} AS due, count(*) FILTER (kind = 0) AS n_triggers, min(ts) FILTER (kind = 1) AS cut
        FROM dealt WHERE number > 0 GROUP BY user_id, number
    ), cut_spans AS (SELECT user_id, hold_start, least(due, cut) AS hold_end, n_triggers, {early} AS early FROM spans),
    seen AS (
        SELECT user_id, ts, event_type FROM events e WHERE event_type NOT IN ('error', 'login')
        AND NOT EXISTS (SELECT 1 FROM cut_spans h WHERE h.user_id = e.user_id AND h.hold_start <= e.ts AND e.ts < coalesce(h.hold_end, TIMESTAMP '9999-01-01'))
    ), live AS (
        SELECT h.*, (SELECT arg_max(event_type, (ts, event_type)) FROM seen s WHERE s.user_id = h.user_id AND s.ts < h.hold_start) AS return_scene FROM cut_spans h
    )"""


def _passed(moment: str, rows: str = "events WHERE event_type IS NOT NULL") -> str:
    """The watermark has reached a moment when the stream is over."""
    return f"{moment} <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 SECONDS FROM {rows})"


_OVERLAPS = """least(g.x + g.w, n.x + n.w) > greatest(g.x, n.x) AND least(g.y + g.h, n.y + n.h) > greatest(g.y, n.y)
    AND (least(g.x + g.w, n.x + n.w) - greatest(g.x, n.x)) * (least(g.y + g.h, n.y + n.h) - greatest(g.y, n.y))
        >= 0.5 * (g.w * g.h + n.w * n.h - (least(g.x + g.w, n.x + n.w) - greatest(g.x, n.x)) * (least(g.y + g.h, n.y + n.h) - greatest(g.y, n.y)))"""

#: The greedy merge as a recursion over a document's detections in their order.
_SCAN = f"""{_RAW.replace("WITH", "WITH RECURSIVE", 1)},
    numbered AS (SELECT doc_id, det_ord, confidence, x::BIGINT AS x, y::BIGINT AS y, w::BIGINT AS w, h::BIGINT AS h, row_number() OVER (PARTITION BY doc_id ORDER BY det_ord) AS k FROM detections),
    folded(doc_id, k, leaders) AS (
        SELECT doc_id, k, [{{'x': x, 'y': y, 'w': w, 'h': h, 'best': det_ord, 'confidence': confidence}}] FROM numbered WHERE k = 1
        UNION ALL
        SELECT doc_id, k, CASE
            WHEN hit IS NULL OR hit = 0 THEN list_append(leaders, {{'x': x, 'y': y, 'w': w, 'h': h, 'best': det_ord, 'confidence': confidence}})
            ELSE list_transform(leaders, lambda g, i: CASE WHEN i = hit AND confidence > g.confidence
                THEN {{'x': g.x, 'y': g.y, 'w': g.w, 'h': g.h, 'best': det_ord, 'confidence': confidence}} ELSE g END) END
        FROM (SELECT n.*, f.leaders, list_position(list_transform(f.leaders, lambda g: {_OVERLAPS}), true) AS hit FROM folded f JOIN numbered n ON n.doc_id = f.doc_id AND n.k = f.k + 1)
    ), kept AS (SELECT doc_id, unnest(leaders).best AS det_ord FROM (SELECT doc_id, arg_max(leaders, k) AS leaders FROM folded GROUP BY doc_id))
    SELECT doc_id, type, confidence, preview, x::BIGINT AS x, y::BIGINT AS y, w::BIGINT AS w, h::BIGINT AS h, action,
           row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, det_ord) AS rank
    FROM kept JOIN detections USING (doc_id, det_ord)"""

#: Turns as frames: what changed is scanned as a document of its own.
_FRAMES = """gated AS (
        SELECT conv_id, turn, text, conv_id::VARCHAR || '/' || turn::VARCHAR AS frame, row_number() OVER o = 1 OR text IS DISTINCT FROM lag(text) OVER o AS changed
        FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)
    ), documents AS (SELECT frame AS doc_id, text FROM gated WHERE changed)"""


def _loop() -> str:
    merged = _SCAN.replace("WITH RECURSIVE", f"WITH RECURSIVE {_FRAMES},", 1).replace("FROM detections)", "FROM detections WHERE type <> 'seed_phrase')", 1)
    a = merged.rindex("SELECT doc_id, type, confidence, preview")
    return f"""{merged[:a].rstrip()}, shown AS ({merged[a:]}), per AS (SELECT doc_id AS frame, count(*) AS n, bool_or(action = 'blur') AS blur FROM shown GROUP BY 1)
        SELECT conv_id, count(*) AS n_frames, count(*) FILTER (changed) AS n_changed, coalesce(sum(n), 0)::BIGINT AS n_detections, count(*) FILTER (blur) AS n_alerts
        FROM gated LEFT JOIN per USING (frame) GROUP BY conv_id"""


_SHOWN = "CASE WHEN length('[' || service || '] ' || description) > 50 THEN left('[' || service || '] ' || description, 47) || '...' ELSE '[' || service || '] ' || description END"
_NUMBER = "lpad(c_custkey::VARCHAR, 4, '4') || '11l1 11II 1O'"

ORACLES: dict[str, str] = {
    "live_holds": f"WITH {_live()} SELECT * FROM live",
    "live_open_holds": f"WITH {_live(False)} SELECT * FROM live",
    "stream_live_holds": f"WITH {_live()} SELECT * FROM live WHERE {_passed('hold_end')}",
    "stream_scene_actions": f"""WITH {_live()}, over AS (SELECT * FROM live WHERE {_passed('hold_end')})
        SELECT user_id, hold_start AS at, 'privacy' AS action, 'privacy' AS scene, true AS played, 1 AS attempts, NULL::VARCHAR AS problem FROM over
        UNION ALL SELECT user_id, hold_end, 'return', return_scene, true, 1, NULL FROM over WHERE return_scene IS NOT NULL""",
    "stream_holds": f"WITH {_HOLDS} SELECT * FROM holds WHERE {_passed('hold_end', 'errors')}",
    "scan_detections": _SCAN,
    "stream_scan": _SCAN,
    "stream_scan_log": f"""{_SCAN.replace("FROM detections)", "FROM detections WHERE type <> 'seed_phrase')", 1).replace("SELECT doc_id, type, confidence, preview, x::BIGINT", "SELECT (SELECT count(*) FROM documents) AS n_rows, count(*) AS n_detections, 4::BIGINT AS detectors_run, '' AS failed FROM (SELECT doc_id, type, confidence, preview, x::BIGINT")})""",
    "stream_loop": _loop(),
    "stream_type_counts": f"""WITH {_candidates('documents')}, {_key_matches('documents')}, strings(string) AS (VALUES {", ".join(f"('{s}')" for s in _STRINGS)}),
        found AS (
            SELECT doc_id, 'credit_card' AS type FROM candidates WHERE {_LUHN}
            UNION ALL SELECT doc_id, 'api_key' FROM keys
            UNION ALL SELECT doc_id, 'personal_string' FROM documents, strings WHERE contains(lower({_LINE}), lower(string))
        ), timed AS (SELECT doc_id, TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS ts FROM documents)
        SELECT date_trunc('hour', ts) AS window_start, type, count(*) AS n FROM found JOIN timed USING (doc_id)
        WHERE {_passed("date_trunc('hour', ts) + INTERVAL 1 HOUR", "timed")} GROUP BY ALL""",
    "sql_scalars": f"""WITH c AS (SELECT c_custkey, {_CUSTOMER_TEXT} AS given, {_NUMBER} AS number FROM customer), r AS (SELECT *, {_repaired('number')} AS repaired FROM c),
        d AS (SELECT *, regexp_replace(repaired || '1', '\\D', '', 'g') AS digits FROM r)
        SELECT c_custkey, {_kind('given')} AS kind, CASE WHEN length(given) <= 4 THEN repeat('*', length(given)) ELSE left(given, 2) || repeat('*', length(given) - 3) || right(given, 1) END AS masked,
               {_NETWORK} AS network, repaired,
               length(digits) IN (13, 14, 15, 16, 19) AND list_sum(list_transform(range(1, length(digits) + 1), lambda i:
                   CASE WHEN i % 2 = 0 THEN (2 * substr(reverse(digits), i, 1)::INT) // 10 + (2 * substr(reverse(digits), i, 1)::INT) % 10 ELSE substr(reverse(digits), i, 1)::INT END)) % 10 = 0 AS valid,
               given || ' x' AS line
        FROM d""",
    "sql_findings": f"""WITH {_candidates('documents')}, {_key_matches('documents')}, {_wallets('documents').split('wallet_toks AS')[0].rstrip().rstrip(',')},
        found AS (
            SELECT doc_id, 'credit_card' AS type, left(number, 4) || '...' || right(number, 4) AS preview, 0.8::DOUBLE AS confidence FROM candidates WHERE {_LUHN}
            UNION ALL SELECT doc_id, 'crypto_address', left(address, 10) || '...' || right(address, 10),
                CASE network WHEN 'BTC' THEN CASE WHEN address LIKE 'bc1%' THEN 0.95::DOUBLE ELSE 0.9::DOUBLE END
                    WHEN 'ETH' THEN CASE WHEN regexp_matches(substr(address, 3, 40), '[A-F]') AND regexp_matches(substr(address, 3, 40), '[a-f]') THEN 0.95::DOUBLE ELSE 0.85::DOUBLE END ELSE 0.8::DOUBLE END
            FROM wallets
            UNION ALL SELECT doc_id, 'api_key', {_SHOWN}, confidence FROM keys
        )
        SELECT *, CASE WHEN confidence >= 0.8 THEN 'blur' WHEN confidence >= 0.6 THEN 'warn' ELSE 'ignore' END AS action FROM found""",
}
