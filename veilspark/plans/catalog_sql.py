"""DuckDB SQL with the same results as the registered queries."""

from __future__ import annotations

from ..functions.text import ADDRESS_PARTS
from ..sources.patterns import BUILT_IN


def _layout(source: str = "documents") -> str:
    """CTEs that end in toks(doc_id, ord, line_no, pos, text, x, y, w, h)."""
    return rf"""
    src_lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no
        FROM {source}
    ), line_words AS (
        SELECT doc_id, line_no, list_filter(regexp_split_to_array(line, '\s+'), lambda t: t <> '') AS ws FROM src_lines
    ), placed AS (
        SELECT doc_id, line_no, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS pos FROM line_words
    ), toks AS (
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, pos) - 1 AS ord, line_no, pos, text,
               (coalesce(sum(length(text)) OVER (PARTITION BY doc_id, line_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + pos)::BIGINT * 8 AS x,
               line_no * 20 AS y, length(text) * 8 AS w, 20 AS h
        FROM placed
    )"""


_SPLIT = r"""
    token_words AS (
        SELECT *, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda q: regexp_full_match(q, '[a-z]+')) AS ws FROM toks
    ), split_words AS (
        SELECT doc_id, ord, y, h, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS sub,
               x AS x0, w AS w0, len(ws) AS n FROM token_words WHERE len(ws) > 0
    ), words AS (
        SELECT doc_id, ord, sub, word, y, h, CASE WHEN n = 1 THEN x0 ELSE x0 + sub * (w0 // n) END AS x,
               CASE WHEN n = 1 THEN w0 ELSE w0 // n END AS w FROM split_words
    )"""

_DICTIONARY = r"""
    all_words AS (
        SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents
    ), dictionary AS (
        SELECT word, count(*) AS n FROM all_words WHERE regexp_full_match(word, '[a-z]{3,8}') GROUP BY word ORDER BY n DESC, word LIMIT 2048
    )"""

_LINE = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"


def _repaired(q: str) -> str:
    """The chain of digit repairs as nested calls around ``q``."""
    def step(pattern, replacement):
        nonlocal q
        q = f"regexp_replace({q}, '{pattern}', '{replacement}', 'g')"

    for _ in range(3):
        step(r"(\d)l", r"\11"), step(r"l(\d)", r"1\1"), step(r"(1)l", r"\11"), step(r"l(1)", r"1\1")
    for _ in range(2):
        for k in range(1, 9):
            step(r"(^|[^\p{L}\p{N}_])l{%d}($|[^\p{L}\p{N}_])" % k, r"\1" + "1" * k + r"\2")
    for a, n in (("I", "1"), ("O", "0"), ("o", "0")):
        step(rf"(\d[\s\-]*){a}([\s\-]*\d)", rf"\1{n}\2"), step(rf"(\d){a}", rf"\1{n}"), step(rf"{a}(\d)", rf"{n}\1")
    return q


_LUHN = """(list_sum(list_transform(range(1, 17), lambda i:
    CASE WHEN i % 2 = 1 THEN (2 * substr(number, i, 1)::INT) // 10 + (2 * substr(number, i, 1)::INT) % 10 ELSE substr(number, i, 1)::INT END)) % 10 = 0)"""

_NETWORK = """CASE WHEN number LIKE '4%' THEN 'Visa' WHEN left(number, 2) BETWEEN '51' AND '55' THEN 'MasterCard'
    WHEN left(number, 2) >= '22' AND left(number, 4) <= '2720' THEN 'MasterCard' WHEN left(number, 2) IN ('34', '37') THEN 'Amex'
    WHEN left(number, 4) = '6011' OR left(number, 2) IN ('65', '64') THEN 'Discover' ELSE 'Unknown' END"""


def _candidates(source: str) -> str:
    return rf"""
    lined AS (
        SELECT doc_id, {_LINE} AS line FROM {source} WHERE len(regexp_extract_all(text, '[0-9lIOo]')) >= 16
    ), cleaned AS (
        SELECT doc_id, {_repaired('line')} AS clean FROM lined
    ), token_digits AS (
        SELECT doc_id, regexp_replace({_repaired('t')}, '\D', '', 'g') AS d
        FROM (SELECT doc_id, unnest(string_split(line, ' ')) AS t FROM lined) WHERE len(regexp_extract_all(t, '[0-9lIOo]')) >= 16
    ), numbers AS (
        SELECT doc_id, translate(m, ' -', '') AS number
        FROM (SELECT doc_id, unnest(regexp_extract_all(clean, '\b\d{{4}}[\s\-]?\d{{4}}[\s\-]?\d{{4}}[\s\-]?\d{{4}}\b')) AS m FROM cleaned)
        UNION ALL
        SELECT doc_id, substr(d, i, 16) FROM (SELECT doc_id, d, unnest(range(1, length(d) - 14)) AS i FROM token_digits WHERE length(d) >= 16)
    ), candidates AS (
        SELECT DISTINCT doc_id, number FROM numbers WHERE regexp_full_match(number, '\d{{16}}')
    )"""


def _cards(source: str) -> str:
    return rf"""
    {_candidates(source)}, valid AS (
        SELECT doc_id, number FROM candidates WHERE {_LUHN}
    ), card_source AS (SELECT * FROM {source} WHERE doc_id IN (SELECT doc_id FROM valid)),
    {_layout('card_source')}, clean_toks AS (
        SELECT *, translate({_repaired('text')}, ' -', '') AS clean FROM toks
    ), touched AS (
        SELECT v.doc_id, v.number, t.x, t.y, t.w, t.h FROM valid v JOIN clean_toks t USING (doc_id)
        WHERE list_bool_or(list_transform(range(1, 14), lambda i: contains(t.clean, substr(v.number, i, 4))))
    ), boxes AS (
        SELECT doc_id, number, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM touched GROUP BY ALL
    ), hints AS (
        SELECT b.doc_id, b.number, string_agg(t.text, ' ' ORDER BY t.ord) AS around
        FROM boxes b JOIN toks t USING (doc_id)
        WHERE sqrt(pow(t.x + t.w // 2 - b.x - b.w // 2, 2) + pow(t.y + t.h // 2 - b.y - b.h // 2, 2)) <= 100 GROUP BY ALL
    ), flags AS (
        SELECT boxes.*, regexp_matches(coalesce(around, ''), '\b(0[1-9]|1[0-2])[\s/\-](20)?\d{{2}}\b') AS has_expiry,
               regexp_matches(coalesce(around, ''), '(?i)\b(CVV|CVC|CV2)[\s:]?\d{{3,4}}\b') AS has_cvv
        FROM boxes LEFT JOIN hints USING (doc_id, number)
    )"""


_CARD_SELECT = f"""
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY number) AS part,
           least(0.8::DOUBLE + CASE WHEN has_expiry THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN has_cvv THEN 0.05::DOUBLE ELSE 0 END, 0.95::DOUBLE) AS confidence,
           left(number, 4) || '...' || right(number, 4) AS preview, x, y, w, h,
           has_expiry::VARCHAR AS has_expiry, has_cvv::VARCHAR AS has_cvv, {_NETWORK} AS network
    FROM flags"""

_GAP = "\\n" * 8
_SECRETS = """
    secret_parts AS (
        SELECT o_orderkey AS doc_id, o_orderkey::VARCHAR AS k, md5(o_orderkey::VARCHAR) AS md, md5(o_orderkey::VARCHAR || 'b') AS more,
               lpad(o_orderkey::VARCHAR, 15, '4') AS body FROM orders
    ), secret_cards AS (
        SELECT *, list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 1
            THEN (2 * substr(body, i, 1)::INT) // 10 + (2 * substr(body, i, 1)::INT) % 10 ELSE substr(body, i, 1)::INT END))::BIGINT AS total FROM secret_parts
    ), secrets AS (
        SELECT doc_id, 'eth 0x' || md || CASE WHEN doc_id % 2 = 0 THEN upper(left(more, 8)) ELSE left(more, 8) END || repeat(chr(10), 8)
            || 'sol ' || translate(md, '0', 'z') || 'Qm' || repeat(chr(10), 8) || 'btc 1' || translate(md, '0', 'z') || repeat(chr(10), 8)
            || body || ((10 - total % 10) % 10)::VARCHAR || CASE WHEN doc_id % 3 = 0 THEN ' Exp 12/27 CVV 123' ELSE '' END
            || repeat(chr(10), 8) || 'AKIA' || upper(left(md, 16)) AS text
        FROM secret_cards
    )"""


def _key_matches(source: str) -> str:
    """CTE keys(doc_id, part, service, description, confidence, match)."""
    services = list(dict.fromkeys(p.service for p in BUILT_IN))
    parts = []
    for k, s in enumerate(services):
        own = [p for p in BUILT_IN if p.service == s]
        quoted = [p.pattern.replace("'", "''") for p in own]
        match, desc, conf = (
            "CASE " + " ".join(f"WHEN regexp_matches(line, '{q}') THEN {v(p, q)}" for p, q in zip(own, quoted, strict=True)) + " END"
            for v in (lambda p, q: f"regexp_extract(line, '{q}')", lambda p, q: f"'{p.description}'", lambda p, q: f"{p.confidence}::DOUBLE")
        )
        parts.append(f"SELECT doc_id, {k} AS part, '{s}' AS service, {desc} AS description, {conf} AS confidence, {match} AS match FROM key_lines")
    return f"key_lines AS (SELECT doc_id, {_LINE} AS line FROM {source}), keys AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE match IS NOT NULL)"


_FIRST = "row_number() OVER (PARTITION BY doc_id, part ORDER BY CASE WHEN {hit} THEN 0 ELSE 1 END, ord) AS place"
_KEYS = rf"""
    {_key_matches('documents')}, key_source AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM keys)), {_layout('key_source')},
    key_rows AS (
        SELECT * FROM (
            SELECT k.*, t.x, t.y, t.w, t.h, {_FIRST.format(hit="contains(t.text, left(k.match, 8))")} FROM keys k JOIN toks t USING (doc_id)
        ) WHERE place = 1
    ), key_detections AS (
        SELECT doc_id, part, 'api_key' AS type, service, confidence, x, y, w, h,
               CASE WHEN length('[' || service || '] ' || description) > 50 THEN left('[' || service || '] ' || description, 47) || '...'
                    ELSE '[' || service || '] ' || description END AS preview
        FROM key_rows
    )"""

_STRINGS = ("Apache License", "Version 2.0", "pathetic")


def _personal() -> str:
    values = ", ".join(f"({k}, '{s}')" for k, s in enumerate(_STRINGS))
    return rf"""
    wanted(part, string) AS (VALUES {values}),
    personal_hits AS (SELECT doc_id, part, string FROM documents, wanted WHERE contains(lower({_LINE}), lower(string))),
    personal_source AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM personal_hits)), {_layout('personal_source').replace('src_lines', 'p_lines').replace('line_words', 'p_words').replace('placed', 'p_placed').replace('toks', 'p_toks')},
    personal_rows AS (
        SELECT * FROM (
            SELECT k.*, t.x, t.y, t.w, t.h, {_FIRST.format(hit="contains(lower(t.text), lower(k.string))")} FROM personal_hits k JOIN p_toks t USING (doc_id)
        ) WHERE place = 1
    ), personal_detections AS (
        SELECT doc_id, part, 'personal_string' AS type, 1.0::DOUBLE AS confidence, x, y, w, h, string,
               left(string, 2) || repeat('*', length(string) - 3) || right(string, 1) AS preview FROM personal_rows
    )"""


def _kind(t: str) -> str:
    street = " OR ".join(f"contains(lower({t}), '{p}')" for p in ADDRESS_PARTS)
    return rf"""CASE WHEN regexp_matches({t}, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}') THEN 'email'
        WHEN regexp_matches({t}, '[\d\-()+\s]{{7,}}') AND length(regexp_replace({t}, '\D', '', 'g')) BETWEEN 7 AND 15 THEN 'phone'
        WHEN {street} OR regexp_matches({t}, '^\d+\s') THEN 'address' ELSE 'name' END"""


#: All detections on documents without the dictionary: cards, personal strings, keys. (No wallet address shape but one kind occurs.)
_WALLETS = r"""
    wallet_hits AS (
        SELECT DISTINCT doc_id, 'SOL' AS network, a AS address
        FROM (SELECT doc_id, unnest(regexp_extract_all(LINE, '\b[1-9A-HJ-NP-Za-km-z]{32,44}\b')) AS a FROM SOURCE)
        UNION
        SELECT DISTINCT doc_id, 'ETH', a FROM (SELECT doc_id, unnest(regexp_extract_all(LINE, '\b0x[a-fA-F0-9]{40}\b')) AS a FROM SOURCE)
        UNION
        SELECT DISTINCT doc_id, 'BTC', a FROM (SELECT doc_id, unnest(regexp_extract_all(LINE, '\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b')
            || regexp_extract_all(LINE, '\bbc1[a-z0-9]{39,59}\b')) AS a FROM SOURCE)
    ), wallets AS (
        SELECT doc_id, address, arg_min(network, p) AS network, min(p) AS p FROM (
            SELECT *, CASE WHEN network = 'BTC' THEN CASE WHEN address LIKE 'bc1%' THEN 1 ELSE 0 END WHEN network = 'ETH' THEN 10 ELSE 20 END AS p FROM wallet_hits) GROUP BY doc_id, address
    ), wallet_places AS (
        SELECT w.doc_id, w.network, w.address, w.p, min(strpos(line, address)) AS place FROM wallets w JOIN (SELECT doc_id, LINE AS line FROM SOURCE) USING (doc_id) GROUP BY ALL
    ), wallet_toks AS (
        SELECT w.*, t.x, t.y, t.w AS tw, t.h FROM wallet_places w JOIN toks t USING (doc_id)
        WHERE list_bool_or(list_transform(range(1, length(address) - 8), lambda i: contains(t.text, substr(address, i, 10))))
    ), wallet_rows AS (
        SELECT doc_id, network, address, p, place, min(x) AS x, min(y) AS y, max(x + tw) - min(x) AS w, max(y + h) - min(y) AS h FROM wallet_toks GROUP BY ALL
    ), wallet_scored AS (
        SELECT *, regexp_matches(substr(address, 3, 40), '[A-F]') AND regexp_matches(substr(address, 3, 40), '[a-f]') AS mixed FROM wallet_rows
    ), wallet_detections AS (
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p, place, address) AS part, 'crypto_address' AS type,
               CASE WHEN network = 'BTC' THEN CASE WHEN address LIKE 'bc1%' THEN 0.95::DOUBLE ELSE 0.9::DOUBLE END
                    WHEN network = 'ETH' THEN CASE WHEN mixed THEN 0.95::DOUBLE ELSE 0.85::DOUBLE END ELSE 0.8::DOUBLE END AS confidence,
               left(address, 10) || '...' || right(address, 10) AS preview, x, y, w, h, network,
               CASE WHEN network = 'BTC' THEN CASE WHEN address LIKE 'bc1%' THEN 'bech32' WHEN address LIKE '1%' THEN 'P2PKH' ELSE 'P2SH' END
                    WHEN network = 'ETH' THEN CASE WHEN mixed THEN 'EIP-55' ELSE 'standard' END ELSE 'base58' END AS address_format,
               length(address)::VARCHAR AS address_length
        FROM wallet_scored
    )"""


def _wallets(source: str) -> str:
    return _WALLETS.replace("LINE", _LINE).replace("SOURCE", source)


def _renamed(cte: str, tag: str) -> str:
    for name in ("src_lines", "line_words", "placed", "toks"):
        cte = cte.replace(name, f"{tag}_{name}") if f"{tag}_{name}" not in cte else cte
    return cte


_SEEDS = f"""WITH {_layout()}, {_SPLIT}, {_DICTIONARY}, kept AS (SELECT * FROM words WHERE word IN (SELECT word FROM dictionary)),
        gaps AS (SELECT *, CASE WHEN abs(y - lag(y) OVER (PARTITION BY doc_id ORDER BY y, x, ord, sub)) > 50 THEN 1 ELSE 0 END AS g FROM kept),
        runs AS (SELECT *, sum(g) OVER (PARTITION BY doc_id ORDER BY y, x, ord, sub ROWS UNBOUNDED PRECEDING)::BIGINT AS part FROM gaps)
        SELECT doc_id, part, CASE WHEN count(*) IN (12, 24) THEN 0.95::DOUBLE WHEN count(*) BETWEEN 10 AND 14 OR count(*) BETWEEN 22 AND 26 THEN 0.8::DOUBLE
                                  WHEN count(*) BETWEEN 15 AND 21 THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END AS confidence,
               first(word ORDER BY y, x, ord, sub) || '...' || last(word ORDER BY y, x, ord, sub) AS preview,
               min(x)::BIGINT AS x, min(y)::BIGINT AS y, (max(x + w) - min(x))::BIGINT AS w, (max(y + h) - min(y))::BIGINT AS h,
               count(*) AS word_count, CASE WHEN count(*) <= 15 THEN '12' ELSE '24' END AS expected_count
        FROM runs GROUP BY doc_id, part HAVING count(*) >= 12"""

#: detections(doc_id, det_ord, type, confidence, preview, x, y, w, h, action) of all detectors.
_RAW = f"""WITH
    seed_all AS ({_SEEDS}),
    card_rows AS (WITH {_cards('documents')} {_CARD_SELECT}),
    wallet_all AS (WITH wallet_source AS (SELECT * FROM documents WHERE regexp_matches({_LINE}, '\\b[1-9A-HJ-NP-Za-km-z]{{32,44}}\\b')), {_layout('wallet_source')}, {_wallets('wallet_source')} SELECT * FROM wallet_detections),
    personal_all AS (WITH {_personal()} SELECT * FROM personal_detections),
    key_all AS (WITH {_KEYS} SELECT * FROM key_detections),
    unioned AS (
        SELECT doc_id, 1000000 + part AS det_ord, 'seed_phrase' AS type, confidence, preview, x, y, w, h FROM seed_all
        UNION ALL SELECT doc_id, 2000000 + part AS det_ord, 'credit_card' AS type, confidence, preview, x, y, w, h FROM card_rows
        UNION ALL SELECT doc_id, 3000000 + part, type, confidence, preview, x, y, w, h FROM wallet_all
        UNION ALL SELECT doc_id, 4000000 + part, type, confidence, preview, x, y, w, h FROM personal_all
        UNION ALL SELECT doc_id, 5000000 + part, type, confidence, preview, x, y, w, h FROM key_all
    ), raw AS (
        SELECT *, CASE WHEN confidence >= 0.8 THEN 'blur' WHEN confidence >= 0.6 THEN 'warn' ELSE 'ignore' END AS action FROM unioned
    ), detections AS (SELECT * FROM raw WHERE action <> 'ignore')"""

_HOLDS = """
    errors AS (SELECT user_id, ts FROM events WHERE event_type = 'error'),
    gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 24 HOURS THEN 0 ELSE 1 END AS starts FROM errors),
    numbered AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM gaps),
    holds AS (SELECT user_id, min(ts) AS hold_start, max(ts) + INTERVAL 24 HOURS AS hold_end, count(*) AS n_triggers FROM numbered GROUP BY user_id, s)"""

_CUSTOMER_TEXT = """CASE c_custkey % 4 WHEN 0 THEN 'c' || c_custkey || '@mail.example' WHEN 1 THEN '+1 555 ' || lpad(c_custkey::VARCHAR, 7, '0')
    WHEN 2 THEN c_custkey || ' Main Rd' ELSE c_name END"""

ORACLES: dict[str, str] = {
    "tokens_layout": f"""WITH {_layout()} SELECT doc_id, count(*) AS n_tokens, max(line_no)::BIGINT AS last_line, sum(x)::BIGINT AS sum_x,
        sum(w)::BIGINT AS sum_w, max(x + w)::BIGINT AS right_edge FROM toks GROUP BY doc_id""",
    "tokens_split": f"""WITH {_layout()}, {_SPLIT} SELECT doc_id, count(*) AS n_words, sum(x + w)::BIGINT AS sum_right, max(sub)::BIGINT AS most_sub
        FROM words GROUP BY doc_id""",
    "box_geometry": f"""WITH {_layout()}, nexts AS (
            SELECT *, lead(x) OVER o AS bx, lead(y) OVER o AS by_, lead(w) OVER o AS bw, lead(h) OVER o AS bh FROM toks WINDOW o AS (PARTITION BY doc_id ORDER BY ord))
        SELECT doc_id, sum(w * h)::BIGINT AS area, sum(x + w // 2)::BIGINT AS center_x, sum(CASE WHEN abs(by_ - y) <= 10 THEN 1 ELSE 0 END)::BIGINT AS same_line,
               round(sum(sqrt((bx + bw // 2 - x - w // 2) * (bx + bw // 2 - x - w // 2) + (by_ + bh // 2 - y - h // 2) * (by_ + bh // 2 - y - h // 2))), 3) AS distance
        FROM nexts GROUP BY doc_id""",
    "box_merge": f"""WITH {_layout()} SELECT doc_id, min(x)::BIGINT AS x, min(y)::BIGINT AS y, (max(x + w) - min(x))::BIGINT AS w, (max(y + h) - min(y))::BIGINT AS h
        FROM toks GROUP BY doc_id""",
    "consecutive_runs": f"""WITH {_layout()}, kept AS (SELECT * FROM toks WHERE regexp_matches(text, '[0-9]')),
        gaps AS (SELECT *, CASE WHEN abs(y - lag(y) OVER (PARTITION BY doc_id ORDER BY y, x, ord)) > 50 THEN 1 ELSE 0 END AS g FROM kept),
        runs AS (SELECT *, sum(g) OVER (PARTITION BY doc_id ORDER BY y, x, ord ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM gaps)
        SELECT doc_id, run, count(*) AS n, min(x)::BIGINT AS x, min(y)::BIGINT AS y, (max(x + w) - min(x))::BIGINT AS w, (max(y + h) - min(y))::BIGINT AS h
        FROM runs GROUP BY doc_id, run HAVING count(*) >= 3""",
    "dictionary_words": f"WITH {_DICTIONARY} SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS rank FROM dictionary",
    "dictionary_hits": f"""WITH {_layout()}, {_SPLIT}, {_DICTIONARY}
        SELECT doc_id, count(*) AS n_hits, count(DISTINCT word) AS n_distinct FROM words WHERE word IN (SELECT word FROM dictionary) GROUP BY doc_id""",
    "seed_detections": _SEEDS,
    "digit_repair": f"""WITH l AS (SELECT doc_id, {_LINE} AS line FROM documents), r AS (SELECT doc_id, line, {_repaired('line')} AS fixed FROM l)
        SELECT doc_id, md5(fixed) AS repaired, fixed <> line AS changed FROM r""",
    "card_candidates": f"""WITH {_candidates('documents')} SELECT doc_id, md5(number) AS number_md5, {_LUHN} AS luhn_ok, {_NETWORK} AS network,
        left(number, 4) || '...' || right(number, 4) AS preview FROM candidates""",
    "card_detections": f"WITH {_cards('documents')} {_CARD_SELECT}",
    "card_detections_orders": f"WITH {_SECRETS}, {_cards('secrets')} {_CARD_SELECT}",
    "crypto_detections": f"""WITH {_SECRETS}, {_layout('secrets')}, {_wallets('secrets')}
        SELECT doc_id, part, confidence, preview, x, y, w, h, network, address_format, address_length FROM wallet_detections""",
    "api_key_matches": f"""WITH {_SECRETS}, both_texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT -doc_id - 1, text FROM secrets), {_key_matches('both_texts')}
        SELECT doc_id, service, description, confidence, md5(match) AS match_md5 FROM keys""",
    "api_key_services": f"WITH {_key_matches('documents')} SELECT service, count(*) AS n_docs FROM keys GROUP BY service",
    "api_key_detections": f"WITH {_KEYS} SELECT doc_id, service, confidence, preview, x, y, w, h FROM key_detections",
    "personal_exact": f"WITH {_personal()} SELECT doc_id, part, confidence, preview, x, y, w, h, {_kind('string')} AS string_type FROM personal_detections",
    "personal_classify": f"""WITH c AS (SELECT c_custkey, {_CUSTOMER_TEXT} AS t FROM customer)
        SELECT c_custkey, {_kind('t')} AS kind, CASE WHEN length(t) <= 4 THEN repeat('*', length(t)) ELSE left(t, 2) || repeat('*', length(t) - 3) || right(t, 1) END AS masked FROM c""",
    "action_threshold": f"{_RAW} SELECT type, action, count(*) AS n FROM raw GROUP BY type, action",
    "scan_summary": f"""{_RAW}, found AS (SELECT doc_id, count(*) AS n, bool_or(action = 'blur') AS b, bool_or(action = 'warn') AS w FROM detections GROUP BY doc_id)
        SELECT d.doc_id, CASE WHEN {_LINE} = '' THEN 0 ELSE len(string_split({_LINE}, ' ')) END::BIGINT AS total_tokens, 5::BIGINT AS detectors_run,
               coalesce(n, 0)::BIGINT AS n_detections, coalesce(b, false) AS has_critical, coalesce(w, false) AS has_warnings
        FROM documents d LEFT JOIN found USING (doc_id)""",
    "scan_top": f"""{_RAW}, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, det_ord) AS rank FROM detections)
        SELECT doc_id, type, confidence, preview FROM ranked WHERE rank = 1 AND action = 'blur'""",
    "iou_pairs": f"""{_RAW}, pairs AS (
            SELECT a.doc_id, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS iw, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS ih,
                   a.w * a.h + b.w * b.h AS total FROM detections a JOIN detections b ON a.doc_id = b.doc_id AND a.det_ord < b.det_ord)
        SELECT doc_id, count(*) AS n_pairs FROM pairs WHERE iw > 0 AND ih > 0 AND iw * ih >= 0.5 * (total - iw * ih) GROUP BY doc_id""",
    "token_overlaps": f"""WITH {_layout()}, wide AS (SELECT doc_id, ord, (x // 2)::BIGINT AS x, y, w * 2 AS w, h FROM toks), pairs AS (
            SELECT a.doc_id, a.ord AS a, b.ord AS b, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS iw, a.h AS ih, a.w * a.h + b.w * b.h AS total
            FROM wide a JOIN wide b ON a.doc_id = b.doc_id AND a.y = b.y AND a.ord < b.ord)
        SELECT doc_id, count(*) AS n_pairs, sum(a)::BIGINT AS sum_a, sum(b)::BIGINT AS sum_b FROM pairs WHERE iw > 0 AND iw * ih >= 0.5 * (total - iw * ih) GROUP BY doc_id""",
    "log_roundtrip": f"""{_RAW} SELECT type, action, '[REDACTED]' AS text, count(*) AS n, sum(y)::BIGINT AS sum_y FROM detections
        WHERE doc_id % 7 <> 3 GROUP BY type, action""",
    "stats_counts": f"""{_RAW} SELECT 'type' AS dimension, type AS name, count(*) AS n FROM detections GROUP BY type
        UNION ALL SELECT 'action', action, count(*) FROM detections GROUP BY action UNION ALL SELECT 'total', 'all', count(*) FROM detections""",
    "detection_rates": f"""{_RAW}, fired AS (SELECT DISTINCT doc_id, true AS fired FROM detections),
        cases AS (SELECT source, toxic = 1 AS positive, coalesce(fired, false) AS fired FROM documents JOIN labels USING (doc_id) LEFT JOIN fired USING (doc_id))
        SELECT source, coalesce(count(*) FILTER (WHERE positive AND fired) / nullif(count(*) FILTER (WHERE positive), 0)::DOUBLE, 0) AS tp_rate,
               coalesce(count(*) FILTER (WHERE NOT positive AND fired) / nullif(count(*) FILTER (WHERE NOT positive), 0)::DOUBLE, 0) AS fp_rate, count(*) AS n_cases
        FROM cases GROUP BY source""",
    "missed_types": f"""{_RAW}, found AS (SELECT doc_id, list(DISTINCT type) AS types FROM detections GROUP BY doc_id),
        cases AS (SELECT doc_id, list_filter([CASE WHEN contains(text, 'token') THEN 'api_key' END, CASE WHEN contains(text, 'License') THEN 'personal_string' END], lambda t: t IS NOT NULL) AS expected,
                         coalesce(types, []) AS types FROM documents LEFT JOIN found USING (doc_id)),
        gone AS (SELECT doc_id, len(expected) AS n, list_sort(list_filter(expected, lambda t: NOT list_contains(types, t))) AS missed FROM cases)
        SELECT doc_id, n::BIGINT AS n_expected, array_to_string(missed, ',') AS missed, len(missed) = 0 AS passed FROM gone""",
    "word_overlap": r"""WITH pairs AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
        sets AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda q: q <> '')) AS a,
                        list_distinct(list_filter(regexp_split_to_array(lower(before), '\s+'), lambda q: q <> '')) AS b FROM pairs WHERE before IS NOT NULL),
        shares AS (SELECT conv_id, turn, CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(a)::DOUBLE END AS overlap FROM sets)
        SELECT conv_id, turn, round(overlap, 9) AS overlap, overlap > 0.8 AS success FROM shares""",
    "percentiles_low": """WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n
            FROM events WHERE value IS NOT NULL)
        SELECT event_type, max(value) FILTER (WHERE i = greatest(floor(n * 0.5) - 1, 0)) AS p50, max(value) FILTER (WHERE i = greatest(floor(n * 0.95) - 1, 0)) AS p95
        FROM o GROUP BY event_type""",
    "percentiles_high": """WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n
            FROM events WHERE value IS NOT NULL),
        p AS (SELECT event_type, max(value) FILTER (WHERE i = least(floor(n * 0.5), n - 1)) AS p50, max(value) FILTER (WHERE i = least(floor(n * 0.95), n - 1)) AS p95,
                     max(value) FILTER (WHERE i = least(floor(n * 0.99), n - 1)) AS p99 FROM o GROUP BY event_type)
        SELECT *, CASE WHEN p95 < 300 THEN 'excellent' WHEN p95 < 500 THEN 'good' ELSE 'marginal' END AS advice, p95 <= 500 AS accepted FROM p""",
    "latency_spread": """SELECT event_type, count(value) AS runs, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max FROM events GROUP BY event_type""",
    "session_totals": f"""{_RAW}, found AS (SELECT doc_id, count(*) AS n FROM detections WHERE type <> 'seed_phrase' GROUP BY doc_id)
        SELECT source, count(*) AS frames, coalesce(sum(n), 0)::BIGINT AS detections FROM documents LEFT JOIN found USING (doc_id) GROUP BY source""",
    "clustered_lines": f"""WITH {_layout()}, d AS (SELECT doc_id, y, abs(y - lag(y) OVER (PARTITION BY doc_id ORDER BY ord)) AS step FROM toks WHERE regexp_matches(text, '[0-9]'))
        SELECT doc_id, coalesce(max(step), 0) <= 50 AS clustered, (max(y) - min(y))::BIGINT AS reach FROM d GROUP BY doc_id""",
    "open_holds": """SELECT user_id, min(ts) AS hold_start, NULL::TIMESTAMP AS hold_end, count(*) AS n_triggers FROM events WHERE event_type = 'error' AND ts IS NOT NULL GROUP BY user_id""",
    "scene_actions": f"""WITH {_HOLDS}, r AS (
            SELECT h.user_id, h.hold_start, h.hold_end, arg_max(e.event_type, e.ts) AS return_scene FROM holds h
            LEFT JOIN events e ON e.user_id = h.user_id AND e.event_type <> 'error' AND e.ts < h.hold_start GROUP BY ALL)
        SELECT user_id, hold_start AS at, 'privacy' AS action, 'privacy' AS scene FROM r
        UNION ALL SELECT user_id, hold_end, 'return', return_scene FROM r WHERE return_scene IS NOT NULL""",
    "frame_gate": """WITH g AS (SELECT conv_id, row_number() OVER o = 1 OR text IS DISTINCT FROM lag(text) OVER o AS changed FROM conversations
            WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
        SELECT conv_id, count(*) AS n_frames, count(*) FILTER (WHERE changed) AS n_changed FROM g GROUP BY conv_id""",
    "frame_sampling": """WITH b AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type, floor(epoch_us(ts) / 3600e6) ORDER BY ts) AS n FROM events)
        SELECT event_type, event_id FROM b WHERE n = 1""",
    "privacy_holds": f"WITH {_HOLDS} SELECT * FROM holds",
    "hold_early_return": f"""WITH {_HOLDS}, cuts AS (
            SELECT h.user_id, h.hold_start, h.hold_end, h.n_triggers, min(m.ts) AS next FROM holds h
            LEFT JOIN events m ON m.user_id = h.user_id AND m.event_type = 'login' AND m.ts >= h.hold_start GROUP BY ALL)
        SELECT user_id, hold_start, least(hold_end, coalesce(next, hold_end)) AS hold_end, n_triggers, next < hold_end AS early FROM cuts""",
    "hold_return_scene": f"""WITH {_HOLDS} SELECT h.user_id, h.hold_start, arg_max(e.event_type, e.ts) AS return_scene FROM holds h
        LEFT JOIN events e ON e.user_id = h.user_id AND e.event_type <> 'error' AND e.ts < h.hold_start GROUP BY h.user_id, h.hold_start""",
    "pause_filter": """WITH s AS (SELECT *, CASE event_type WHEN 'logout' THEN true WHEN 'login' THEN false END AS switch FROM events),
        p AS (SELECT *, coalesce(last_value(switch IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS paused FROM s)
        SELECT user_id, count(*) AS n_events, sum(event_id)::BIGINT AS sum_id FROM p WHERE NOT paused AND switch IS NULL GROUP BY user_id""",
    "ui_states": """SELECT CASE WHEN NOT coalesce(value >= 1, false) THEN 'disconnected' WHEN event_type = 'error' THEN 'alert' WHEN value > 100 THEN 'warn' ELSE 'clean' END AS state,
        count(*) AS n FROM events GROUP BY 1""",
    "running_counts": """WITH r AS (SELECT user_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM events)
        SELECT user_id, max(total)::BIGINT AS total, sum(total)::BIGINT AS area FROM r GROUP BY user_id""",
    "stream_cards": f"WITH {_candidates('documents')} SELECT doc_id, md5(number) AS number_md5 FROM candidates",
}
ORACLES["stream_gate"] = ORACLES["frame_gate"]
