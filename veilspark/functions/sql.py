"""The column functions as SQL functions of a session, and a table function that scans a text.

Bodies are SQL expressions, which Catalyst puts in place of each call: nothing
leaves the JVM, and filters and columns are pushed through them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.cards import DIGIT, GROUPS, LONG_TOKEN
from ..operators.crypto import PATTERNS
from ..operators.pipeline import BLUR, WARN
from ..sources.patterns import BUILT_IN, KeyPattern
from . import text as X


def literal(s: str) -> str:
    """A text as an SQL literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _repair(q: str) -> str:
    for pattern, replacement in X.REPAIR_RULES:
        q = f"regexp_replace({q}, {literal(pattern)}, {literal(replacement)})"
    return q


_LINE = r"btrim(regexp_replace(coalesce(given, ''), '\\s+', ' '))"
_ONLY = r"regexp_replace(given, '\\D', '')"
_STREET = " OR ".join(f"contains(lower(given), {literal(p)})" for p in X.ADDRESS_PARTS)
_ENDS = "left({0}, {1}) || '...' || right({0}, {1})"

#: Name to (result type, body); each takes one text called ``given``, but for detection_action.
SCALARS: dict[str, tuple[str, str]] = {
    "one_line": ("STRING", _LINE),
    "repair_digits": ("STRING", _repair("given")),
    "luhn_ok": (
        "BOOLEAN",
        f"""length({_ONLY}) IN ({", ".join(map(str, X.LUHN_LENGTHS))}) AND coalesce(
            aggregate(
                transform(sequence(1, greatest(length({_ONLY}), 1)), i -> try_cast(substring(reverse({_ONLY}), i, 1) AS BIGINT) * CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END),
                0L, (a, v) -> a + CASE WHEN v > 9 THEN v - 9 ELSE v END) % 10 = 0, false)""",
    ),
    "card_network": (
        "STRING",
        """CASE WHEN startswith(given, '4') THEN 'Visa' WHEN left(given, 2) BETWEEN '51' AND '55' THEN 'MasterCard'
            WHEN left(given, 2) >= '22' AND left(given, 4) <= '2720' THEN 'MasterCard' WHEN left(given, 2) IN ('34', '37') THEN 'Amex'
            WHEN left(given, 4) = '6011' OR left(given, 2) IN ('65', '64') THEN 'Discover' ELSE 'Unknown' END""",
    ),
    "mask_string": ("STRING", "CASE WHEN length(given) <= 4 THEN repeat('*', length(given)) ELSE left(given, 2) || repeat('*', length(given) - 3) || right(given, 1) END"),
    "classify_string": (
        "STRING",
        f"""CASE WHEN given RLIKE {literal(X.EMAIL_PATTERN)} THEN 'email'
            WHEN given RLIKE '[\\\\d\\\\-()+\\\\s]{{7,}}' AND length({_ONLY}) BETWEEN 7 AND 15 THEN 'phone'
            WHEN {_STREET} OR given RLIKE '^\\\\d+\\\\s' THEN 'address' ELSE 'name' END""",
    ),
    "card_numbers": (
        "ARRAY<STRING>",
        f"""CASE WHEN given IS NULL OR NOT (given RLIKE {literal(GROUPS)} OR exists(regexp_extract_all(given, {literal(LONG_TOKEN)}, 0), t -> regexp_count(t, '{DIGIT}') >= 16)) THEN array() ELSE array_distinct(concat(
            filter(transform(regexp_extract_all({_repair(_LINE)}, {literal(X.CARD_PATTERN)}, 0), m -> translate(m, ' -', '')), m -> m RLIKE '^\\\\d{{16}}$'),
            flatten(transform(
                filter(transform(filter(split({_LINE}, ' '), t -> regexp_count(t, '{DIGIT}') >= 16), t -> regexp_replace({_repair("t")}, '\\\\D', '')), d -> length(d) >= 16),
                d -> transform(sequence(1, length(d) - 15), i -> substring(d, i, 16)))))) END""",
    ),
}


def _action(confidence: str) -> str:
    return f"CASE WHEN {confidence} >= {BLUR}D THEN 'blur' WHEN {confidence} >= {WARN}D THEN 'warn' ELSE 'ignore' END"


def _findings(catalog: tuple[KeyPattern, ...], prefix: str) -> str:
    """Array of what a text shows: valid card numbers, wallet addresses under their first network, the first key of each service."""
    line = "line"  # of a lambda around all of it, so that it is joined once for a text
    row = lambda kind, preview, confidence: f"struct({literal(kind)} AS type, {preview} AS preview, {confidence} AS confidence, {_action(confidence)} AS action)"
    # a variable of a higher-order function cannot be given to an SQL function, so the checksum's body stands here
    cards = f"transform(filter({prefix}card_numbers(given), n -> {SCALARS['luhn_ok'][1].replace('given', 'n')}), n -> {row('credit_card', _ENDS.format('n', 4), '0.8D')})"
    own = [f"transform(regexp_extract_all({line}, {literal(p)}, 0), a -> struct({literal(n)} AS network, a AS address))" for n, shapes in PATTERNS.items() for p in shapes]
    every = f"concat({', '.join(own)})"
    first = f"filter({every}, (w, i) -> array_position(transform({every}, v -> v.address), w.address) = i + 1)"
    score = """CASE w.network WHEN 'BTC' THEN CASE WHEN startswith(w.address, 'bc1') THEN 0.95D ELSE 0.9D END
        WHEN 'ETH' THEN CASE WHEN substring(w.address, 3, 40) RLIKE '[A-F]' AND substring(w.address, 3, 40) RLIKE '[a-f]' THEN 0.95D ELSE 0.85D END ELSE 0.8D END"""
    wallets = f"transform({first}, w -> {row('crypto_address', _ENDS.format('w.address', 10), score)})"
    keys = []
    for service in dict.fromkeys(p.service for p in catalog):
        shown = lambda p: literal(s if len(s := f"[{p.service}] {p.description}") <= 50 else f"{s[:47]}...")
        keys.append("CASE " + " ".join(f"WHEN {line} RLIKE {literal(p.pattern)} THEN {row('api_key', shown(p), f'{p.confidence}D')}" for p in catalog if p.service == service) + " END")
    rest = f"concat({wallets}, filter(array({', '.join(keys)}), k -> k IS NOT NULL))"
    return f"concat({cards}, element_at(transform(array({_LINE}), line -> {rest}), 1))"


_ROW = "type STRING, preview STRING, confidence DOUBLE, action STRING"


def statements(prefix: str = "", catalog: tuple[KeyPattern, ...] = BUILT_IN) -> list[str]:
    """CREATE statements of all functions, in an order in which each finds those it calls."""
    head = f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}"
    made = [f"{head}{name}(given STRING) RETURNS {kind} RETURN {body}" for name, (kind, body) in SCALARS.items()]
    made.append(f"{head}detection_action(confidence DOUBLE) RETURNS STRING RETURN {_action('confidence')}")
    made.append(f"{head}findings(given STRING) RETURNS ARRAY<STRUCT<{_ROW}>> RETURN {_findings(catalog, prefix)}")
    made.append(f"{head}scan_text(given STRING) RETURNS TABLE({_ROW}) RETURN SELECT f.* FROM (SELECT explode(every) AS f FROM (SELECT {prefix}findings(given) AS every))")
    return made


def register(spark: SparkSession, prefix: str = "", catalog: tuple[KeyPattern, ...] = BUILT_IN) -> list[str]:
    """Makes the functions known to the session's SQL; returns their names.

    ``SELECT * FROM scan_text('...')`` scans a text; a table is scanned by
    ``SELECT doc_id, f.* FROM (SELECT doc_id, findings(text) AS every FROM
    documents) LATERAL VIEW explode(every) AS f``, which is a projection and
    shuffles nothing. (``LATERAL scan_text(text)`` gives the same rows, but Spark
    scans the distinct texts and joins them back.) They see cards, wallet
    addresses and keys by what the text alone shows: no place, and no hints from
    what stands nearby. Of a null text: nothing.
    """
    for statement in statements(prefix, catalog):
        spark.sql(statement)
    return [f"{prefix}{name}" for name in (*SCALARS, "detection_action", "findings", "scan_text")]
