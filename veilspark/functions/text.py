"""Column functions on text: digit repair, checksums, networks, masks, classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the ordered rewrites of digit look-alikes, (pattern, replacement with $1, $2)
_LOOK_ALIKES = (("I", "1"), ("O", "0"), ("o", "0"))
REPAIR_RULES: tuple[tuple[str, str], ...] = (
    *((r"(\d)l", r"$1\1"), (r"l(\d)", r"1$1"), (r"(1)l", r"$1\1"), (r"l(1)", r"1$1")) * 3,
    (r"(?:\b|(?!\A)\G)l(?=l*\b)", "1"),
    *(rule for a, d in _LOOK_ALIKES for rule in ((rf"(\d[\s\-]*){a}([\s\-]*\d)", rf"$1\{d}$2"), (rf"(\d){a}", rf"$1\{d}"), (rf"{a}(\d)", rf"{d}$1"))),
)
#: Where any of the rules would find something; a text without it stays as it is.
ANY_RULE = r"[lIOo]\d|\d[lIOo]|\bl+\b|\d[\s\-]+[IOo][\s\-]+\d"
CARD_PATTERN = r"\b\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b"
EXPIRY_PATTERN = r"\b(0[1-9]|1[0-2])[\s/\-](20)?\d{2}\b"
CVV_PATTERN = r"(?i)\b(CVV|CVC|CV2)[\s:]?\d{3,4}\b"
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
# fixed values: parts of street names; they match inside words too
ADDRESS_PARTS = ("street", "st", "avenue", "ave", "road", "rd", "lane", "ln", "drive", "dr", "boulevard", "blvd", "way", "court", "ct")
LUHN_LENGTHS = (13, 14, 15, 16, 19)


def one_line(text: Column) -> Column:
    """All tokens of a text joined by single spaces."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def repair_digits(text: Column) -> Column:
    """Letters that stand for digits next to digits become digits; words of only ``l`` become ones."""
    fixed = text
    for pattern, replacement in REPAIR_RULES:
        fixed = F.regexp_replace(fixed, pattern, replacement)
    return F.when(text.rlike(ANY_RULE), fixed).otherwise(text)


def only_if(value: Column, holds) -> Column:
    """Generator of the value where ``holds(value)`` is true, of no row elsewhere.

    A filter on an expensive expression is pushed below the projection that has
    it, which then is worked out twice, and its inputs once for each use; a
    generator stays where it is.
    """
    return F.explode(F.filter(F.array(value), holds))


def luhn_ok(digits: Column) -> Column:
    """Checksum modulo 10 over the digits of a text; false for other lengths than those of cards."""
    only = F.regexp_replace(digits, r"\D", "")
    # from the right, every second digit counts twice
    places = F.sequence(F.lit(1), F.greatest(F.length(only), F.lit(1)))
    values = F.transform(places, lambda i: F.substring(F.reverse(only), i, F.lit(1)).try_cast("long") * F.when(i % 2 == 0, 2).otherwise(1))
    total = F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v))
    return F.length(only).isin(*LUHN_LENGTHS) & F.coalesce(total % 10 == 0, F.lit(False))


def card_network(number: Column) -> Column:
    two, four = F.left(number, F.lit(2)), F.left(number, F.lit(4))
    return (
        F.when(number.startswith("4"), "Visa")
        .when(two.between("51", "55"), "MasterCard")
        .when((two >= "22") & (four <= "2720"), "MasterCard")
        .when(two.isin("34", "37"), "Amex")
        .when((four == "6011") | two.isin("65", "64"), "Discover")
        .otherwise("Unknown")
    )


def short_preview(text: Column, limit: int = 50) -> Column:
    """Previews over ``limit`` characters keep three less and get an ellipsis."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 3)), F.lit("..."))).otherwise(text)


def ends_preview(text: Column, keep: int, over: int = 0) -> Column:
    """First and last ``keep`` characters of a text longer than ``over``."""
    return F.when(F.length(text) > over, F.concat(F.left(text, F.lit(keep)), F.lit("..."), F.right(text, F.lit(keep)))).otherwise(text)


def mask(text: Column) -> Column:
    n = F.length(text)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(text, F.lit(2)), F.repeat(F.lit("*"), n - 3), F.right(text, F.lit(1))))


def classify_personal(text: Column) -> Column:
    digits = F.length(F.regexp_replace(text, r"\D", ""))
    low = F.lower(text)
    street = F.lit(False)
    for part in ADDRESS_PARTS:
        street = street | low.contains(part)
    return (
        F.when(text.rlike(EMAIL_PATTERN), "email")
        .when(text.rlike(r"[\d\-()+\s]{7,}") & digits.between(7, 15), "phone")
        .when(street | text.rlike(r"^\d+\s"), "address")
        .otherwise("name")
    )
