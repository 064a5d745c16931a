import re

import pytest
from pyspark.sql import functions as F

from veilspark.functions import fuzzy
from veilspark.functions import text as X


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("raw", "fixed"),
    [("4lll llll llll 1111", "4111 1111 1111 1111"), ("411O", "4110"), ("llll lla l 4lll", "1111 lla 1 4111"), ("xl l", "xl 1"), ("hello", "hello"), ("5I5", "515")],
)
def test_repair(spark, raw, fixed):
    assert one(spark, raw, X.repair_digits) == fixed


@pytest.mark.parametrize(
    ("number", "ok"),
    [("4111111111111111", True), ("5425233430109903", True), ("374245455400126", True), ("4111111111111112", False), ("411111111111", False), ("", False)],
)
def test_luhn(spark, number, ok):
    assert one(spark, number, X.luhn_ok) is ok


@pytest.mark.parametrize(
    ("number", "network"),
    [("4111", "Visa"), ("5100", "MasterCard"), ("2200", "MasterCard"), ("2721", "Unknown"), ("3400", "Amex"), ("6011", "Discover"), ("6500", "Discover"), ("9000", "Unknown")],
)
def test_network(spark, number, network):
    assert one(spark, number, X.card_network) == network


def test_hints():
    assert re.search(X.CVV_PATTERN, "cvv 123") and re.search(X.CVV_PATTERN, "CVC:1234")
    assert not re.search(X.CVV_PATTERN, "CVV: 123")  # one separator at most
    assert re.search(X.EXPIRY_PATTERN, "12/2026") and re.search(X.EXPIRY_PATTERN, "01 26") and not re.search(X.EXPIRY_PATTERN, "13/26")


@pytest.mark.parametrize(
    ("text", "kind"),
    [("a.b@c.de", "email"), ("+1 555-123-4567", "phone"), ("12 Main Road", "address"), ("Christina", "address"), ("John Doe", "name"), ("7 Elm", "address")],
)
def test_classify(spark, text, kind):
    assert one(spark, text, X.classify_personal) == kind


@pytest.mark.parametrize(("text", "masked"), [("Ab", "**"), ("John Doe", "Jo*****e"), ("abcd", "****")])
def test_mask(spark, text, masked):
    assert one(spark, text, X.mask) == masked


def test_preview_is_cut(spark):
    long = "[Cloudflare] Cloudflare API Token (length heuristic)"
    assert one(spark, long, X.short_preview) == long[:47] + "..."


def test_fuzzy():
    assert fuzzy.score("John Doe", "Hello John Doe welcome") == 100
    assert fuzzy.score("John Doe", "meet Jonn Doe today") >= 85
    assert fuzzy.score("John Doe", "the quick brown fox jumps over the lazy dog") < 85
    assert fuzzy.lcs("abcbdab", "bdcaba") == 4


def test_fuzzy_prefilter_loses_nothing(spark):
    import random

    rng = random.Random(2)
    pattern, rows = "john doe smith", []
    for i in range(300):
        p = list(pattern)
        for _ in range(rng.randint(0, 5)):
            p[rng.randrange(len(p))] = rng.choice("abcdefgh ")
        rows.append((i, "x" * rng.randint(0, 30) + " " + "".join(p) + " tail"))
    df = spark.createDataFrame(rows, "doc_id long, line string")
    got = {r.doc_id for r in fuzzy.scored(df, [pattern], "doc_id", "line", 85.0).collect()}
    assert got == {i for i, t in rows if fuzzy.score(pattern, t) >= 85}
