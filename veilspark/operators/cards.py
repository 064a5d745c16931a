"""Payment cards: candidates from text and tokens, checksum, place, nearby hints, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import places

RADIUS = 100
#: What every candidate looks like before the rewrites, none of which changes a length: 16 characters that could be digits
#: in groups of four, or inside one token.
GROUPS = r"(?:[0-9lIOo]{4}(?:\s+|-)?){3}[0-9lIOo]{4}"
LONG_TOKEN, DIGIT = r"\S{16,}+", "[0-9lIOo]"
#: A token that can show four digits.
FOUR = r"(?:[0-9lIOo]-*){4}"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, number): distinct 16-digit candidates of each text, with the columns to ``keep``.

    Candidates come from the joined text, and as windows of the digits inside
    one token. Only texts that match ``GROUPS`` or have a ``LONG_TOKEN`` of so
    many go through the chain of rewrites; no other text has a candidate.
    """
    base = docs.where(_could(text_col)).select(F.col(id_col), *keep, X.one_line(F.col(text_col)).alias("line"))
    return base.select(id_col, *keep, F.explode(_numbers(F.col("line"))).alias("number"))


def _could(text_col: str) -> Column:
    # long tokens are few, and counting in them is far quicker than a pattern that is tried at every place of a text
    in_token = F.exists(F.regexp_extract_all(text_col, F.lit(LONG_TOKEN), F.lit(0)), lambda t: F.regexp_count(t, F.lit(DIGIT)) >= 16)
    return F.col(text_col).rlike(GROUPS) | in_token


def _numbers(line: Column) -> Column:
    """Distinct candidates of a joined text."""
    clean = F.when(line.rlike(GROUPS), X.repair_digits(line)).otherwise("")
    whole = F.transform(F.regexp_extract_all(clean, F.lit(X.CARD_PATTERN), F.lit(0)), lambda m: F.translate(m, " -", ""))
    whole = F.filter(whole, lambda m: m.rlike(r"^\d{16}$"))
    could = F.filter(F.split(line, " "), lambda t: (F.length(t) >= 16) & (F.regexp_count(t, F.lit(DIGIT)) >= 16))
    digits = F.filter(F.transform(could, lambda t: F.regexp_replace(X.repair_digits(t), r"\D", "")), lambda d: F.length(d) >= 16)
    windows = F.flatten(F.transform(digits, lambda d: F.transform(F.sequence(F.lit(1), F.length(d) - 15), lambda i: F.substring(d, i, F.lit(16)))))
    return F.array_distinct(F.concat(whole, windows))


def _luhn(number: Column) -> Column:
    """The checksum of 16 digits, of which the first, third and so on count twice."""
    return F.call_function("luhn_check", number)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per valid number that some token shows a part of; ``part`` orders a document's numbers."""
    line = docs.where(_could(text_col)).select(F.col(id_col), F.col(text_col), X.one_line(F.col(text_col)).alias("line"))
    valid = line.select("*", X.only_if(F.array_sort(F.filter(_numbers(F.col("line")), _luhn)), lambda n: F.size(n) > 0).alias("numbers"))
    shown = F.transform(F.split("line", " "), lambda t: F.when(t.rlike(FOUR), F.translate(X.repair_digits(t), " -", "")).otherwise(""))
    found = places.placed(valid, id_col, text_col, F.col("numbers"), 4, shown=shown, radius=RADIUS, keep=("numbers",))
    found = found.withColumn("number", F.get("numbers", F.col("place").cast("int")))
    found = found.withColumns({"has_expiry": F.col("around").rlike(X.EXPIRY_PATTERN), "has_cvv": F.col("around").rlike(X.CVV_PATTERN)})
    score = F.lit(0.80) + F.when(F.col("has_expiry"), 0.10).otherwise(0.0) + F.when(F.col("has_cvv"), 0.05).otherwise(0.0)
    return found.select(
        id_col,
        "part",
        F.lit("credit_card").alias("type"),
        F.least(score, F.lit(0.95)).alias("confidence"),
        X.ends_preview(F.col("number"), 4).alias("preview"),
        "x", "y", "w", "h",
        F.create_map(
            F.lit("card_length"), F.length("number").cast("string"), F.lit("has_expiry"), F.col("has_expiry").cast("string"),
            F.lit("has_cvv"), F.col("has_cvv").cast("string"), F.lit("card_network"), X.card_network(F.col("number")),
        ).alias("metadata"),
    )
