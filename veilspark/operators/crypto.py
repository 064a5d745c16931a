"""Wallet addresses of three networks, by shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import places

# fixed values: address shapes, in order of priority
PATTERNS = {
    "BTC": (r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b", r"\bbc1[a-z0-9]{39,59}\b"),
    "ETH": (r"\b0x[a-fA-F0-9]{40}\b",),
    "SOL": (r"\b[1-9A-HJ-NP-Za-km-z]{32,44}\b",),
}
#: A run that every shape has; texts without one have no address.
LONG = r"[0-9A-Za-z]{26}"


def _mixed(a: Column) -> Column:
    body = F.substring(a, 3, 40)
    return body.rlike("[A-F]") & body.rlike("[a-f]")


def score(network: Column, a: Column) -> Column:
    """Confidence of an address, null where its length does not fit."""
    n = F.length(a)
    return (
        F.when((network == "BTC") & a.rlike("^[13]") & n.between(26, 35), 0.90)
        .when((network == "BTC") & a.startswith("bc1") & n.between(42, 62), 0.95)
        .when((network == "ETH") & (n == 42), F.when(_mixed(a), 0.95).otherwise(0.85))
        .when((network == "SOL") & n.between(32, 44), 0.80)
    )


def form(network: Column, a: Column) -> Column:
    return (
        F.when((network == "BTC") & a.startswith("bc1"), "bech32")
        .when((network == "BTC") & a.startswith("1"), "P2PKH")
        .when((network == "BTC") & a.startswith("3"), "P2SH")
        .when(network == "ETH", F.when(_mixed(a), "EIP-55").otherwise("standard"))
        .when(network == "SOL", "base58")
        .otherwise("unknown")
    )


def _labelled(network: str, prio: int):
    return lambda a, i: F.struct(F.lit(prio).alias("prio"), i.alias("place"), F.lit(network).alias("network"), a.alias("address"))


def addresses(docs: DataFrame, id_col: str, text_col: str, networks: tuple[str, ...] = ("BTC", "ETH", "SOL")) -> DataFrame:
    """(id, address, network, place): the first network in priority of each distinct address; unknown networks are skipped."""
    line = docs.where(F.col(text_col).rlike(LONG)).select(F.col(id_col), X.one_line(F.col(text_col)).alias("line"))
    all_ = line.select(id_col, F.explode(_every(F.col("line"), networks)).alias("m")).select(id_col, "m.*")
    first = Window.partitionBy(id_col, "address").orderBy("prio", "place")
    return all_.withColumn("rank", F.row_number().over(first)).where("rank = 1").drop("rank")


def _every(line: Column, networks: tuple[str, ...]) -> Column:
    """All addresses of a joined text, in order of priority and place."""
    found = [F.array().cast("array<struct<prio: int, place: int, network: string, address: string>>")]
    for k, n in enumerate(n for n in PATTERNS if n in networks):
        for j, p in enumerate(PATTERNS[n]):
            found.append(F.transform(F.regexp_extract_all(line, F.lit(p), F.lit(0)), _labelled(n, k * 10 + j)))
    return F.concat(*found)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", networks: tuple[str, ...] = ("BTC", "ETH", "SOL")) -> DataFrame:
    """One row per address, under its first network, that some token shows half of; ``part`` orders a document's addresses."""
    some = docs.where(F.col(text_col).rlike(LONG)).withColumn("__line", X.one_line(F.col(text_col)))
    known = F.filter(_every(F.col("__line"), networks), lambda m: score(m["network"], m["address"]).isNotNull())
    some = some.select(F.col(id_col), F.col(text_col), X.only_if(known, lambda m: F.size(m) > 0).alias("found"))
    size = 10  # addresses are longer than 20 characters, so half of one is longer still
    out = places.placed(some, id_col, text_col, F.col("found.address"), size, keep=("found",))
    out = out.withColumn("m", F.get("found", F.col("place").cast("int"))).select(id_col, "part", "m.network", "m.address", "x", "y", "w", "h")
    out = out.withColumn("score", score(F.col("network"), F.col("address")))
    return out.select(
        id_col,
        "part",
        F.lit("crypto_address").alias("type"),
        F.col("score").alias("confidence"),
        X.ends_preview(F.col("address"), 10, 20).alias("preview"),
        "x", "y", "w", "h",
        F.create_map(F.lit("network"), F.col("network"), F.lit("address_format"), form(F.col("network"), F.col("address")), F.lit("address_length"), F.length("address").cast("string")).alias("metadata"),
    )
