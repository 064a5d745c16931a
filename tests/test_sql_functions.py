import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from veilspark.functions import sql
from veilspark.functions import text as X
from veilspark.operators import api_keys, cards, crypto

TEXTS = ["4111 1111 1111 1111", "a@b.co", "+1 555 1234567", None, "", " ", "12 Main Rd", "lO1l 4O12 8888 8888 1881 O", "6011111111111117", "it's \\d 'quoted'", "Zoë 日本", "x" * 3000, "1" * 40]


@pytest.fixture(scope="module")
def named(spark):
    assert sql.register(spark, "t_")[-1] == "t_scan_text"
    return spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "id long, given string")


@pytest.mark.parametrize(("name", "column"), [("one_line", X.one_line), ("repair_digits", X.repair_digits), ("luhn_ok", X.luhn_ok), ("card_network", X.card_network), ("mask_string", X.mask), ("classify_string", X.classify_personal)])
def test_functions_are_those_of_columns(named, name, column):
    got = {r[0]: r[1] for r in named.selectExpr("id", f"t_{name}(given)").collect()}
    want = {r[0]: r[1] for r in named.select("id", column(F.col("given")).alias("v")).collect()}
    assert got == want or {k: v or None for k, v in got.items()} == {k: v or None for k, v in want.items()}


def test_findings_of_documents(spark, named):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(named.select((-1 - F.col("id")).alias("doc_id"), F.col("given").alias("text")))
    rows = spark.sql("SELECT doc_id, f.* FROM (SELECT doc_id, t_findings(text) AS every FROM {docs}) LATERAL VIEW explode(every) AS f", docs=docs)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    got = sorted((r.doc_id, r.type, r.preview) for r in rows.collect())
    ends = lambda v, n: F.concat(F.left(v, F.lit(n)), F.lit("..."), F.right(v, F.lit(n)))
    want = [(r[0], "credit_card", r[1]) for r in cards.candidates(docs).where(X.luhn_ok(F.col("number"))).select("doc_id", ends("number", 4)).collect()]
    want += [(r[0], "crypto_address", r[1]) for r in crypto.addresses(docs, "doc_id", "text").select("doc_id", ends("address", 10)).collect()]
    want += [(r[0], "api_key", r[1]) for r in api_keys.first_matches(docs).select("doc_id", X.short_preview(F.concat(F.lit("["), "service", F.lit("] "), "description"))).collect()]
    assert got == sorted(want)


def test_table_function_scans_a_text(spark, named):
    got = spark.sql("SELECT * FROM t_scan_text('pay 4111 1111 1111 1111 to 0x52908400098527886E0F7030069857D2E4169EE7, 4111 1111 1111 1111') ORDER BY type, preview").collect()
    assert [r.type for r in got].count("crypto_address") == 1 and ("credit_card", "4111...1111", 0.8, "blur") in [tuple(r) for r in got]
    assert spark.sql("SELECT * FROM t_scan_text(NULL)").count() == 0
    both = spark.sql("SELECT d.id, s.type FROM {d} d, LATERAL t_scan_text(d.given) s", d=named).collect()
    assert {(r.id, r.type) for r in both} == {(0, "credit_card"), (7, "credit_card"), (8, "credit_card")} | {(r.id, r.type) for r in both if r.id > 8}


def test_literals():
    assert sql.literal("it's \\d") == "'it\\'s \\\\d'"
