"""Cases from reviews that the sample tables lack."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from granary.functions import decisions as D
from granary.operators import answers as A
from granary.plans import registry
from tests.oracle import compared

entry._plans()


def planted(spark, tmp_path, **tables):
    """A folder with small tables, and a DuckDB connection that sees the same."""
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    return str(tmp_path), con


def test_claims_keep_the_digits_at_their_ends(spark):
    text = "In 0. 19.37 is so [a.1]. 12 of 2. 3 and 3"
    assert spark.range(1).select(A.claims(F.lit(text))).first()[0] == ["In 0.", "19.37 is so.", "12 of 2.", "3 and 3"]


def test_answer_claims_on_odd_texts(spark, tmp_path):
    draw = random.Random(2)
    signs = ["a", "b1", "0", "12", ".", "!", "?", "।", " ", "  ", "\n", "\t", "\v", "\f", "\r", "\x01", " ", " ", " ", "　", "᠎", "[c:1]", " [d#2]", "[", "|", "\\", "$1"]
    texts = [None, "", " ", ".", "[c]", "1", "0. 1. 2. 3"] + ["".join(draw.choices(signs, k=draw.randrange(1, 30))) for _ in range(1500)]
    sf, con = planted(spark, tmp_path, documents=(list(enumerate(texts)), "doc_id bigint, text string"))
    assert compared(registry.QUERIES["answer_claims"](spark, sf), con, registry.SQL["answer_claims"]) is None


def nodes(df, name):
    """How often an operator is in the plan before execution adapts it."""
    return df._jdf.queryExecution().sparkPlan().toString().count(name)


def test_plots_meet_parcels_without_a_broadcast_of_cells(spark, sf):
    df = registry.QUERIES["plot_snapped"](spark, sf)
    assert nodes(df, "Generate explode") == 2 and nodes(df, "SortMergeJoin [cx") == 1


def test_plot_snapped_on_repeated_and_missing_keys(spark, tmp_path):
    draw = random.Random(5)
    rows = [(draw.choice([None, *range(-300, 300)]), draw.choice([None, *range(1, 51)])) for _ in range(1500)]
    sf, con = planted(spark, tmp_path, part=(rows, "p_partkey bigint, p_size int"))
    assert compared(registry.QUERIES["plot_snapped"](spark, sf), con, registry.SQL["plot_snapped"]) is None


def odd_offers(spark, tmp_path):
    """Customers and parts with missing, repeated, zero, negative, non-finite and boundary values, in few groups."""
    draw = random.Random(7)
    nan, inf = float("nan"), float("inf")
    prices = [None, nan, inf, 0.0, -5.0, 949.99, 950.0, 950.01, 999.9, 1000.0, 1799.99, 1800.0, 1800.01]
    balances = [None, nan, inf, -inf, 0.0, -0.0, -20.0, 1e-320, 950.0, 1000.0, 1800.0, 999.9, 999.9000000000001, 999.8999999999999, 1e300]
    customers = [(draw.choice([None, 3, 503, 4, 1004, -3, 7, *range(500, 520)]), draw.choice(balances + [draw.uniform(-100, 9000)] * 10)) for _ in range(300)]
    parts = [(draw.choice([None, 3, 503, 4, 2004, -3, -503, 9, *range(1000, 1015)]), draw.choice([None, 0, 1, 10, 42, 43, 50, -40]), draw.choice(prices + [round(draw.uniform(900, 1900), 2)] * 10)) for _ in range(300)]
    return planted(spark, tmp_path, customer=(customers, "c_custkey bigint, c_acctbal double"), part=(parts, "p_partkey bigint, p_size int, p_retailprice double"))


@pytest.mark.parametrize("name", ["offer_feasibility", "offer_largest_feasible"])
def test_offers_on_odd_values(spark, tmp_path, name):
    sf, con = odd_offers(spark, tmp_path)
    assert compared(registry.QUERIES[name](spark, sf), con, registry.SQL[name]) is None


def test_offers_settle_products_before_they_meet_customers(spark, sf):
    """No array or lambda is left for a pair."""
    plan = registry.QUERIES["offer_feasibility"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "lambda" not in plan[: plan.index("SortMergeJoin")]


def test_largest_offer_forms_no_pairs(spark, sf):
    df = registry.QUERIES["offer_largest_feasible"](spark, sf)
    assert "Join" not in df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("limit", [0.5, 0.45, 0.1, 1 / 3, 0.65, 1.0, 7.3])
def test_limit_of_a_ratio_is_exact(spark, limit):
    draw = random.Random(11)
    bases = [draw.uniform(1e-3, 1e5) for _ in range(2000)] + [2.0**k for k in range(-20, 40)] + [math.nextafter(2.0**k, s) for k in range(-20, 40) for s in (0, math.inf)] + [round(draw.uniform(0, 1e4), 2) / 10 + 0.001 for _ in range(500)]
    got = spark.createDataFrame([(b,) for b in bases], "b double").select("b", D.most_within(F.col("b"), limit).alias("x")).collect()
    assert all(r.x / r.b <= limit < math.nextafter(r.x, math.inf) / r.b for r in got)


def test_limit_of_an_unknown_ratio(spark):
    rows = spark.createDataFrame([(None,), (0.0,), (-1.0,), (math.nan,), (math.inf,)], "b double").select(D.most_within(F.col("b"), 0.5)).collect()
    assert [r[0] for r in rows] == [None, None, None, None, 1.7976931348623157e308]
