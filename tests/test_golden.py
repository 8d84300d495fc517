"""Golden values from the platform's seeds, screens and package sheet."""

from decimal import Decimal

from pyspark.sql import functions as F

from auric.functions import scalars as X
from auric.operators import holdings as H
from auric.operators import reports as A
from auric.sources import dims


def test_seed_dimensions(spark):
    d = dims.seed_dims(spark)
    prices = {r.code: r.current_price for r in d["asset_types"].collect()}
    assert prices == {"GOLD": Decimal("6250.00"), "SILVER": Decimal("57.00"), "PLATINUM": Decimal("1230.00")}
    tt = {r.code: (r.requires_kyc, r.requires_payment) for r in d["transaction_types"].collect()}
    assert tt["TRANSFER"] == (True, False) and tt["BUY"] == (True, True)
    mand = sorted(r.code for r in d["kyc_document_types"].collect() if r.is_mandatory)
    assert mand == ["AADHAAR", "PAN"]
    v = {r.code: r.supported_assets for r in d["vault_providers"].collect()}
    assert v["SAFEGOLD"] == ["GOLD"]


def test_dashboard_portfolio_figures(spark):
    """2.5 g gold, 500 g silver, 100 g platinum → 15,625 / 28,500 / 1,23,000; total 1,67,125."""
    h = spark.createDataFrame(
        [(1, 1, "GOLD", Decimal("2.5")), (1, 1, "SILVER", Decimal("500")), (1, 1, "PLATINUM", Decimal("100"))],
        "tenant_id long, user_id long, asset_type string, quantity decimal(20,8)")
    v = H.mark_to_market(h, dims.asset_types(spark))
    got = {r.asset_type: r.total_value for r in v.collect()}
    assert got == {"GOLD": Decimal("15625.00"), "SILVER": Decimal("28500.00"), "PLATINUM": Decimal("123000.00")}
    users = spark.createDataFrame([(1, 1)], "tenant_id long, user_id long")
    s = A.portfolio_summary(users, v).select(X.money_inr(F.col("total_value")).alias("t")).first().t
    assert s == "₹1,67,125"


def test_money_inr_and_axis(spark):
    df = spark.createDataFrame([(Decimal("15625"),), (Decimal("167125"),), (Decimal("12345678"),),
                                (Decimal("999"),), (Decimal("1234.50"),), (Decimal("-2500"),)], "v decimal(15,2)")
    got = [r.s for r in df.select(X.money_inr(F.col("v")).alias("s")).collect()]
    assert got == ["₹15,625", "₹1,67,125", "₹1,23,45,678", "₹999", "₹1,234.5", "₹-2,500"]
    ax = [r.a for r in df.select(X.axis_k(F.col("v")).alias("a")).collect()]
    assert ax == ["₹16K", "₹167K", "₹12346K", "₹1K", "₹1K", "₹-2K"]  # JS rounds -2.5 up to -2


def test_js_round_halves_toward_positive_infinity(spark):
    df = spark.createDataFrame([(Decimal("-2.5"),), (Decimal("2.5"),), (Decimal("-2.6"),)], "v decimal(5,1)")
    assert [int(r.r) for r in df.select(X.js_round("v").alias("r")).collect()] == [-2, 3, -3]


def test_activity_text(spark):
    df = spark.createDataFrame([("BUY", Decimal("2.5"), "GOLD"), ("SELL", Decimal("100"), "SILVER")],
                               "t string, q decimal(20,8), a string")
    got = [r.s for r in df.select(X.activity_text(F.col("t"), F.col("q"), F.col("a")).alias("s")).collect()]
    assert got == ["Bought 2.5g Gold BGT", "Sold 100g Silver BST"]


def test_tier_margins(spark):
    """Lite 7,500 (43 %), Pro 39,000 (52 %), Enterprise 2,87,000 (82 %)."""
    tenants = spark.createDataFrame([("lite",), ("pro",), ("enterprise",)], "tier string")
    r = {x.tier: (x.margin, x.margin_pct) for x in A.tier_billing(tenants, dims.tier_price_list(spark)).collect()}
    assert r["lite"] == (Decimal("7500.00"), 43)
    assert r["pro"] == (Decimal("39000.00"), 52)
    assert r["enterprise"] == (Decimal("287000.00"), 82)


def test_render_template(spark):
    df = spark.createDataFrame([("Welcome to {{companyName}}! {{other}}", "Demo Gold Platform")], "t string, n string")
    s = df.select(X.render_template(F.col("t"), {"companyName": F.col("n")}).alias("s")).first().s
    assert s == "Welcome to Demo Gold Platform! {{other}}"
