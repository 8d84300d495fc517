"""S-02 seed dimensions and small parameter tables.

All of these have a size fixed by construction (a handful of rows), which is
the proven bound that makes ``F.broadcast`` on them safe at any data scale.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the platform's seed rows.
# asset code, name, purity standard, unit, current price per gram
ASSET_SEED = [
    ("GOLD", "24K Gold", "9999", "g", Decimal("6250.00")),
    ("SILVER", "Fine Silver", "999", "g", Decimal("57.00")),
    ("PLATINUM", "Investment Grade Platinum", "9995", "g", Decimal("1230.00")),
]
# transaction type code, name, requires_kyc, requires_payment, is_active
TX_TYPE_SEED = [
    ("BUY", "Purchase Tokens", True, True, True),
    ("SELL", "Sell Tokens", True, True, True),
    ("REDEEM", "Physical Redemption", True, True, True),
    ("TRANSFER", "Token Transfer", True, False, True),
]
# KYC document code, name, verification_required, is_mandatory
KYC_DOC_SEED = [
    ("AADHAAR", "Aadhaar Card", True, True),
    ("PAN", "PAN Card", True, True),
    ("PASSPORT", "Passport", True, False),
    ("DRIVING_LICENSE", "Driving License", True, False),
]
# vault provider code, name, certification standards, supported assets
VAULT_SEED = [
    ("MMTC_PAMP", "MMTC-PAMP", ["LBMA"], ["GOLD", "SILVER"]),
    ("SAFEGOLD", "SafeGold", ["LBMA"], ["GOLD"]),
    ("AUGMONT", "Augmont", ["LBMA"], ["GOLD", "SILVER"]),
]
# Token symbols shown on screens: gold BGT, silver BST, platinum BPT.
TOKEN_SYMBOL = {"GOLD": "BGT", "SILVER": "BST", "PLATINUM": "BPT"}
# Tier user caps from the package sheet (None = unlimited).
TIER_USER_CAP = {"lite": 100, "pro": 1000, "startup": 1000, "growth": 10000, "enterprise": None}
# Setup fee, monthly fee and infrastructure cost per tier from the package sheet (INR).
TIER_PRICE_LIST = [
    ("lite", Decimal("50000"), Decimal("17500"), Decimal("10000")),
    ("pro", Decimal("175000"), Decimal("75000"), Decimal("36000")),
    ("enterprise", Decimal("2500000"), Decimal("350000"), Decimal("63000")),
]
# KYC level transaction caps from the README (None = unlimited).
KYC_LEVEL_CAP_DOC = {0: Decimal("0"), 1: Decimal("50000"), 2: Decimal("1000000"), 3: None}
# Seeded welcome template: code, name, subject, content, type.
WELCOME_TEMPLATE = ("WELCOME_EMAIL", "Welcome Email", "Welcome to {{companyName}}",
                    "Welcome to {{companyName}}! Your account has been created successfully.", "email")
# Refusal message of the buy path when KYC is not verified.
KYC_REQUIRED_MESSAGE = "KYC verification required"
# ---------------------------------------------------------------------------

# Payment method configuration. UPI is the seed row; the others are ours.
# code, is_enabled, fee_percentage, fee_fixed, min_amount, max_amount
PAYMENT_METHOD_ROWS = [
    ("UPI", True, Decimal("0.50"), Decimal("0.00"), Decimal("0.00"), None),
    ("CARD", True, Decimal("2.00"), Decimal("3.00"), Decimal("0.00"), Decimal("40000.00")),
    ("NET_BANKING", True, Decimal("0.00"), Decimal("10.00"), Decimal("0.00"), None),
    ("WALLET", False, Decimal("0.00"), Decimal("0.00"), Decimal("0.00"), None),
]

ASSET_SCHEMA = T.StructType([
    T.StructField("code", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("purity_standard", T.StringType(), True),
    T.StructField("unit", T.StringType(), True),
    T.StructField("current_price", T.DecimalType(15, 2), True),
])
TX_TYPE_SCHEMA = T.StructType([
    T.StructField("code", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("requires_kyc", T.BooleanType(), True),
    T.StructField("requires_payment", T.BooleanType(), True),
    T.StructField("is_active", T.BooleanType(), True),
])
KYC_DOC_SCHEMA = T.StructType([
    T.StructField("code", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("verification_required", T.BooleanType(), True),
    T.StructField("is_mandatory", T.BooleanType(), True),
])
VAULT_SCHEMA = T.StructType([
    T.StructField("code", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("certification_standards", T.ArrayType(T.StringType()), True),
    T.StructField("supported_assets", T.ArrayType(T.StringType()), True),
])
PAYMENT_METHOD_SCHEMA = T.StructType([
    T.StructField("code", T.StringType(), False),
    T.StructField("is_enabled", T.BooleanType(), True),
    T.StructField("fee_percentage", T.DecimalType(5, 2), True),
    T.StructField("fee_fixed", T.DecimalType(10, 2), True),
    T.StructField("min_amount", T.DecimalType(15, 2), True),
    T.StructField("max_amount", T.DecimalType(15, 2), True),
])


def _seed(spark: SparkSession, rows, schema) -> DataFrame:
    """A table of literal rows from this module (a handful): always broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def asset_types(spark: SparkSession) -> DataFrame:
    return _seed(spark, ASSET_SEED, ASSET_SCHEMA)


def transaction_types(spark: SparkSession) -> DataFrame:
    return _seed(spark, TX_TYPE_SEED, TX_TYPE_SCHEMA)


def kyc_document_types(spark: SparkSession) -> DataFrame:
    return _seed(spark, KYC_DOC_SEED, KYC_DOC_SCHEMA)


def vault_providers(spark: SparkSession) -> DataFrame:
    return _seed(spark, VAULT_SEED, VAULT_SCHEMA)


def payment_methods(tenants: DataFrame) -> DataFrame:
    """Payment methods of every tenant. Tenants price them differently: the
    percentage rises by 0.25 with tenant id modulo 3, and every fourth tenant
    (id modulo 4 = 1) has its wallet enabled (the fixture's rule)."""
    m = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name)
                             for v, f in zip(row, PAYMENT_METHOD_SCHEMA)]) for row in PAYMENT_METHOD_ROWS])
    t = F.col("tenant_id")
    pct = F.col("m.fee_percentage") + F.pmod(t, F.lit(3)) * F.lit(Decimal("0.25"))
    wallet = (F.col("m.code") == "WALLET") & (F.pmod(t, F.lit(4)) == 1)
    return tenants.select(t, F.explode(m).alias("m")).select(
        t, F.col("m.code").alias("code"), (F.col("m.is_enabled") | wallet).alias("is_enabled"),
        pct.cast("decimal(5,2)").alias("fee_percentage"), "m.fee_fixed", "m.min_amount", "m.max_amount")


def seed_dims(spark: SparkSession) -> dict[str, DataFrame]:
    """S-02: the seeded dimension tables by name."""
    return {
        "asset_types": asset_types(spark),
        "transaction_types": transaction_types(spark),
        "kyc_document_types": kyc_document_types(spark),
        "vault_providers": vault_providers(spark),
    }


def tier_caps(spark: SparkSession, factor: Decimal | float = 1) -> DataFrame:
    """(tier, user_cap) with caps scaled by ``factor``; NULL = unlimited."""
    rows = [(t, None if c is None else int(c * factor)) for t, c in TIER_USER_CAP.items()]
    return _seed(spark, rows, "tier string, user_cap bigint")


def tier_price_list(spark: SparkSession, rows=None) -> DataFrame:
    return _seed(spark, rows or TIER_PRICE_LIST,
                                 "tier string, setup_fee decimal(15,2), monthly_fee decimal(15,2), "
                                 "monthly_cost decimal(15,2)")


def kyc_level_caps(spark: SparkSession, caps: dict | None = None) -> DataFrame:
    caps = KYC_LEVEL_CAP_DOC if caps is None else caps
    rows = [(int(k), None if v is None else Decimal(v)) for k, v in caps.items()]
    return _seed(spark, rows, "kyc_level int, cap decimal(15,2)")
