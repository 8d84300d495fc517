"""Order admission and status.

K-02 (the sell gate with refusals) lives in :mod:`auric.operators.folds`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import dims
from .folds import sell_gate, sell_gate_final  # noqa: F401  (K-02 re-exported)

MONEY = "decimal(15,2)"
KYC_REQUIRED = dims.KYC_REQUIRED_MESSAGE


# --------------------------------------------------------------------- K-01
def kyc_gate(orders: DataFrame, users: DataFrame) -> DataFrame:
    """A BUY is admitted iff the user's kyc_status is 'verified'; a missing
    user or NULL status is refused. Other order types do not check KYC."""
    u = users.select("tenant_id", "user_id", "kyc_status")
    j = orders.join(u, ["tenant_id", "user_id"], "left")
    buy = F.col("transaction_type").eqNullSafe("BUY")
    ok = ~buy | F.coalesce(F.col("kyc_status") == "verified", F.lit(False))
    return j.withColumn("admitted", ok).withColumn(
        "reason", F.when(~ok, F.lit(KYC_REQUIRED))).drop("kyc_status")


# --------------------------------------------------------------------- K-03
def settle_orders(orders: DataFrame, outcomes: DataFrame, key=("tenant_id", "order_id")) -> DataFrame:
    """pending → completed / failed from the payment (or payout) outcomes; an
    order with a completed attempt is completed whatever its failed ones.
    Without an outcome it stays pending; orders not pending are left alone."""
    o = outcomes.groupBy(*key).agg(F.bool_or(F.col("status") == "completed").alias("paid"),
                                   F.bool_or(F.col("status") == "failed").alias("failed"))
    j = orders.join(o, list(key), "left")
    new = F.when(F.col("paid"), "completed").when(F.col("failed"), "failed").otherwise("pending")
    return j.withColumn("settled_status", F.when(F.col("status") == "pending", new).otherwise(F.col("status"))
                        ).drop("paid", "failed").select(*orders.columns, "settled_status")


# --------------------------------------------------------------------- K-04
def apply_kyc_result(users: DataFrame, kyc_records: DataFrame) -> DataFrame:
    """An approved record makes the user 'verified'; other outcomes change
    nothing. The latest approved record (verified_at, record_id) supplies the
    document and time. A partial ``max_by`` aggregate, not a window, so one
    user with very many records is still reduced map-side."""
    status = F.when(F.col("verification_status") == "approved", "verified").otherwise(F.col("verification_status"))
    appr = kyc_records.filter(status == "verified")
    latest = appr.groupBy("tenant_id", "user_id").agg(
        F.max_by(F.struct("document_type", "verified_at"), F.struct("verified_at", "record_id")).alias("r"))
    j = users.join(latest, ["tenant_id", "user_id"], "left")
    return j.select(*[c for c in users.columns if c != "kyc_status"],
                    F.when(F.col("r").isNotNull(), F.lit("verified")).otherwise(F.col("kyc_status")).alias("kyc_status"),
                    F.col("r.document_type").alias("kyc_document"),
                    F.col("r.verified_at").alias("kyc_verified_at"))


# --------------------------------------------------------------------- K-05
def order_value(orders: DataFrame) -> DataFrame:
    """total_value = quantity × price, rounded half up to 2 decimals."""
    return orders.withColumn("total_value", (F.col("quantity") * F.col("price")).cast(MONEY))


# --------------------------------------------------------------------- K-06
def tx_type_rules(tx: DataFrame, tx_types: DataFrame) -> DataFrame:
    """Attach requires_kyc / requires_payment; unknown or inactive types are
    flagged ``type_active = false``. The type table is a fixed seed: broadcast."""
    t = tx_types.select(F.col("code").alias("transaction_type"), "requires_kyc", "requires_payment",
                        F.col("is_active").alias("type_active"))
    j = tx.join(t, "transaction_type", "left")
    return j.withColumn("type_active", F.coalesce(F.col("type_active"), F.lit(False)))


# --------------------------------------------------------------------- K-07
def mandatory_codes() -> list[str]:
    return [code for code, _n, _v, mandatory in dims.KYC_DOC_SEED if mandatory]


def mandatory_docs(users: DataFrame, kyc_records: DataFrame, as_of, mandatory=None,
                   point_in_time: bool = False) -> DataFrame:
    """(tenant, user, document) for every mandatory document the user lacks a
    verified, unexpired record for. The mandatory list is the fixed seed, so
    the user × document expansion is an ``explode`` of a literal array.

    ``point_in_time`` additionally ignores records verified after ``as_of``
    (the default follows the table as stored: status and expiry only)."""
    codes = list(mandatory or mandatory_codes())
    ts = F.lit(as_of).cast("timestamp_ntz")
    ok = (F.col("verification_status") == "verified") & (
        F.col("expires_at").isNull() | (F.col("expires_at") >= ts))  # as K-08: expired only after that moment
    if point_in_time:
        ok = ok & (F.col("verified_at") <= ts)
    valid = kyc_records.filter(ok).select("tenant_id", "user_id", "document_type")
    need = users.select("tenant_id", "user_id",
                        F.explode(F.array(*[F.lit(c) for c in codes])).alias("document_type"))
    return need.join(valid, ["tenant_id", "user_id", "document_type"], "left_anti")


def missing_docs_per_user(missing: DataFrame) -> DataFrame:
    """Arrays per user; bounded by the number of mandatory document types."""
    return missing.groupBy("tenant_id", "user_id").agg(
        F.array_sort(F.collect_list("document_type")).alias("missing"))


# --------------------------------------------------------------------- K-08
def kyc_expiry(kyc_records: DataFrame, as_of) -> DataFrame:
    ts = F.lit(as_of).cast("timestamp_ntz")
    st = (F.when((F.col("verification_status") == "verified") & (F.col("expires_at") < ts), "expired")
          .otherwise(F.col("verification_status")))
    return kyc_records.withColumn("effective_status", st)
