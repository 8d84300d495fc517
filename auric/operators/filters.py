"""Projection, filter and predicate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# --------------------------------------------------------------------- P-01
def tenant_scope(df: DataFrame, tenant_id) -> DataFrame:
    """Row-level security as a plain predicate; Catalyst pushes it to the scan
    (a partition filter when the table is laid out by tenant, S-05)."""
    return df.filter(F.col("tenant_id") == F.lit(tenant_id))


# --------------------------------------------------------------------- P-02
def active_tenants(tenants: DataFrame) -> DataFrame:
    return tenants.filter(F.col("status") == "active")


def only_active_tenants(df: DataFrame, tenants: DataFrame) -> DataFrame:
    """Fact rows of active tenants (semi join: no tenant columns added)."""
    return df.join(active_tenants(tenants).select("tenant_id"), "tenant_id", "left_semi")


# --------------------------------------------------------------------- P-03
PROFILE_COLUMNS = ("tenant_id", "user_id", "email", "first_name", "last_name", "kyc_status", "role",
                   "created_at")


def profile_projection(users: DataFrame) -> DataFrame:
    """Public profile: identity, names, status; no secrets or ID numbers."""
    return users.select(*PROFILE_COLUMNS)


# --------------------------------------------------------------------- P-04
def tenant_config(tenants: DataFrame) -> DataFrame:
    """Brand fields from the JSON config; ``features`` is ``{}`` when absent."""
    b = F.col("brand_config")
    j = lambda p: F.get_json_object(b, p)
    return tenants.select(
        "tenant_id",
        F.coalesce(j("$.companyName"), F.col("company_name")).alias("display_name"),
        j("$.primaryColor").alias("primary_color"),
        j("$.secondaryColor").alias("secondary_color"),
        j("$.accentColor").alias("accent_color"),
        F.coalesce(j("$.logoUrl"), j("$.logo")).alias("logo"),
        F.coalesce(j("$.features"), F.lit("{}")).alias("features"),
    )


# --------------------------------------------------------------------- P-05
def feature_flag_filter(tenants: DataFrame, flag: str) -> DataFrame:
    return tenants.filter(F.get_json_object(F.col("features_enabled"), f"$.{flag}") == "true")


# --------------------------------------------------------------------- P-06
def feature_tokens_explode(tenants: DataFrame) -> DataFrame:
    """One row per enabled token, payment method and KYC level (one pass)."""
    b = F.col("brand_config")
    strs = lambda p: F.from_json(F.get_json_object(b, p), "array<string>")
    ints = F.from_json(F.get_json_object(b, "$.features.kycLevels"), "array<int>")
    tag = lambda kind, arr: F.transform(F.coalesce(arr, F.array()),
                                        lambda x: F.struct(F.lit(kind).alias("feature"),
                                                           x.cast("string").alias("value")))
    items = F.concat(tag("tokens", strs("$.features.tokens")),
                     tag("paymentMethods", strs("$.features.paymentMethods")),
                     tag("kycLevels", ints))
    return tenants.select("tenant_id", F.explode(items).alias("it")).select("tenant_id", "it.feature", "it.value")


# --------------------------------------------------------------------- P-07
def flag_registrations(incoming: DataFrame, users: DataFrame, keys=("tenant_id", "email"),
                       order=("created_at", "registration_id")) -> DataFrame:
    """Incoming sign-ups with ``is_duplicate``: the unique (tenant, email) key
    is taken by a user, or by an earlier sign-up of the same batch. NULL keys
    never collide, as in a unique index."""
    keys = list(keys)
    taken = users.select(*keys).distinct().withColumn("_taken", F.lit(True))
    first = incoming.dropna(subset=keys).groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    j = incoming.join(taken, keys, "left").join(first, keys, "left")
    dup = F.coalesce(F.col("_taken"), F.lit(False)) | F.coalesce(F.struct(*order) > F.col("_first"), F.lit(False))
    return j.select(*incoming.columns, dup.alias("is_duplicate"))


def duplicate_registration(incoming: DataFrame, users: DataFrame,
                           keys=("tenant_id", "email")) -> tuple[DataFrame, DataFrame]:
    """Split incoming sign-ups into (new, already registered)."""
    f = flag_registrations(incoming, users, keys)
    return (f.filter(~F.col("is_duplicate")).drop("is_duplicate"),
            f.filter(F.col("is_duplicate")).drop("is_duplicate"))


# --------------------------------------------------------------------- P-08
USER_DEFAULTS = {"kyc_status": "pending", "kyc_level": 0, "role": "user"}
TENANT_DEFAULTS = {"tier": "lite", "status": "active"}


def default_fill(df: DataFrame, defaults: dict) -> DataFrame:
    """Column defaults apply to *omitted* columns only (as on INSERT); an
    explicit NULL in a present column stays NULL."""
    out = df
    for c, v in defaults.items():
        if c not in df.columns:
            out = out.withColumn(c, F.lit(v))
    return out
