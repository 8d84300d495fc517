"""Vault stock, capability and backing and
notification rendering (§2.10.1, N-01)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import render_template


# --------------------------------------------------------------------- U-01
def vault_stock(lots: DataFrame) -> DataFrame:
    return lots.groupBy("provider_code", "asset_type", "status").agg(
        F.count(F.lit(1)).alias("lots"),
        F.sum("weight_grams").alias("weight_grams"),
        F.sum(F.col("weight_grams") * F.col("purity")).alias("fine_weight_grams"),
        F.sum("available_amount").alias("available_amount"),
        F.sum("tokenized_amount").alias("tokenized_amount"),
        F.sum("insurance_value").alias("insured_value"))


# --------------------------------------------------------------------- U-02
def vault_capability(lots: DataFrame, providers: DataFrame, accepted=("LBMA", "LPPM")) -> DataFrame:
    """Lots held by a provider that does not support the metal, or that has no
    accepted certification. Providers are a fixed seed table: broadcast."""
    p = providers.select(F.col("code").alias("provider_code"), "supported_assets", "certification_standards")
    j = lots.join(p, "provider_code", "left")
    supported = F.coalesce(F.array_contains(F.col("supported_assets"), F.col("asset_type")), F.lit(False))
    certified = F.coalesce(F.arrays_overlap(F.col("certification_standards"),
                                            F.array(*[F.lit(a) for a in accepted])), F.lit(False))
    return (j.withColumn("asset_supported", supported).withColumn("certified", certified)
             .filter(~F.col("asset_supported") | ~F.col("certified"))
             .drop("supported_assets", "certification_standards"))


# --------------------------------------------------------------------- U-03
def backing_ratio(holdings: DataFrame, lots: DataFrame) -> DataFrame:
    """Tokens outstanding vs tokenized vault stock per tenant and metal."""
    out = holdings.groupBy("tenant_id", "asset_type").agg(
        F.sum("quantity").cast("decimal(24,8)").alias("tokens_outstanding"))
    vault = lots.groupBy("tenant_id", "asset_type").agg(
        F.sum("tokenized_amount").cast("decimal(24,8)").alias("tokenized_in_vault"))
    j = out.join(vault, ["tenant_id", "asset_type"], "full_outer")
    o = F.coalesce(F.col("tokens_outstanding"), F.lit(0).cast("decimal(24,8)"))
    v = F.coalesce(F.col("tokenized_in_vault"), F.lit(0).cast("decimal(24,8)"))
    return j.select("tenant_id", "asset_type", o.alias("tokens_outstanding"), v.alias("tokenized_in_vault"),
                    F.when(o != 0, v.cast("double") / o.cast("double")).alias("backing_ratio"),
                    (v < o).alias("shortfall"))


# --------------------------------------------------------------------- N-01
def render_notifications(templates: DataFrame, tenants: DataFrame) -> DataFrame:
    """One message per active template and tenant: ``{{companyName}}`` from the
    brand config, else the tenant's company name."""
    t = tenants.select("tenant_id", F.coalesce(F.get_json_object("brand_config", "$.companyName"),
                                               F.col("company_name")).alias("brand_name"))
    j = templates.filter(F.col("is_active")).join(t, "tenant_id")
    vals = {"companyName": F.col("brand_name")}
    return j.select("tenant_id", "template_code", "template_type",
                    render_template(F.col("subject"), vals).alias("subject"),
                    render_template(F.col("content"), vals).alias("content"))
