"""Registered queries: every declared constraint of the stored tables (V-01 … V-05)
that the fixtures have the columns of, with broken rows in the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as V
from ..sources.fixtures import REPEATED, STORED
from . import queries_series  # noqa: F401  (registers the report that is checked here)
from .oracle_tables import TABLES as SQL_TABLES
from .oracle_tables import with_tables as W
from .queries import holdings_valued
from .registry import REGISTRY, register

SEEDED = ("payment_methods", "asset_types", "transaction_types", "kyc_document_types", "vault_providers")


def stored_tables(fx) -> dict:
    """The stored tables by name; derived ones come from their own operators."""
    out = {name: fx.stored(name) for name in (*STORED, *SEEDED)}
    out["user_holdings"] = holdings_valued(fx)
    for name, query in (("daily_metrics", "daily_metrics"), ("regulatory_reports", "regulatory_report")):
        out[name] = REGISTRY[query].build(fx)
    return out


# The constraints again, as the oracle's own list. Column rules: table, rule, values that break it.
TEXT_LIMITS = """
api_credentials api_key 255, api_secret 255, status 20
asset_types code 20, name 100, purity_standard 20, unit 10
audit_logs entity_type 50, action 50
aml_alerts alert_type 50, status 20
kyc_document_types code 20, name 100
kyc_records verification_status 20
notification_templates template_code 50, template_name 100, subject 255, template_type 20
payment_methods code 20
payment_transactions status 20
regulatory_reports report_type 50, status 20
tenants organization_id 50, company_name 255, contact_person 255, email 255, phone 20, tier 20, status 20
transaction_history new_status 20
transaction_types code 20, name 100
transactions transaction_type 20, asset_type 20, payment_method 50, status 20
user_holdings asset_type 20
user_notifications category 50
users email 255, first_name 100, last_name 100, role 20, kyc_status 20
vault_inventory asset_type 20, status 20
vault_providers code 20, name 100
"""
REQUIRED = """
aml_alerts id
api_credentials id, api_key, api_secret
asset_types id, code, name
audit_logs id
daily_metrics metric_date
kyc_document_types id, code, name
kyc_records id
notification_templates template_code, template_name
payment_methods id, code
payment_transactions amount
tenants id, organization_id, company_name, contact_person, email, phone
transaction_history id
transaction_types id, code, name
transactions id, quantity, price, total_value
user_holdings quantity
user_notifications id
users id, email
vault_inventory weight_grams, purity
vault_providers id, code, name
"""
DOMAINS = [
    ("tenants", "tier", "'lite', 'pro', 'startup', 'growth', 'enterprise'"),
    ("tenants", "status", "'active', 'suspended', 'cancelled'"),
    ("api_credentials", "status", "'active', 'suspended', 'expired'"),
    ("users", "role", "'user', 'admin', 'super_admin'"),
    ("users", "kyc_status", "'pending', 'verified', 'rejected', 'expired'"),
    ("transactions", "status", "'pending', 'processing', 'completed', 'failed', 'cancelled', 'refunded'"),
    ("kyc_records", "verification_status", "'pending', 'processing', 'verified', 'rejected'"),
    ("aml_alerts", "status", "'open', 'investigating', 'resolved', 'dismissed'"),
    ("vault_inventory", "status", "'stored', 'tokenized', 'redeemed', 'transferred'"),
    ("regulatory_reports", "status", "'pending', 'generated', 'submitted'"),
    ("notification_templates", "template_type", "'email', 'sms', 'push', 'in_app'"),
]
UNIQUE_KEYS = [("tenants", "organization_id"), ("api_credentials", "api_key"), ("users", "tenant_id, email"),
               ("asset_types", "code"), ("transaction_types", "code"), ("kyc_document_types", "code"),
               ("vault_providers", "code"), ("daily_metrics", "tenant_id, metric_date")]
REFERENCES = [
    *[(t, "tenant_id", "tenants", "id") for t in (
        "api_credentials", "users", "user_holdings", "transactions", "payment_methods", "payment_transactions",
        "kyc_records", "vault_inventory", "audit_logs", "regulatory_reports", "notification_templates", "daily_metrics")],
    *[(t, "user_id", "users", "id") for t in (
        "user_holdings", "transactions", "kyc_records", "aml_alerts", "audit_logs", "user_notifications")],
    ("user_holdings", "asset_type", "asset_types", "code"), ("transactions", "asset_type", "asset_types", "code"),
    ("vault_inventory", "asset_type", "asset_types", "code"),
    ("transactions", "transaction_type", "transaction_types", "code"),
    ("transaction_history", "transaction_id", "transactions", "id"),
    ("payment_transactions", "transaction_id", "transactions", "id"),
    ("payment_transactions", "payment_method_id", "payment_methods", "id"),
    ("kyc_records", "document_type", "kyc_document_types", "id"),
    ("vault_inventory", "provider_id", "vault_providers", "id"),
]


def _lists(text: str) -> list[tuple[str, str]]:
    return [(line.split(" ", 1)[0], part.strip()) for line in text.strip().splitlines()
            for part in line.split(" ", 1)[1].split(",")]


def _register_derived() -> None:
    """The oracle's view of the derived tables: their own queries' SQL."""
    for name, query in (("daily_metrics", "daily_metrics"), ("regulatory_reports", "regulatory_report")):
        SQL_TABLES[f"stored_{name}"] = ((), f"SELECT * FROM ({REGISTRY[query].oracle}) q")


_register_derived()
STORED_SQL = [f"stored_{n}" for n in (*STORED, *SEEDED, "user_holdings", "daily_metrics", "regulatory_reports")]


def _count(table: str, rule: str, checked: str, bad: str, source: str | None = None) -> str:
    return (f"SELECT '{table}' AS table_name, '{rule}' AS rule, COUNT(*) FILTER (WHERE {checked}) AS checked, "
            f"COUNT(*) FILTER (WHERE {bad}) AS violations FROM {source or f'stored_{table}'}")


COLUMN_SQL = "\nUNION ALL ".join(
    [_count(t, f"{c} not null", "TRUE", f"{c} IS NULL") for t, c in _lists(REQUIRED)]
    + [_count(t, f"{c} in domain", f"{c} IS NOT NULL", f"{c} NOT IN ({v})") for t, c, v in DOMAINS]
    + [_count("users", "kyc_level between 0 and 3", "kyc_level IS NOT NULL", "NOT (kyc_level BETWEEN 0 AND 3)")]
    + [_count(t, f"char_length({c.split()[0]}) <= {c.split()[1]}", f"{c.split()[0]} IS NOT NULL",
              f"length({c.split()[0]}) > {c.split()[1]}") for t, c in _lists(TEXT_LIMITS)])


@register("constraint_columns", "V-03", W(STORED_SQL, COLUMN_SQL))
def _columns(fx):
    return V.column_rule_counts(stored_tables(fx))


def _unique_sql(table: str, key: str) -> str:
    whole = " AND ".join(f"{c} IS NOT NULL" for c in key.split(", "))
    rows = f"(SELECT * FROM stored_{table} UNION ALL SELECT * FROM stored_{table} WHERE {REPEATED.get(table, 'FALSE')})"
    return (f"SELECT '{table}' AS table_name, 'unique ({key})' AS rule, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS checked, "
            f"CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS violations "
            f"FROM (SELECT COUNT(*) AS n FROM {rows} r WHERE {whole} GROUP BY {key}) g")


@register("constraint_unique", "V-04", W(STORED_SQL, "\nUNION ALL ".join(_unique_sql(*u) for u in UNIQUE_KEYS)))
def _unique(fx):
    tables = stored_tables(fx)
    return V.unique_key_counts({n: df.unionByName(df.filter(REPEATED[n])) if n in REPEATED else df
                                for n, df in tables.items()})


def _orphan(c: str, parent: str, key: str) -> str:
    return (f"{c} IS NOT NULL AND CAST({c} AS VARCHAR) NOT IN "
            f"(SELECT CAST({key} AS VARCHAR) FROM stored_{parent} WHERE {key} IS NOT NULL)")


@register("constraint_references", "V-05", W(STORED_SQL, "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c} -> {p}.{k}' AS rule, (SELECT COUNT({c}) FROM stored_{t}) AS checked, "
    f"(SELECT COUNT(*) FROM stored_{t} WHERE {_orphan(c, p, k)}) AS violations" for t, c, p, k in REFERENCES)))
def _reference_counts(fx):
    return V.reference_counts(stored_tables(fx))


@register("orphan_keys", "V-05", W(STORED_SQL, "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c} -> {p}.{k}' AS rule, CAST({c} AS VARCHAR) AS row_key, COUNT(*) AS rows "
    f"FROM stored_{t} WHERE {_orphan(c, p, k)} GROUP BY {c}" for t, c, p, k in REFERENCES)))
def _orphan_keys(fx):
    return V.orphan_keys(stored_tables(fx)).withColumn("rows", F.col("rows").cast("bigint"))
