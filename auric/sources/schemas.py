"""The platform's 20 stored tables: column types and constraints.

One line per table. A column is ``name type``; ``!`` marks NOT NULL, a number
in brackets after ``s`` is the longest text. Types: s text, j JSON text, i
integer, b boolean, t timestamp, d date, m(p,s) decimal, a array of text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

# The stored tables' columns.
COLUMNS = {
    "tenants": "id s!, organization_id s(50)!, company_name s(255)!, brand_config j, contact_person s(255)!, "
               "email s(255)!, phone s(20)!, tier s(20), api_credentials j, subscription_details j, "
               "features_enabled j, created_at t, updated_at t, status s(20)",
    "api_credentials": "id s!, tenant_id s, api_key s(255)!, api_secret s(255)!, permissions j, created_at t, "
                       "expires_at t, status s(20)",
    "users": "id s!, tenant_id s, email s(255)!, phone s(20), password_hash s(255)!, first_name s(100), "
             "last_name s(100), date_of_birth d, gender s(10), aadhaar_number s(12), pan_number s(20), role s(20), "
             "kyc_status s(20), kyc_level i, verification_documents j, address j, bank_accounts j, preferences j, "
             "two_factor_enabled b, two_factor_secret s(255), last_login_at t, created_at t, updated_at t",
    "asset_types": "id s!, code s(20)!, name s(100)!, description s, purity_standard s(20), unit s(10), "
                   "current_price m(15,2), price_updated_at t, is_active b, created_at t",
    "user_holdings": "id s!, tenant_id s, user_id s, asset_type s(20), quantity m(20,8)!, "
                     "average_purchase_price m(15,2), current_price m(15,2), total_value m(15,2), "
                     "vault_provider s(50), certificate_number s(100), batch_id s(50), created_at t, updated_at t",
    "transaction_types": "id s!, code s(20)!, name s(100)!, description s, requires_kyc b, requires_payment b, "
                         "is_active b",
    "transactions": "id s!, tenant_id s, user_id s, transaction_type s(20), asset_type s(20), quantity m(20,8)!, "
                    "price m(15,2)!, total_value m(15,2)!, payment_method s(50), payment_reference s(100), "
                    "payment_status s(20), payment_data j, blockchain_tx_hash s(100), status s(20), processed_at t, "
                    "failure_reason s, metadata j, created_at t, updated_at t",
    "transaction_history": "id s!, transaction_id s, previous_status s(20), new_status s(20), changed_by s, "
                           "change_reason s, additional_data j, changed_at t",
    "payment_methods": "id s!, tenant_id s, code s(20)!, name s(100)!, gateway_provider s(50), gateway_config j, "
                       "is_enabled b, fee_percentage m(5,2), fee_fixed m(10,2), min_amount m(15,2), "
                       "max_amount m(15,2), created_at t",
    "payment_transactions": "id s!, tenant_id s, transaction_id s, payment_method_id s, "
                            "gateway_transaction_id s(255), gateway_response j, amount m(15,2)!, currency s(3), "
                            "status s(20), processed_at t, refund_amount m(15,2), failure_reason s, created_at t",
    "kyc_document_types": "id s!, code s(20)!, name s(100)!, description s, verification_required b, "
                          "is_mandatory b, max_file_size i, allowed_formats a, created_at t",
    "kyc_records": "id s!, tenant_id s, user_id s, document_type s, document_number s(50), document_data j, "
                   "address_data j, verification_status s(20), verification_provider s(50), "
                   "verification_response j, verifier_notes s, verified_by s, verified_at t, expires_at t, "
                   "created_at t",
    "aml_alerts": "id s!, tenant_id s, user_id s, transaction_id s, alert_type s(50), risk_score i, description s, "
                  "status s(20), assigned_to s, resolution_notes s, created_at t, resolved_at t",
    "vault_providers": "id s!, code s(20)!, name s(100)!, description s, api_endpoint s(255), api_config j, "
                       "is_active b, certification_standards a, supported_assets a, created_at t",
    "vault_inventory": "id s!, tenant_id s, provider_id s, asset_type s(20), serial_number s(100), "
                       "weight_grams m(10,4)!, purity m(5,4)!, batch_id s(50), certificate_url s(500), "
                       "insurance_value m(15,2), storage_location j, tokenized_amount m(20,8), "
                       "available_amount m(20,8), status s(20), created_at t, updated_at t",
    "audit_logs": "id s!, tenant_id s, user_id s, entity_type s(50), entity_id s, action s(50), old_values j, "
                  "new_values j, ip_address s, user_agent s, session_id s(100), created_at t",
    "regulatory_reports": "id s!, tenant_id s, report_type s(50), reporting_period_start d, "
                          "reporting_period_end d, report_data j, file_path s(500), status s(20), submitted_at t, "
                          "submission_reference s(100), created_at t",
    "notification_templates": "id s!, tenant_id s, template_code s(50)!, template_name s(100)!, subject s(255), "
                              "content s, template_type s(20), is_active b, variables j, created_at t",
    "user_notifications": "id s!, tenant_id s, user_id s, type s(50), category s(50), title s(255), message s, "
                          "data j, is_read b, sent_at t, read_at t, created_at t",
    "daily_metrics": "id s!, tenant_id s, metric_date d!, new_users i, total_users i, active_users i, "
                     "kyc_verified_users i, total_transactions i, buy_transactions i, sell_transactions i, "
                     "total_volume m(15,2), gold_volume m(15,2), silver_volume m(15,2), platinum_volume m(15,2), "
                     "revenue m(15,2), created_at t",
}

# The CHECK constraints (allowed values, or least and greatest).
CHECKS = {
    "tenants": {"tier": ["lite", "pro", "startup", "growth", "enterprise"],
                "status": ["active", "suspended", "cancelled"]},
    "api_credentials": {"status": ["active", "suspended", "expired"]},
    "users": {"role": ["user", "admin", "super_admin"],
              "kyc_status": ["pending", "verified", "rejected", "expired"],
              "kyc_level": (0, 3)},
    "transactions": {"status": ["pending", "processing", "completed", "failed", "cancelled", "refunded"]},
    "kyc_records": {"verification_status": ["pending", "processing", "verified", "rejected"]},
    "aml_alerts": {"risk_score": (0, 100), "status": ["open", "investigating", "resolved", "dismissed"]},
    "vault_inventory": {"status": ["stored", "tokenized", "redeemed", "transferred"]},
    "regulatory_reports": {"status": ["pending", "generated", "submitted"]},
    "notification_templates": {"template_type": ["email", "sms", "push", "in_app"]},
}

# Unique keys beside the id.
UNIQUE = {
    "tenants": [["organization_id"]], "api_credentials": [["api_key"]], "users": [["tenant_id", "email"]],
    "asset_types": [["code"]], "transaction_types": [["code"]], "kyc_document_types": [["code"]],
    "vault_providers": [["code"]], "daily_metrics": [["tenant_id", "metric_date"]],
}

# Foreign keys, child column -> (parent, parent column, rows go with the parent).
# Every table with a tenant_id references tenants and goes with its tenant.
REFERENCES = {
    "user_holdings": {"user_id": ("users", "id", True), "asset_type": ("asset_types", "code", False)},
    "transactions": {"user_id": ("users", "id", True), "transaction_type": ("transaction_types", "code", False),
                     "asset_type": ("asset_types", "code", False)},
    "transaction_history": {"transaction_id": ("transactions", "id", True)},
    "payment_transactions": {"transaction_id": ("transactions", "id", True),
                             "payment_method_id": ("payment_methods", "id", False)},
    "kyc_records": {"user_id": ("users", "id", True), "document_type": ("kyc_document_types", "id", False)},
    "aml_alerts": {"user_id": ("users", "id", True), "transaction_id": ("transactions", "id", True)},
    "vault_inventory": {"provider_id": ("vault_providers", "id", False),
                        "asset_type": ("asset_types", "code", False)},
    "audit_logs": {"user_id": ("users", "id", False)},
    "user_notifications": {"user_id": ("users", "id", True)},
}

_TYPES = {"s": T.StringType(), "j": T.StringType(), "i": T.IntegerType(), "b": T.BooleanType(),
          "t": T.TimestampNTZType(), "d": T.DateType(), "a": T.ArrayType(T.StringType())}


@dataclass
class Table:
    name: str
    schema: T.StructType
    not_null: list[str]
    lengths: dict[str, int]
    checks: dict = field(default_factory=dict)
    unique: list[list[str]] = field(default_factory=list)
    references: dict[str, tuple[str, str, bool]] = field(default_factory=dict)


def _table(name: str) -> Table:
    fields, required, lengths = [], [], {}
    for part in re.split(r",\s*(?![^(]*\))", COLUMNS[name]):
        col, kind, args, bang = re.fullmatch(r"(\w+) (\w)(?:\(([\d,]+)\))?(!?)", part).groups()
        fields.append(T.StructField(col, T.DecimalType(*map(int, args.split(","))) if kind == "m" else _TYPES[kind]))
        if kind == "s" and args:
            lengths[col] = int(args)
        if bang:
            required.append(col)
    refs = dict(REFERENCES.get(name, {}))
    if any(f.name == "tenant_id" for f in fields):
        refs["tenant_id"] = ("tenants", "id", True)
    return Table(name, T.StructType(fields), required, lengths, CHECKS.get(name, {}), UNIQUE.get(name, []), refs)


#: Every stored table by name. Columns are nullable in the Spark schema: NOT
#: NULL is a quality rule here (V-02), not something a file scan enforces.
TABLES: dict[str, Table] = {name: _table(name) for name in COLUMNS}
