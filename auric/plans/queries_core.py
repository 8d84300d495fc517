"""Registered queries: filters (P), quality (V), order admission (K) and the
remaining holdings operators (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as P
from ..operators import folds
from ..operators import holdings as H
from ..operators import orders as K
from ..operators import quality as V
from ..sources import dims
from ..sources.fixtures import TX_KEY
from ..sources.schemas import TABLES
from .oracle_tables import with_tables as W
from .queries import AS_OF_KYC, TX_COLS_SQL, D, holdings_valued, tx_cols_sql
from .registry import register

CUT = "2000-01-01 00:00:00"
TOUCH_AS_OF = "2002-01-01 00:00:00"


# ------------------------------------------------------------------ P-01 … P-08
@register("tenant_scope", "P-01", W(["tx"], f"SELECT {TX_COLS_SQL} FROM tx WHERE tenant_id = 7"))
def _p01(fx):
    return P.tenant_scope(fx.tx, 7)


@register("active_tenants", "P-02", W(["tx", "tenants"], f"""
SELECT {TX_COLS_SQL} FROM tx
WHERE tenant_id IN (SELECT tenant_id FROM tenants WHERE status = 'active')"""))
def _p02(fx):
    return P.only_active_tenants(fx.tx, fx.tenants)


@register("profile_projection", "P-03", W(["users"], """
SELECT tenant_id, user_id, email, first_name, last_name, kyc_status, role, created_at FROM users"""))
def _p03(fx):
    return P.profile_projection(fx.users)


@register("tenant_config", "P-04", W(["tenants"], """
SELECT tenant_id,
       COALESCE(json_extract_string(brand_config, '$.companyName'), company_name) AS display_name,
       json_extract_string(brand_config, '$.primaryColor') AS primary_color,
       json_extract_string(brand_config, '$.secondaryColor') AS secondary_color,
       json_extract_string(brand_config, '$.accentColor') AS accent_color,
       COALESCE(json_extract_string(brand_config, '$.logoUrl'), json_extract_string(brand_config, '$.logo')) AS logo,
       COALESCE(CAST(json_extract(brand_config, '$.features') AS VARCHAR), '{}') AS features
FROM tenants"""))
def _p04(fx):
    return P.tenant_config(fx.tenants)


@register("feature_flag_filter", "P-05", W(["tenants"], """
SELECT * FROM tenants WHERE json_extract_string(features_enabled, '$.api_access') = 'true'"""))
def _p05(fx):
    return P.feature_flag_filter(fx.tenants, "api_access")


@register("feature_tokens_explode", "P-06", W(["tenants"], """
SELECT tenant_id, 'tokens' AS feature, unnest(json_extract_string(brand_config, '$.features.tokens[*]')) AS value
FROM tenants WHERE brand_config IS NOT NULL
UNION ALL
SELECT tenant_id, 'paymentMethods', unnest(json_extract_string(brand_config, '$.features.paymentMethods[*]'))
FROM tenants WHERE brand_config IS NOT NULL
UNION ALL
SELECT tenant_id, 'kycLevels', unnest(json_extract_string(brand_config, '$.features.kycLevels[*]'))
FROM tenants WHERE brand_config IS NOT NULL"""))
def _p06(fx):
    return P.feature_tokens_explode(fx.tenants)


@register("duplicate_registration", "P-07", W(["registrations", "users"], """
SELECT r.*, EXISTS (SELECT 1 FROM users u WHERE u.tenant_id = r.tenant_id AND u.email = r.email)
       OR row_number() OVER (PARTITION BY tenant_id, email ORDER BY created_at, registration_id) > 1 AS is_duplicate
FROM registrations r"""))
def _p07(fx):
    return P.flag_registrations(fx.registrations, fx.users)


@register("default_fill", "P-08", W(["registrations"], """
SELECT *, 'pending' AS kyc_status, 0 AS kyc_level, 'user' AS role FROM registrations"""))
def _p08(fx):
    return P.default_fill(fx.registrations, P.USER_DEFAULTS).withColumn("kyc_level", F.col("kyc_level").cast("int"))


# ------------------------------------------------------------------ V-01 … V-07
# Logical table -> (stored table, key columns); checked with broken rows in it.
CHECKED = {
    "tenants": ("tenants", ["tenant_id"]),
    "users": ("users", ["user_id"]),
    "tx": ("transactions", ["order_id", "line_no", "partkey", "suppkey"]),
    "kyc_records": ("kyc_records", ["record_id"]),
    "vault_inventory": ("vault_inventory", ["lot_order_id", "lot_line_no", "lot_partkey", "lot_suppkey"]),
    "aml_alerts": ("aml_alerts", ["id"]),
    "payments": ("payment_transactions", ["order_id"]),
    "notification_templates": ("notification_templates", ["tenant_id"]),
}


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _rules_sql(rules):
    """``rules``: (logical table, rule name, value, condition) -> one UNION ALL query."""
    rows = []
    for name, rule, value, bad in rules:
        table, keys = CHECKED[name]
        key = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
        rows.append(f"SELECT '{table}' AS table_name, '{rule}' AS rule, {key} AS row_key, "
                    f"CAST({value} AS VARCHAR) AS value FROM {name}_faulty WHERE {bad}")
    return "\nUNION ALL ".join(rows)


FAULTY = [f"{n}_faulty" for n in CHECKED]


@register("check_domain", "V-01", W(FAULTY, _rules_sql([
    ("tenants", "tier in domain", "tier", "tier NOT IN ('lite', 'pro', 'startup', 'growth', 'enterprise')"),
    ("tenants", "status in domain", "status", "status NOT IN ('active', 'suspended', 'cancelled')"),
    ("users", "role in domain", "role", "role NOT IN ('user', 'admin', 'super_admin')"),
    ("users", "kyc_status in domain", "kyc_status", "kyc_status NOT IN ('pending', 'verified', 'rejected', 'expired')"),
    ("users", "kyc_level between 0 and 3", "kyc_level", "NOT (kyc_level BETWEEN 0 AND 3)"),
    ("tx", "status in domain", "status",
     "status NOT IN ('pending', 'processing', 'completed', 'failed', 'cancelled', 'refunded')"),
    ("kyc_records", "verification_status in domain", "verification_status",
     "verification_status NOT IN ('pending', 'processing', 'verified', 'rejected')"),
    ("vault_inventory", "status in domain", "status",
     "status NOT IN ('stored', 'tokenized', 'redeemed', 'transferred')"),
    ("aml_alerts", "status in domain", "status", "status NOT IN ('open', 'investigating', 'resolved', 'dismissed')"),
    ("notification_templates", "template_type in domain", "template_type",
     "template_type NOT IN ('email', 'sms', 'push', 'in_app')"),
])))
def _v01(fx):
    return _union([V.check_domain(fx.faulty(n), t, k, {c: r for c, r in V.DOMAIN_RULES[t].items()
                                                       if c in getattr(fx, n).columns})
                   for n, (t, k) in CHECKED.items() if t in V.DOMAIN_RULES])


@register("check_not_null", "V-02", W(FAULTY, _rules_sql(
    [("tenants", f"{c} not null", "NULL", f"{c} IS NULL")
     for c in ("organization_id", "company_name", "contact_person", "email", "phone")]
    + [("users", "email not null", "NULL", "email IS NULL")]
    + [("tx", f"{c} not null", "NULL", f"{c} IS NULL") for c in ("quantity", "price", "total_value")]
    + [("vault_inventory", f"{c} not null", "NULL", f"{c} IS NULL") for c in ("weight_grams", "purity")]
    + [("aml_alerts", "id not null", "NULL", "id IS NULL")]
    + [("payments", "amount not null", "NULL", "amount IS NULL")]
    + [("notification_templates", f"{c} not null", "NULL", f"{c} IS NULL")
       for c in ("template_code", "template_name")])))
def _v02(fx):
    return _union([V.check_not_null(fx.faulty(n), t, k, [c for c in TABLES[t].not_null if c in getattr(fx, n).columns])
                   for n, (t, k) in CHECKED.items()])


@register("check_length", "V-03", W(FAULTY, _rules_sql(
    [("users", f"char_length({c}) <= {n}", c, f"length({c}) > {n}")
     for c, n in (("email", 255), ("first_name", 100), ("last_name", 100), ("role", 20), ("kyc_status", 20))]
    + [("tenants", f"char_length({c}) <= {n}", c, f"length({c}) > {n}")
       for c, n in (("organization_id", 50), ("company_name", 255), ("contact_person", 255), ("email", 255),
                    ("phone", 20), ("tier", 20), ("status", 20))]
    + [("tx", f"char_length({c}) <= {n}", c, f"length({c}) > {n}")
       for c, n in (("transaction_type", 20), ("asset_type", 20), ("payment_method", 50), ("status", 20))]
    + [("notification_templates", f"char_length({c}) <= {n}", c, f"length({c}) > {n}")
       for c, n in (("template_code", 50), ("template_name", 100), ("subject", 255), ("template_type", 20))])))
def _v03(fx):
    names = ("users", "tenants", "tx", "notification_templates")
    return _union([V.check_length(fx.faulty(n), CHECKED[n][0], CHECKED[n][1],
                                  {c: m for c, m in TABLES[CHECKED[n][0]].lengths.items()
                                   if c in getattr(fx, n).columns}) for n in names])


@register("check_unique", "V-04", W(["tx"], """
SELECT order_id, line_no, COUNT(*) AS n FROM tx
WHERE order_id IS NOT NULL AND line_no IS NOT NULL GROUP BY order_id, line_no HAVING COUNT(*) > 1"""))
def _v04(fx):
    return V.check_unique(fx.tx, ["order_id", "line_no"])


@register("check_unique_email", "V-04", W(["registrations"], """
SELECT tenant_id, email, COUNT(*) AS n FROM registrations
WHERE tenant_id IS NOT NULL AND email IS NOT NULL GROUP BY tenant_id, email HAVING COUNT(*) > 1"""))
def _v04b(fx):
    return V.check_unique(fx.registrations, TABLES["users"].unique[0])


@register("check_foreign_key", "V-05", W(["payments", "tx"], """
SELECT order_id, tenant_id, user_id, payment_method, CAST(amount AS DOUBLE) AS amount, status,
       CAST(refund_amount AS DOUBLE) AS refund_amount, created_at
FROM payments p WHERE order_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tx WHERE tx.order_id = p.order_id)"""))
def _v05(fx):
    return V.check_foreign_key(fx.payments, fx.tx, "order_id", "order_id")


@register("check_foreign_key_pair", "V-05", W(["tx_faulty", "users"], """
SELECT tenant_id, user_id, order_id, line_no, partkey, suppkey
FROM tx_faulty t WHERE tenant_id IS NOT NULL AND user_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM users u WHERE u.tenant_id = t.tenant_id AND u.user_id = t.user_id)"""))
def _v05b(fx):
    bad = V.check_foreign_key(fx.faulty("tx"), fx.users, ["tenant_id", "user_id"], ["tenant_id", "user_id"])
    return bad.select("tenant_id", "user_id", "order_id", "line_no", "partkey", "suppkey")


def _cascade_count(name, source, gone):
    return (f"SELECT '{name}' AS table_name, COUNT(*) FILTER (WHERE NOT ({gone})) AS kept, "
            f"COUNT(*) FILTER (WHERE {gone}) AS removed FROM {source}")


_T_GONE = "tenant_id IN (SELECT tenant_id FROM gt)"
_U_GONE = "user_id IN (SELECT user_id FROM gu)"


@register("cascade_delete", "V-06", W(
    ["tenants", "users", "tx", "payments", "kyc_records", "vault_inventory", "audit_logs", "notifications",
     "aml_alerts_fx"], """
, gt AS (SELECT tenant_id FROM tenants WHERE status = 'suspended'),
gu AS (SELECT user_id FROM users WHERE tenant_id IN (SELECT tenant_id FROM gt) OR kyc_status = 'rejected'),
gx AS (SELECT DISTINCT order_id FROM tx WHERE tenant_id IN (SELECT tenant_id FROM gt)
         OR user_id IN (SELECT user_id FROM gu))
""" + "\nUNION ALL ".join([
        _cascade_count("tenants", "tenants", _T_GONE),
        _cascade_count("users", "users", _U_GONE),
        _cascade_count("transactions", "tx", f"{_T_GONE} OR {_U_GONE}"),
        _cascade_count("payment_transactions", "payments",
                       f"{_T_GONE} OR order_id IN (SELECT order_id FROM gx)"),
        _cascade_count("kyc_records", "kyc_records", f"{_T_GONE} OR {_U_GONE}"),
        _cascade_count("vault_inventory", "vault_inventory", _T_GONE),
        _cascade_count("audit_logs", "audit_logs", _T_GONE),
        _cascade_count("user_notifications", "notifications", _U_GONE),
        _cascade_count("aml_alerts", "aml_alerts_fx", _U_GONE)])))
def _v06(fx):
    tables = {"tenants": fx.tenants, "users": fx.users, "transactions": fx.tx, "payment_transactions": fx.payments,
              "kyc_records": fx.kyc_records, "vault_inventory": fx.vault_inventory, "audit_logs": fx.audit_logs,
              "user_notifications": fx.notifications, "aml_alerts": fx.aml_alerts}
    tenant = ("tenants", ["tenant_id"], ["tenant_id"])
    user = ("users", ["user_id"], ["user_id"])
    links = {"tenants": [], "users": [tenant], "transactions": [tenant, user],
             "payment_transactions": [tenant, ("transactions", ["order_id"], ["order_id"])],
             "kyc_records": [tenant, user], "vault_inventory": [tenant], "audit_logs": [tenant],
             "user_notifications": [user], "aml_alerts": [user]}
    gone = {"tenants": fx.tenants.filter(F.col("status") == "suspended").select("tenant_id"),
            "users": fx.users.filter(F.col("kyc_status") == "rejected").select("user_id")}
    return V.cascade_summary(V.cascade_delete(tables, gone, links))


@register("check_total_value", "V-07", W(["tx_faulty"], f"""
SELECT {TX_COLS_SQL}, {D("CAST(quantity * price AS DECIMAL(15,2))")} AS expected_total_value
FROM tx_faulty WHERE CAST(quantity * price AS DECIMAL(15,2)) <> total_value"""))
def _v07(fx):
    return V.check_total_value(fx.faulty("tx"))


# ------------------------------------------------------------------ K-01 … K-08
@register("kyc_gate", "K-01", W(["tx", "users"], f"""
SELECT {tx_cols_sql('x')},
       x.transaction_type IS DISTINCT FROM 'BUY' OR COALESCE(u.kyc_status = 'verified', FALSE) AS admitted,
       CASE WHEN x.transaction_type = 'BUY' AND NOT COALESCE(u.kyc_status = 'verified', FALSE)
            THEN 'KYC verification required' END AS reason
FROM tx x LEFT JOIN users u ON x.tenant_id = u.tenant_id AND x.user_id = u.user_id"""))
def _k01(fx):
    return K.kyc_gate(fx.tx, fx.users)


@register("sell_gate", "K-02", W(["gate_walk", "ledger_seq"], f"""
SELECT s.tenant_id, s.user_id, s.asset_type, s.created_at, s.order_id, s.line_no, s.partkey, s.suppkey, s.ext,
       {D("s.quantity")} AS quantity, s.transaction_type, g.admitted, {D("g.bal")} AS balance
FROM ledger_seq s JOIN gate_walk g
  ON s.tenant_id = g.tenant_id AND s.user_id = g.user_id AND s.asset_type = g.asset_type AND s.rn = g.rn"""))
def _k02(fx):
    return folds.sell_gate(fx.tx)


@register("sell_gate_final", "K-02", W(["gate_walk"], f"""
SELECT g.tenant_id, g.user_id, g.asset_type, {D("max_by(g.bal, g.rn)")} AS final_balance,
       COUNT(*) FILTER (WHERE NOT g.admitted) AS n_rejected
FROM gate_walk g GROUP BY g.tenant_id, g.user_id, g.asset_type"""))
def _k02b(fx):
    return folds.sell_gate_final(fx.tx)


@register("settle_orders", "K-03", W(["tx", "payments"], f"""
SELECT {tx_cols_sql('x')},
       CASE WHEN x.status <> 'pending' THEN x.status WHEN p.paid > 0 THEN 'completed' WHEN p.bad > 0 THEN 'failed'
            WHEN x.status IS NOT NULL THEN 'pending' END AS settled_status
FROM tx x LEFT JOIN (SELECT tenant_id, order_id, count(*) FILTER (WHERE status = 'completed') AS paid,
                            count(*) FILTER (WHERE status = 'failed') AS bad
                     FROM payments GROUP BY tenant_id, order_id) p
  ON x.tenant_id = p.tenant_id AND x.order_id = p.order_id"""))
def _k03(fx):
    return K.settle_orders(fx.tx, fx.payments)


@register("apply_kyc_result", "K-04", W(["users", "kyc_records"], """
SELECT u.user_id, u.tenant_id, u.email, u.first_name, u.last_name, u.kyc_level, u.role, u.created_at,
       CASE WHEN r.user_id IS NOT NULL THEN 'verified' ELSE u.kyc_status END AS kyc_status,
       r.document_type AS kyc_document, r.verified_at AS kyc_verified_at
FROM users u LEFT JOIN (
  SELECT tenant_id, user_id, document_type, verified_at,
         row_number() OVER (PARTITION BY tenant_id, user_id ORDER BY verified_at DESC, record_id DESC) AS rk
  FROM kyc_records WHERE verification_status IN ('verified', 'approved')) r
  ON u.tenant_id = r.tenant_id AND u.user_id = r.user_id AND r.rk = 1"""))
def _k04(fx):
    return K.apply_kyc_result(fx.users, fx.kyc_records)


@register("order_value", "K-05", W(["tx"], f"SELECT {TX_COLS_SQL} FROM tx"))
def _k05(fx):
    return K.order_value(fx.tx.drop("total_value")).select(*fx.tx.columns)


@register("tx_type_rules", "K-06", W(["tx", "transaction_types"], f"""
SELECT {tx_cols_sql('x')},
       t.requires_kyc, t.requires_payment, COALESCE(t.is_active, FALSE) AS type_active
FROM tx x LEFT JOIN transaction_types t ON x.transaction_type = t.code"""))
def _k06(fx):
    return K.tx_type_rules(fx.tx, dims.transaction_types(fx.spark)).select(
        *fx.tx.columns, "requires_kyc", "requires_payment", "type_active")


@register("mandatory_docs", "K-07", W(["users", "kyc_records"], f"""
SELECT u.tenant_id, u.user_id, d.document_type
FROM users u, (VALUES ('AADHAAR'), ('PAN')) d(document_type)
WHERE NOT EXISTS (SELECT 1 FROM kyc_records k
                  WHERE k.tenant_id = u.tenant_id AND k.user_id = u.user_id AND k.document_type = d.document_type
                    AND k.verification_status = 'verified'
                    AND (k.expires_at IS NULL OR k.expires_at >= TIMESTAMP '{AS_OF_KYC}'))"""))
def _k07(fx):
    return K.mandatory_docs(fx.users, fx.kyc_records, AS_OF_KYC)


@register("kyc_expiry", "K-08", W(["kyc_records"], f"""
SELECT *, CASE WHEN verification_status = 'verified' AND expires_at < TIMESTAMP '{AS_OF_KYC}' THEN 'expired'
               ELSE verification_status END AS effective_status
FROM kyc_records"""))
def _k08(fx):
    return K.kyc_expiry(fx.kyc_records, AS_OF_KYC)


# ------------------------------------------------------------------ H-01 … H-08
def _holdings0(fx):
    """Holdings at the cut: the ledger replayed up to it, valued at today's prices."""
    before = fx.tx.filter(F.col("created_at") < F.lit(CUT).cast("timestamp_ntz"))
    return H.mark_to_market(H.holdings_from_ledger(before), dims.asset_types(fx.spark))


def _late(fx, kind):
    return fx.tx.filter((F.col("status") == "completed") & (F.col("transaction_type") == kind)
                        & (F.col("created_at") >= F.lit(CUT).cast("timestamp_ntz")))


LATE_SUM = """(SELECT tenant_id, user_id, asset_type, SUM(quantity) AS q, min(created_at) AS t,
                      arg_max(price, (created_at, order_id, line_no, partkey, suppkey, ext)) AS price
               FROM {} GROUP BY 1, 2, 3)"""


@register("add_tokens", "H-01", W(["holdings0", "late_buys"], f"""
, n AS (SELECT COALESCE(h.tenant_id, b.tenant_id) AS tenant_id, COALESCE(h.user_id, b.user_id) AS user_id,
               COALESCE(h.asset_type, b.asset_type) AS asset_type,
               CAST(COALESCE(h.quantity, 0) + COALESCE(b.q, 0) AS DECIMAL(20,8)) AS quantity,
               COALESCE(h.current_price, b.price) AS current_price, COALESCE(h.created_at, b.t) AS created_at
        FROM holdings0 h FULL OUTER JOIN {LATE_SUM.format("late_buys")} b
          ON h.tenant_id = b.tenant_id AND h.user_id = b.user_id AND h.asset_type = b.asset_type)
SELECT tenant_id, user_id, asset_type, {D("quantity")} AS quantity, {D("current_price")} AS current_price,
       {D("CAST(quantity * current_price AS DECIMAL(15,2))")} AS total_value, created_at FROM n"""))
def _h01(fx):
    return H.add_tokens(_holdings0(fx), _late(fx, "BUY"))


@register("remove_tokens", "H-02", W(["holdings0", "late_sells"], f"""
SELECT h.tenant_id, h.user_id, h.asset_type,
       {D("CAST(h.quantity - COALESCE(s.q, 0) AS DECIMAL(20,8))")} AS quantity,
       {D("h.current_price")} AS current_price,
       {D("CAST(CAST(h.quantity - COALESCE(s.q, 0) AS DECIMAL(20,8)) * h.current_price AS DECIMAL(15,2))")} AS total_value,
       h.created_at
FROM holdings0 h LEFT JOIN
     (SELECT tenant_id, user_id, asset_type, SUM(quantity) AS q FROM late_sells GROUP BY 1, 2, 3) s
  ON h.tenant_id = s.tenant_id AND h.user_id = s.user_id AND h.asset_type = s.asset_type
WHERE h.quantity - COALESCE(s.q, 0) > 0"""))
def _h02(fx):
    return H.remove_tokens(_holdings0(fx), _late(fx, "SELL"))


@register("holding_value", "H-04", W(["holdings", "ledger_seq"], f"""
SELECT h.tenant_id, h.user_id, h.asset_type, {D("h.quantity")} AS quantity, h.created_at,
       {D("p.price")} AS current_price, {D("CAST(h.quantity * p.price AS DECIMAL(15,2))")} AS total_value
FROM holdings h JOIN (SELECT tenant_id, user_id, asset_type, arg_max(price, rn) AS price
                      FROM ledger_seq GROUP BY tenant_id, user_id, asset_type) p
  ON h.tenant_id = p.tenant_id AND h.user_id = p.user_id AND h.asset_type = p.asset_type"""))
def _h04(fx):
    bal = H.ledger_balances(fx.tx, extra=["price"])
    last_price = bal.groupBy(*TX_KEY).agg(
        F.max_by("price", F.struct("created_at", "order_id", "line_no", "partkey", "suppkey", "ext",
                                   "quantity", "transaction_type")).alias("current_price"))
    h = H.join_nullsafe(H.holdings_from_ledger(fx.tx), last_price, TX_KEY)
    return H.holding_value(h)


@register("mark_to_market", "H-05", W(["holdings_valued"], f"""
SELECT tenant_id, user_id, asset_type, {D("quantity")} AS quantity, {D("current_price")} AS current_price,
       {D("total_value")} AS total_value, created_at FROM holdings_valued"""))
def _h05(fx):
    return holdings_valued(fx)


@register("average_cost", "H-06", W(["avg_cost"], f"""
SELECT tenant_id, user_id, asset_type, {D("buy_value")} AS buy_value, {D("buy_quantity")} AS buy_quantity,
       {D("average_purchase_price")} AS average_purchase_price FROM avg_cost"""))
def _h06(fx):
    return H.average_cost(fx.tx)


@register("unrealised_pnl", "H-07", W(["holdings_valued", "avg_cost"], f"""
SELECT h.tenant_id, h.user_id, h.asset_type, {D("h.quantity")} AS quantity, {D("h.total_value")} AS total_value,
       {D("a.average_purchase_price")} AS average_purchase_price,
       {D("CAST(h.quantity * a.average_purchase_price AS DECIMAL(15,2))")} AS cost_basis,
       {D("CAST(h.total_value - CAST(h.quantity * a.average_purchase_price AS DECIMAL(15,2)) AS DECIMAL(15,2))")}
         AS unrealised_pnl,
       {D("CAST(h.total_value - CAST(h.quantity * a.average_purchase_price AS DECIMAL(15,2)) AS DECIMAL(15,2))")}
         / {D("NULLIF(CAST(h.quantity * a.average_purchase_price AS DECIMAL(15,2)), 0)")} * 100.0 AS change_pct
FROM holdings_valued h LEFT JOIN avg_cost a
  ON h.tenant_id = a.tenant_id AND h.user_id = a.user_id AND h.asset_type = a.asset_type"""))
def _h07(fx):
    return H.unrealised_pnl(holdings_valued(fx), H.average_cost(fx.tx))


@register("touch_updated_at", "H-08", W(["holdings0", "late_buys"], f"""
, n AS (
  SELECT COALESCE(h.tenant_id, b.tenant_id) AS tenant_id, COALESCE(h.user_id, b.user_id) AS user_id,
         COALESCE(h.asset_type, b.asset_type) AS asset_type,
         CAST(COALESCE(h.quantity, 0) + COALESCE(b.q, 0) AS DECIMAL(20,8)) AS quantity
  FROM holdings0 h FULL OUTER JOIN {LATE_SUM.format("late_buys")} b
    ON h.tenant_id = b.tenant_id AND h.user_id = b.user_id AND h.asset_type = b.asset_type)
SELECT n.tenant_id, n.user_id, n.asset_type, {D("n.quantity")} AS quantity,
       CASE WHEN o.created_at IS NOT NULL AND n.quantity IS NOT DISTINCT FROM o.quantity THEN o.created_at
            ELSE TIMESTAMP '{TOUCH_AS_OF}' END AS updated_at
FROM n LEFT JOIN holdings0 o
  ON n.tenant_id = o.tenant_id AND n.user_id = o.user_id AND n.asset_type = o.asset_type"""))
def _h08(fx):
    old = _holdings0(fx).withColumnRenamed("created_at", "updated_at")  # untouched since it was opened
    new = H.add_tokens(_holdings0(fx), _late(fx, "BUY")).select(*TX_KEY, "quantity")
    return H.touch_updated_at(old, new, TOUCH_AS_OF)
