"""Logical tables written as DuckDB SQL over the fixture views.

This is the independent second derivation used by every oracle query: each
oracle is ``WITH <needed logical tables> <query>``. It is written in plain SQL
from FIXTURES.md §2, not generated from the Spark adapter.
"""

from __future__ import annotations

import re

from ..sources.dims import WELCOME_TEMPLATE
from ..sources.fixtures import FAULTS

# name -> (dependencies, body)
TABLES: dict[str, tuple[tuple[str, ...], str]] = {}


def _t(name, deps, body):
    TABLES[name] = (tuple(deps), body)


_t("tenants", [], """
SELECT CAST(n_nationkey AS BIGINT) AS tenant_id,
       'ORG_' || CAST(n_nationkey AS VARCHAR) AS organization_id,
       n_name AS company_name,
       'Contact ' || n_name AS contact_person,
       lower(n_name) || '@tenant.example' AS email,
       CASE WHEN n_nationkey % 5 = 4 THEN NULL
            ELSE '+91-90000000' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') END AS phone,
       CASE n_regionkey WHEN 0 THEN 'lite' WHEN 1 THEN 'pro' WHEN 2 THEN 'startup'
            WHEN 3 THEN 'growth' WHEN 4 THEN 'enterprise' END AS tier,
       CASE WHEN n_nationkey % 7 = 3 THEN 'suspended' ELSE 'active' END AS status,
       CASE WHEN n_nationkey % 4 = 0 THEN NULL
            WHEN n_nationkey % 4 = 2 THEN
              '{"primaryColor":"#00' || lpad(CAST(n_nationkey * 7 AS VARCHAR), 4, '0')
              || '","secondaryColor":"#00' || lpad(CAST(n_nationkey * 13 AS VARCHAR), 4, '0')
              || '","logo":"' || CAST(n_nationkey AS VARCHAR) || '-logo.png","domain":"t'
              || CAST(n_nationkey AS VARCHAR) || '.tokens.example"}'
            ELSE
              '{"primaryColor":"#00' || lpad(CAST(n_nationkey * 7 AS VARCHAR), 4, '0')
              || '","secondaryColor":"#00' || lpad(CAST(n_nationkey * 13 AS VARCHAR), 4, '0')
              || '","accentColor":"#BF953F","companyName":"' || n_name || ' Gold","logoUrl":"/assets/'
              || CAST(n_nationkey AS VARCHAR) || '-logo.png","features":{"tokens":'
              || CASE n_nationkey % 3 WHEN 0 THEN '["GOLD","SILVER","PLATINUM"]'
                                      WHEN 1 THEN '["GOLD","SILVER"]' ELSE '["GOLD"]' END
              || ',"paymentMethods":'
              || CASE WHEN n_nationkey % 2 = 0 THEN '["UPI","CARD","NET_BANKING"]' ELSE '["UPI","WALLET"]' END
              || ',"kycLevels":[1,2,3],"maxDailyLimit":50000,"supportedLanguages":["en","hi"]}}'
       END AS brand_config,
       '{"api_access":' || CASE WHEN n_regionkey <> 0 THEN 'true' ELSE 'false' END
       || ',"advanced_analytics":' || CASE WHEN n_regionkey >= 2 THEN 'true' ELSE 'false' END
       || ',"custom_branding":' || CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE 'false' END
       || '}' AS features_enabled,
       TIMESTAMP '2000-01-01 00:00:00' + n_nationkey * INTERVAL 1 DAY AS created_at
FROM nation""")

_t("users", [], """
SELECT c_custkey AS user_id,
       CAST(c_nationkey AS BIGINT) AS tenant_id,
       lower(c_name) || '@x.in' AS email,
       split_part(c_name, '#', 1) AS first_name,
       CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL ELSE split_part(c_name, '#', 2) END AS last_name,
       CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD', 'MACHINERY') THEN 'verified'
            WHEN c_mktsegment = 'FURNITURE' THEN 'pending'
            WHEN c_mktsegment = 'AUTOMOBILE' THEN 'rejected' END AS kyc_status,
       CAST(CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD', 'MACHINERY') THEN 1 + c_custkey % 3
                 ELSE 0 END AS INTEGER) AS kyc_level,
       'user' AS role,
       TIMESTAMP '2001-10-01 00:00:00' + CAST(c_custkey % 30 AS INTEGER) * INTERVAL 1 DAY AS created_at
FROM customer""")

_t("users_login", ["users", "tx"], """
SELECT u.*, l.last_login_at
FROM users u LEFT JOIN (SELECT user_id, max(created_at) AS last_login_at FROM tx GROUP BY user_id) l
  ON u.user_id = l.user_id""")

_t("tx", [], """
SELECT CAST(c.c_nationkey AS BIGINT) AS tenant_id,
       o.o_custkey AS user_id,
       l.l_orderkey AS order_id,
       l.l_linenumber AS line_no,
       CASE WHEN l.l_returnflag IN ('N', 'A') THEN 'BUY'
            WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'F' THEN 'SELL'
            WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'O' THEN 'REDEEM' END AS transaction_type,
       CASE WHEN p.p_type IN ('MEDIUM', 'STANDARD') THEN 'GOLD'
            WHEN p.p_type IN ('ECONOMY', 'SMALL') THEN 'SILVER'
            WHEN p.p_type IN ('PROMO', 'LARGE') THEN 'PLATINUM' END AS asset_type,
       CAST(l.l_quantity AS DECIMAL(20,8)) AS quantity,
       CAST(p.p_retailprice AS DECIMAL(15,2)) AS price,
       CAST(CAST(l.l_quantity AS DECIMAL(20,8)) * CAST(p.p_retailprice AS DECIMAL(15,2)) AS DECIMAL(15,2)) AS total_value,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'UPI' WHEN '2-HIGH' THEN 'CARD'
            WHEN '3-MEDIUM' THEN 'NET_BANKING' WHEN '4-NOT SPECIFIED' THEN 'WALLET' END AS payment_method,
       CASE o.o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending'
            WHEN 'P' THEN 'processing' END AS status,
       l.l_shipdate AS created_at,
       l.l_partkey AS partkey,
       l.l_suppkey AS suppkey,
       l.l_extendedprice AS ext,
       l.l_linestatus AS linestatus
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN part p ON l.l_partkey = p.p_partkey""")

_t("first_payments", ["tx"], """
SELECT o.o_orderkey AS order_id,
       CAST(c.c_nationkey AS BIGINT) AS tenant_id,
       o.o_custkey AS user_id,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'UPI' WHEN '2-HIGH' THEN 'CARD'
            WHEN '3-MEDIUM' THEN 'NET_BANKING' WHEN '4-NOT SPECIFIED' THEN 'WALLET' END AS payment_method,
       CAST(COALESCE(lt.ledger_total, 100.00) + CASE WHEN o.o_orderkey % 17 = 0 THEN 1.00 ELSE 0.00 END
            AS DECIMAL(15,2)) AS amount,
       CASE o.o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' WHEN 'P' THEN 'pending' END AS status,
       CAST(CASE WHEN o.o_orderkey % 23 = 0 THEN 5.00 ELSE 0.00 END AS DECIMAL(15,2)) AS refund_amount,
       o.o_orderdate AS created_at
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN (SELECT order_id, sum(total_value) AS ledger_total FROM tx GROUP BY order_id) lt
  ON o.o_orderkey = lt.order_id
WHERE o.o_orderkey % 10 <> 0""")

_t("payments", ["first_payments"], """
SELECT * FROM first_payments
UNION ALL
SELECT order_id, tenant_id, user_id, payment_method, amount, 'failed', CAST(0 AS DECIMAL(15,2)), created_at
FROM first_payments WHERE order_id % 13 = 0""")

_t("kyc_records", [], """
SELECT o.o_orderkey AS record_id,
       CAST(c.c_nationkey AS BIGINT) AS tenant_id,
       o.o_custkey AS user_id,
       CASE o.o_orderkey % 4 WHEN 0 THEN 'AADHAAR' WHEN 1 THEN 'PAN' WHEN 2 THEN 'PASSPORT'
            ELSE 'DRIVING_LICENSE' END AS document_type,
       CASE o.o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'rejected' ELSE 'pending' END
         AS verification_status,
       o.o_orderdate AS verified_at,
       o.o_orderdate + INTERVAL 3 YEAR AS expires_at
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")

_t("vault_inventory", ["tx"], """
SELECT order_id AS lot_order_id, line_no AS lot_line_no, partkey AS lot_partkey, suppkey AS lot_suppkey,
       tenant_id,
       CASE suppkey % 3 WHEN 0 THEN 'MMTC_PAMP' WHEN 1 THEN 'SAFEGOLD' ELSE 'AUGMONT' END AS provider_code,
       asset_type,
       CAST(quantity AS DECIMAL(10,4)) AS weight_grams,
       CAST(CASE asset_type WHEN 'GOLD' THEN 0.9999 WHEN 'SILVER' THEN 0.9990 ELSE 0.9995 END AS DECIMAL(5,4)) AS purity,
       CAST(quantity * 0.6 AS DECIMAL(20,8)) AS tokenized_amount,
       CAST(quantity * 0.4 AS DECIMAL(20,8)) AS available_amount,
       total_value AS insurance_value,
       'stored' AS status
FROM tx WHERE linestatus = 'O'""")

_t("transaction_history", [], """
SELECT event_id AS id, user_id AS transaction_id,
       CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing'
            WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'cancelled' END
         AS new_status,
       ts AS changed_at
FROM events""")

_t("audit_logs", [], """
SELECT e.event_id AS id, CAST(c.c_nationkey AS BIGINT) AS tenant_id, e.user_id,
       CASE WHEN e.event_type = 'signup' THEN 'USER' WHEN e.event_type = 'purchase' THEN 'TRANSACTION'
            ELSE 'SESSION' END AS entity_type,
       e.event_type AS action,
       lag(e.props) OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS old_values,
       e.props AS new_values,
       e.ts AS created_at
FROM events e JOIN customer c ON e.user_id = c.c_custkey""")

_t("notifications", [], """
SELECT event_id AS id, user_id, event_type AS category,
       CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 AS is_read,
       ts AS created_at
FROM events""")

_t("aml_alerts_fx", [], """
SELECT event_id AS id, user_id,
       CASE event_type WHEN 'error' THEN 'SUSPICIOUS_PATTERN' WHEN 'purchase' THEN 'HIGH_AMOUNT'
            WHEN 'signup' THEN 'PEP_MATCH' WHEN 'view' THEN 'KYC_LIMIT' WHEN 'click' THEN 'DAILY_LIMIT' END
         AS alert_type,
       CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 THEN 'resolved'
            WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 = 0 THEN 'investigating'
            ELSE 'open' END AS status,
       ts AS created_at,
       CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0
            THEN ts + CAST(json_extract_string(props, '$.k') AS INTEGER) * INTERVAL 1 HOUR END AS resolved_at
FROM events""")

_t("web_events", [], """
SELECT event_id, user_id,
       CASE WHEN event_type = 'click' AND CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 = 0 THEN 'cta'
            WHEN event_type = 'view' THEN 'landing' WHEN event_type = 'click' THEN 'pricing'
            WHEN event_type = 'signup' THEN 'form' WHEN event_type = 'purchase' THEN 'paid' END AS step,
       ts
FROM events WHERE event_type <> 'error'""")

_t("requests", [], "SELECT user_id AS client, ts, event_id FROM events")

_t("ticks", [], """
SELECT CASE user_id % 3 WHEN 0 THEN 'GOLD' WHEN 1 THEN 'SILVER' ELSE 'PLATINUM' END AS asset_type,
       ts, CAST(value AS DECIMAL(15,2)) AS price, event_id
FROM events WHERE event_type = 'view'""")

_t("trades", [], """
SELECT CASE user_id % 3 WHEN 0 THEN 'GOLD' WHEN 1 THEN 'SILVER' ELSE 'PLATINUM' END AS asset_type,
       ts, event_id, user_id
FROM events WHERE event_type = 'purchase'""")

_t("watchlist", [], "SELECT c_name AS name FROM customer WHERE c_acctbal < -900")

_t("price_thresholds", [], """
SELECT c_custkey AS user_id,
       CASE c_custkey % 3 WHEN 0 THEN 'GOLD' WHEN 1 THEN 'SILVER' ELSE 'PLATINUM' END AS asset_type,
       CAST(100 + (c_custkey % 10) * 30 AS DECIMAL(15,2)) AS threshold
FROM customer""")

_t("notification_templates", ["tenants"], """
SELECT tenant_id, '{0}' AS template_code, '{1}' AS template_name, '{2}' AS subject, '{3}' AS content,
       '{4}' AS template_type, tenant_id % 6 <> 0 AS is_active
FROM tenants""".format(*WELCOME_TEMPLATE))

_t("registrations", [], """
SELECT o.o_orderkey AS registration_id, CAST(c.c_nationkey AS BIGINT) AS tenant_id,
       CASE WHEN o.o_orderkey % 5 = 0 THEN 'new_' || CAST(o.o_orderkey AS VARCHAR) || '@x.in'
            ELSE lower(c.c_name) || '@x.in' END AS email,
       split_part(c.c_name, '#', 1) AS first_name,
       o.o_orderdate AS created_at
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")

# Seed dimensions as VALUES lists (same fixed values as auric.sources.dims).
_t("asset_types", [], """
SELECT * FROM (VALUES ('GOLD', '24K Gold', '9999', 'g', CAST(6250.00 AS DECIMAL(15,2))),
                      ('SILVER', 'Fine Silver', '999', 'g', CAST(57.00 AS DECIMAL(15,2))),
                      ('PLATINUM', 'Investment Grade Platinum', '9995', 'g', CAST(1230.00 AS DECIMAL(15,2))))
  AS a(code, name, purity_standard, unit, current_price)""")

_t("transaction_types", [], """
SELECT * FROM (VALUES ('BUY', 'Purchase Tokens', TRUE, TRUE, TRUE),
                      ('SELL', 'Sell Tokens', TRUE, TRUE, TRUE),
                      ('REDEEM', 'Physical Redemption', TRUE, TRUE, TRUE),
                      ('TRANSFER', 'Token Transfer', TRUE, FALSE, TRUE))
  AS t(code, name, requires_kyc, requires_payment, is_active)""")

_t("kyc_document_types", [], """
SELECT * FROM (VALUES ('AADHAAR', TRUE), ('PAN', TRUE), ('PASSPORT', FALSE), ('DRIVING_LICENSE', FALSE))
  AS d(code, is_mandatory)""")

_t("vault_providers", [], """
SELECT * FROM (VALUES ('MMTC_PAMP', ['LBMA'], ['GOLD', 'SILVER']),
                      ('SAFEGOLD', ['LBMA'], ['GOLD']),
                      ('AUGMONT', ['LBMA'], ['GOLD', 'SILVER']))
  AS v(code, certification_standards, supported_assets)""")

_t("payment_methods", ["tenants"], """
SELECT t.tenant_id, code, is_enabled OR (code = 'WALLET' AND t.tenant_id % 4 = 1) AS is_enabled,
       CAST(fee_percentage + 0.25 * (t.tenant_id % 3) AS DECIMAL(5,2)) AS fee_percentage,
       CAST(fee_fixed AS DECIMAL(10,2)) AS fee_fixed, CAST(min_amount AS DECIMAL(15,2)) AS min_amount,
       CAST(max_amount AS DECIMAL(15,2)) AS max_amount
FROM (VALUES ('UPI', TRUE, 0.50, 0.00, 0.00, NULL),
             ('CARD', TRUE, 2.00, 3.00, 0.00, 40000.00),
             ('NET_BANKING', TRUE, 0.00, 10.00, 0.00, NULL),
             ('WALLET', FALSE, 0.00, 0.00, 0.00, NULL))
  AS m(code, is_enabled, fee_percentage, fee_fixed, min_amount, max_amount), tenants t""")

# Holdings by ordered replay, written as a recursive walk over each key's
# completed BUY/SELL history (independent of the window closed form).
_t("ledger_seq", ["tx"], """
SELECT tenant_id, user_id, asset_type, transaction_type, quantity, price, created_at, order_id, line_no,
       partkey, suppkey, ext,
       row_number() OVER (PARTITION BY tenant_id, user_id, asset_type
                          ORDER BY created_at, order_id, line_no, partkey, suppkey, ext, quantity,
                                   transaction_type) AS rn
FROM tx WHERE status = 'completed' AND transaction_type IN ('BUY', 'SELL')""")

_t("ledger_walk", ["ledger_seq"], """
SELECT * FROM (
  WITH RECURSIVE walk(tenant_id, user_id, asset_type, rn, bal, created_at) AS (
    SELECT tenant_id, user_id, asset_type, rn,
           CAST(CASE WHEN transaction_type = 'BUY' THEN quantity ELSE 0 END AS DECIMAL(20,8)),
           created_at
    FROM ledger_seq WHERE rn = 1
    UNION ALL
    SELECT s.tenant_id, s.user_id, s.asset_type, s.rn,
           CAST(GREATEST(0, w.bal + CASE WHEN s.transaction_type = 'BUY' THEN s.quantity ELSE -s.quantity END)
                AS DECIMAL(20,8)),
           s.created_at
    FROM walk w JOIN ledger_seq s
      ON s.tenant_id = w.tenant_id AND s.user_id = w.user_id AND s.asset_type = w.asset_type
     AND s.rn = w.rn + 1
  ) SELECT * FROM walk) x""")

_t("holdings", ["ledger_walk"], """
SELECT w.tenant_id, w.user_id, w.asset_type, w.bal AS quantity,
       (SELECT min(w2.created_at) FROM ledger_walk w2
         WHERE w2.tenant_id = w.tenant_id AND w2.user_id = w.user_id AND w2.asset_type = w.asset_type
           AND w2.rn > COALESCE((SELECT max(w3.rn) FROM ledger_walk w3
                                  WHERE w3.tenant_id = w.tenant_id AND w3.user_id = w.user_id
                                    AND w3.asset_type = w.asset_type AND w3.bal = 0), 0)) AS created_at
FROM ledger_walk w
JOIN (SELECT tenant_id, user_id, asset_type, max(rn) AS last_rn FROM ledger_walk
      GROUP BY tenant_id, user_id, asset_type) m
  ON w.tenant_id = m.tenant_id AND w.user_id = m.user_id AND w.asset_type = m.asset_type AND w.rn = m.last_rn
WHERE w.bal > 0""")

_t("holdings_valued", ["holdings", "asset_types"], """
SELECT h.*, a.current_price, CAST(h.quantity * a.current_price AS DECIMAL(15,2)) AS total_value
FROM holdings h LEFT JOIN asset_types a ON h.asset_type = a.code""")


_t("api_credentials", [], """
SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(s_nationkey AS BIGINT) AS tenant_id,
       'ak_' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS api_key,
       'as_' || sha256(CAST(s_suppkey AS VARCHAR)) AS api_secret,
       CASE s_suppkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'suspended' ELSE 'expired' END AS status
FROM supplier""")

for _name, (_key, _faults) in FAULTS.items():
    _src = {"aml_alerts": "aml_alerts_fx"}.get(_name, _name)
    _cols = ", ".join(f"CASE WHEN {_key} % {_n} = 0 THEN {_bad} ELSE {_c} END AS {_c}"
                      for _c, (_n, _bad) in _faults.items())
    _t(f"{_name}_faulty", [_src], f"SELECT * REPLACE ({_cols}) FROM {_src}")


# The stored tables under their own column names, with the broken rows.
for _name, _src, _renamed in (
        ("tenants", "tenants_faulty", "* RENAME (tenant_id AS id)"), ("api_credentials", "api_credentials_faulty", "*"),
        ("users", "users_faulty", "* RENAME (user_id AS id)"), ("transactions", "tx_faulty", "* RENAME (order_id AS id)"),
        ("transaction_history", "transaction_history_faulty", "*"),
        ("payment_transactions", "payments_faulty",
         "* RENAME (order_id AS transaction_id, payment_method AS payment_method_id)"),
        ("kyc_records", "kyc_records_faulty", "* RENAME (record_id AS id)"), ("aml_alerts", "aml_alerts_faulty", "*"),
        ("vault_inventory", "vault_inventory_faulty", "* RENAME (provider_code AS provider_id)"),
        ("audit_logs", "audit_logs_faulty", "*"), ("user_notifications", "notifications_faulty", "*"),
        ("notification_templates", "notification_templates_faulty", "*"),
        ("payment_methods", "payment_methods", "*, code AS id"), ("asset_types", "asset_types", "*, code AS id"),
        ("transaction_types", "transaction_types", "*, code AS id"),
        ("kyc_document_types", "kyc_document_types",
         "*, code AS id, CASE code WHEN 'AADHAAR' THEN 'Aadhaar Card' WHEN 'PAN' THEN 'PAN Card' "
         "WHEN 'PASSPORT' THEN 'Passport' ELSE 'Driving License' END AS name"),
        ("vault_providers", "vault_providers",
         "*, code AS id, CASE code WHEN 'MMTC_PAMP' THEN 'MMTC-PAMP' WHEN 'SAFEGOLD' THEN 'SafeGold' ELSE 'Augmont' END AS name"), ("user_holdings", "holdings_valued", "*")):
    _t(f"stored_{_name}", [_src], f"SELECT {_renamed} FROM {_src}")


def with_tables(names, query: str) -> str:
    """``WITH`` prefix holding ``names`` and their dependencies, then ``query``."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in TABLES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return query
    ctes = ",\n".join(f"{n} AS ({TABLES[n][1].strip()})" for n in order)
    return f"WITH {ctes}\n{query.strip()}"


_t("gate_walk", ["ledger_seq"], """
SELECT * FROM (
  WITH RECURSIVE g(tenant_id, user_id, asset_type, rn, bal, admitted) AS (
    SELECT tenant_id, user_id, asset_type, rn,
           CAST(CASE WHEN transaction_type = 'BUY' THEN quantity ELSE 0 END AS DECIMAL(20,8)),
           transaction_type = 'BUY'
    FROM ledger_seq WHERE rn = 1
    UNION ALL
    SELECT s.tenant_id, s.user_id, s.asset_type, s.rn,
           CAST(CASE WHEN s.transaction_type = 'BUY' THEN g.bal + s.quantity
                     WHEN g.bal > 0 AND g.bal >= s.quantity THEN g.bal - s.quantity
                     ELSE g.bal END AS DECIMAL(20,8)),
           s.transaction_type = 'BUY' OR (g.bal > 0 AND g.bal >= s.quantity)
    FROM g JOIN ledger_seq s
      ON s.tenant_id = g.tenant_id AND s.user_id = g.user_id AND s.asset_type = g.asset_type
     AND s.rn = g.rn + 1
  ) SELECT * FROM g) x""")

# The same replay over the ledger before the cut.
_t("tx0", ["tx"], "SELECT * FROM tx WHERE created_at < TIMESTAMP '2000-01-01 00:00:00'")
for _n, _parent in (("ledger_seq", "tx"), ("ledger_walk", "ledger_seq"), ("holdings", "ledger_walk")):
    _t(f"{_n}0" if _n != "holdings" else "replayed0", [f"{_parent}0"],
       re.sub(rf"\b{_parent}\b", f"{_parent}0", TABLES[_n][1]))
_t("holdings0", ["replayed0", "asset_types"], """
SELECT h.*, a.current_price FROM replayed0 h LEFT JOIN asset_types a ON h.asset_type = a.code""")

_t("late_buys", ["tx"], """
SELECT * FROM tx WHERE status = 'completed' AND transaction_type = 'BUY'
  AND created_at >= TIMESTAMP '2000-01-01 00:00:00'""")

_t("late_sells", ["tx"], """
SELECT * FROM tx WHERE status = 'completed' AND transaction_type = 'SELL'
  AND created_at >= TIMESTAMP '2000-01-01 00:00:00'""")

_t("avg_cost", ["tx"], """
SELECT tenant_id, user_id, asset_type, bv AS buy_value, bq AS buy_quantity,
       CAST(CAST((2 * CAST(CAST(bv AS DECIMAL(38,2)) * 100 AS HUGEINT) * 100000000
                  + CAST(CAST(bq AS DECIMAL(38,8)) * 100000000 AS HUGEINT))
                 // (2 * CAST(CAST(bq AS DECIMAL(38,8)) * 100000000 AS HUGEINT)) AS DECIMAL(18,0)) * 0.01
            AS DECIMAL(15,2))
         AS average_purchase_price
FROM (SELECT tenant_id, user_id, asset_type, CAST(SUM(total_value) AS DECIMAL(18,2)) AS bv,
             CAST(SUM(quantity) AS DECIMAL(18,8)) AS bq
      FROM tx WHERE status = 'completed' AND transaction_type = 'BUY'
      GROUP BY tenant_id, user_id, asset_type) a""")
