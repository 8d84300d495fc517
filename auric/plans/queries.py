"""Registered queries: each survey operator run over the whole fixture tables,
paired with an independent DuckDB oracle.

Fixed parameters (dates, thresholds) are the ones FIXTURES.md §4 lists as
making each operator return a meaningful result.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from ..operators import holdings as H
from ..operators import reports as A
from ..sources import dims
from ..sources.fixtures import Fixtures
from .oracle_tables import with_tables as W
from .registry import register

AS_OF_USERS = "2001-10-15"
AS_OF_KYC = "2001-06-15"
AS_OF_MONTH = "2001-06-15"

D = lambda e: f"CAST({e} AS DOUBLE)"
S = lambda e: f"CAST({e} AS VARCHAR)"
BIG = lambda e: f"CAST({e} AS BIGINT)"

TX_COLS_SQL = ("tenant_id, user_id, order_id, line_no, transaction_type, asset_type, "
               "CAST(quantity AS DOUBLE) AS quantity, CAST(price AS DOUBLE) AS price, "
               "CAST(total_value AS DOUBLE) AS total_value, payment_method, status, created_at, "
               "partkey, suppkey, ext, linestatus")


def tx_cols_sql(alias: str) -> str:
    """TX_COLS_SQL with every column qualified by ``alias``."""
    out = []
    for part in TX_COLS_SQL.split(", "):
        m = part.replace("CAST(", "CAST(" + alias + ".") if part.startswith("CAST(") else f"{alias}.{part}"
        out.append(m)
    return ", ".join(out)


def holdings_valued(fx: Fixtures):
    return H.mark_to_market(H.holdings_from_ledger(fx.tx), dims.asset_types(fx.spark))


def tx_fees(fx: Fixtures):
    return A.payment_fees(fx.tx, dims.payment_methods(fx.tenants))


# ------------------------------------------------------------------ S-01
@register("scan_tx", "S-01", W(["tx"], f"SELECT {TX_COLS_SQL} FROM tx"))
def _scan_tx(fx):
    return fx.tx


@register("scan_tenants", "S-01", W(["tenants"], "SELECT * FROM tenants"))
def _scan_tenants(fx):
    return fx.tenants


@register("scan_users", "S-01", W(["users_login"], "SELECT * FROM users_login"))
def _scan_users(fx):
    return fx.users_with_login()


# ------------------------------------------------------------------ A-01 … A-20
@register("portfolio_summary", "A-01", W(["users", "holdings_valued"], f"""
SELECT u.tenant_id, u.user_id,
       {D("COALESCE(SUM(h.total_value), 0)")} AS total_value,
       {D("COALESCE(SUM(h.total_value) FILTER (WHERE h.asset_type = 'GOLD'), 0)")} AS gold_value,
       {D("COALESCE(SUM(h.total_value) FILTER (WHERE h.asset_type = 'SILVER'), 0)")} AS silver_value,
       {D("COALESCE(SUM(h.total_value) FILTER (WHERE h.asset_type = 'PLATINUM'), 0)")} AS platinum_value
FROM users u LEFT JOIN holdings_valued h ON u.tenant_id = h.tenant_id AND u.user_id = h.user_id
GROUP BY u.tenant_id, u.user_id"""))
def _a01(fx):
    return A.portfolio_summary(fx.users, holdings_valued(fx))


@register("portfolio_listing", "A-02", W(["holdings_valued"], f"""
SELECT tenant_id, user_id, asset_type, {D("quantity")} AS quantity, {D("current_price")} AS current_price,
       {D("total_value")} AS total_value, created_at,
       row_number() OVER (PARTITION BY tenant_id, user_id ORDER BY created_at DESC NULLS FIRST, asset_type)
         AS listing_pos
FROM holdings_valued"""))
def _a02(fx):
    return A.portfolio_listing(holdings_valued(fx))


@register("user_metrics", "A-03", W(["users"], f"""
SELECT tenant_id, COUNT(*) AS total_users,
       COUNT(*) FILTER (WHERE kyc_status = 'verified') AS verified_users,
       COUNT(*) FILTER (WHERE created_at >= DATE '{AS_OF_USERS}') AS new_today
FROM users GROUP BY tenant_id"""))
def _a03(fx):
    return A.user_metrics(fx.users, AS_OF_USERS)


@register("trading_metrics", "A-04", W(["tx"], f"""
SELECT tenant_id, COUNT(*) AS total_transactions,
       COUNT(*) FILTER (WHERE transaction_type = 'BUY') AS buy_orders,
       COUNT(*) FILTER (WHERE transaction_type = 'SELL') AS sell_orders,
       {D("COALESCE(SUM(total_value) FILTER (WHERE transaction_type = 'BUY'), 0)")} AS total_buy_volume,
       {D("COALESCE(SUM(total_value) FILTER (WHERE transaction_type = 'SELL'), 0)")} AS total_sell_volume
FROM tx WHERE status = 'completed' GROUP BY tenant_id"""))
def _a04(fx):
    return A.trading_metrics(fx.tx)


@register("asset_breakdown", "A-05", W(["tx"], f"""
SELECT tenant_id, asset_type, COUNT(*) AS transaction_count,
       {D("SUM(quantity)")} AS total_quantity, {D("SUM(total_value)")} AS total_value
FROM tx WHERE status = 'completed' GROUP BY tenant_id, asset_type"""))
def _a05(fx):
    return A.asset_breakdown(fx.tx)


@register("user_summary", "A-06", W(["tenants", "users_login"], f"""
SELECT t.tenant_id, t.company_name,
       COUNT(u.user_id) AS total_users,
       COUNT(u.user_id) FILTER (WHERE u.kyc_status = 'verified') AS verified_users,
       COUNT(u.user_id) FILTER (WHERE CAST(u.created_at AS DATE) = DATE '{AS_OF_USERS}') AS new_today,
       COUNT(u.user_id) FILTER (WHERE CAST(u.last_login_at AS DATE) = DATE '{AS_OF_USERS}') AS active_today
FROM tenants t LEFT JOIN users_login u ON t.tenant_id = u.tenant_id
GROUP BY t.tenant_id, t.company_name"""))
def _a06(fx):
    return A.user_summary(fx.tenants, fx.users_with_login(), AS_OF_USERS)


@register("transaction_summary", "A-07", W(["tenants", "tx"], f"""
SELECT t.tenant_id, t.company_name,
       COUNT(x.order_id) AS total_transactions,
       COUNT(x.order_id) FILTER (WHERE x.transaction_type = 'BUY') AS buy_transactions,
       COUNT(x.order_id) FILTER (WHERE x.transaction_type = 'SELL') AS sell_transactions,
       {D("COALESCE(SUM(x.total_value) FILTER (WHERE x.transaction_type = 'BUY'), 0)")} AS total_buy_volume,
       {D("COALESCE(SUM(x.total_value) FILTER (WHERE x.transaction_type = 'SELL'), 0)")} AS total_sell_volume,
       {D("COALESCE(SUM(x.total_value), 0)")} AS total_volume
FROM tenants t LEFT JOIN tx x ON t.tenant_id = x.tenant_id AND x.status = 'completed'
GROUP BY t.tenant_id, t.company_name"""))
def _a07(fx):
    return A.transaction_summary(fx.tenants, fx.tx)


@register("portfolio_view", "A-08", W(["tenants", "users", "holdings_valued"], f"""
SELECT t.tenant_id, t.company_name, u.user_id, u.first_name || ' ' || u.last_name AS user_name,
       h.asset_type, {D("h.quantity")} AS quantity, {D("h.current_price")} AS current_price,
       {D("h.total_value")} AS total_value
FROM tenants t JOIN users u ON t.tenant_id = u.tenant_id
JOIN holdings_valued h ON u.user_id = h.user_id AND t.tenant_id = h.tenant_id
WHERE h.quantity > 0"""))
def _a08(fx):
    return A.portfolio_view(fx.tenants, fx.users, holdings_valued(fx))


FEES_SQL = """
SELECT x.*, CAST(x.total_value * m.fee_percentage * 0.01 + m.fee_fixed AS DECIMAL(15,2)) AS fee,
       COALESCE(m.code IS NOT NULL AND x.total_value < COALESCE(m.min_amount, 0), FALSE) AS below_min,
       COALESCE(m.code IS NOT NULL AND x.total_value > m.max_amount, FALSE) AS above_max
FROM tx x LEFT JOIN (SELECT * FROM payment_methods WHERE is_enabled) m
  ON x.tenant_id = m.tenant_id AND x.payment_method = m.code"""


@register("daily_metrics", "A-09", W(["users", "tx", "payment_methods"], f"""
, fees AS ({FEES_SQL}),
u AS (SELECT tenant_id, CAST(created_at AS DATE) AS d, COUNT(*) AS nu,
             COUNT(*) FILTER (WHERE kyc_status = 'verified') AS nv
      FROM users GROUP BY 1, 2),
x AS (SELECT tenant_id, CAST(created_at AS DATE) AS d, COUNT(DISTINCT user_id) AS au, COUNT(*) AS n,
             COUNT(*) FILTER (WHERE transaction_type = 'BUY') AS nb,
             COUNT(*) FILTER (WHERE transaction_type = 'SELL') AS ns,
             SUM(total_value) AS vol,
             SUM(total_value) FILTER (WHERE asset_type = 'GOLD') AS vg,
             SUM(total_value) FILTER (WHERE asset_type = 'SILVER') AS vs,
             SUM(total_value) FILTER (WHERE asset_type = 'PLATINUM') AS vp,
             SUM(fee) AS rev
      FROM fees WHERE status = 'completed' GROUP BY 1, 2),
j AS (SELECT COALESCE(u.tenant_id, x.tenant_id) AS tenant_id, COALESCE(u.d, x.d) AS d,
             COALESCE(u.nu, 0) AS nu, COALESCE(u.nv, 0) AS nv, COALESCE(x.au, 0) AS au,
             COALESCE(x.n, 0) AS n, COALESCE(x.nb, 0) AS nb, COALESCE(x.ns, 0) AS ns,
             COALESCE(x.vol, 0) AS vol, COALESCE(x.vg, 0) AS vg, COALESCE(x.vs, 0) AS vs,
             COALESCE(x.vp, 0) AS vp, COALESCE(x.rev, 0) AS rev
      FROM u FULL OUTER JOIN x ON u.tenant_id = x.tenant_id AND u.d = x.d)
SELECT tenant_id, {S("d")} AS metric_date, nu AS new_users,
       {BIG("SUM(nu) OVER (PARTITION BY tenant_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")} AS total_users,
       au AS active_users,
       {BIG("SUM(nv) OVER (PARTITION BY tenant_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")} AS kyc_verified_users,
       n AS total_transactions, nb AS buy_transactions, ns AS sell_transactions,
       {D("CAST(vol AS DECIMAL(15,2))")} AS total_volume, {D("CAST(vg AS DECIMAL(15,2))")} AS gold_volume,
       {D("CAST(vs AS DECIMAL(15,2))")} AS silver_volume, {D("CAST(vp AS DECIMAL(15,2))")} AS platinum_volume,
       {D("CAST(rev AS DECIMAL(15,2))")} AS revenue
FROM j"""))
def _a09(fx):
    return A.daily_metrics(fx.users, tx_fees(fx))


@register("period_volume", "A-10", W(["tx"], f"""
SELECT tenant_id, COALESCE(asset_type, 'ALL') AS asset_type,
       {D("COALESCE(SUM(total_value) FILTER (WHERE CAST(created_at AS DATE) = DATE '" + AS_OF_MONTH + "'), 0)")} AS today_volume,
       {D("COALESCE(SUM(total_value), 0)")} AS month_volume
FROM tx
WHERE status = 'completed' AND created_at >= date_trunc('month', DATE '{AS_OF_MONTH}')
  AND created_at < DATE '{AS_OF_MONTH}' + INTERVAL 1 DAY
GROUP BY GROUPING SETS ((tenant_id, asset_type), (tenant_id))"""))
def _a10(fx):
    return A.period_volume(fx.tx, AS_OF_MONTH)


@register("volume_rollup", "A-11", W(["tx"], f"""
SELECT asset_type, transaction_type, {BIG("GROUPING(asset_type, transaction_type)")} AS gid,
       COUNT(*) AS n, {D("SUM(total_value)")} AS volume
FROM tx WHERE status = 'completed'
GROUP BY ROLLUP (asset_type, transaction_type)"""))
def _a11(fx):
    return A.volume_rollup(fx.tx)


@register("payment_fees", "A-12", W(["tx", "payment_methods"], f"""
SELECT {TX_COLS_SQL}, {D("fee")} AS fee, below_min, above_max FROM ({FEES_SQL}) f"""))
def _a12(fx):
    return tx_fees(fx)


@register("revenue", "A-13", W(["tx", "payment_methods"], f"""
SELECT tenant_id, {S("CAST(created_at AS DATE)")} AS metric_date, COUNT(*) AS n,
       {D("COALESCE(SUM(fee), 0)")} AS revenue
FROM ({FEES_SQL}) f WHERE status = 'completed' GROUP BY tenant_id, CAST(created_at AS DATE)"""))
def _a13(fx):
    return A.revenue(tx_fees(fx))


@register("payment_outcomes", "A-14", W(["payments"], f"""
SELECT payment_method, COUNT(*) AS payments,
       COUNT(*) FILTER (WHERE status = 'completed') AS completed,
       COUNT(*) FILTER (WHERE status = 'failed') AS failed,
       {D("SUM(refund_amount)")} AS refunded_amount,
       {D("COUNT(*) FILTER (WHERE status = 'completed')")} / {D("COUNT(*)")} AS success_rate
FROM payments GROUP BY payment_method"""))
def _a14(fx):
    return A.payment_outcomes(fx.payments)


@register("unread_notifications", "A-15", W(["notifications"], """
SELECT user_id, category, COUNT(*) AS total, COUNT(*) FILTER (WHERE NOT is_read) AS unread
FROM notifications GROUP BY user_id, category"""))
def _a15(fx):
    return A.unread_notifications(fx.notifications)


@register("audit_activity", "A-16", W(["audit_logs"], f"""
SELECT tenant_id, entity_type, action, {S("CAST(created_at AS DATE)")} AS day, COUNT(*) AS events,
       COUNT(DISTINCT user_id) AS distinct_users
FROM audit_logs GROUP BY tenant_id, entity_type, action, CAST(created_at AS DATE)"""))
def _a16(fx):
    return A.audit_activity(fx.audit_logs)


def _active_sql(grain: str) -> str:
    return (f"SELECT tenant_id, {S(f"CAST(date_trunc('{grain}', created_at) AS DATE)")} AS {grain}, "
            "COUNT(DISTINCT user_id) AS active_users FROM tx WHERE status = 'completed' "
            f"GROUP BY tenant_id, date_trunc('{grain}', created_at)")


@register("active_users_week", "A-09", W(["tx"], _active_sql("week")))
def _a09_week(fx):
    return A.active_users(A.completed(fx.tx), ["tenant_id"], "week")


@register("active_users_month", "A-09", W(["tx"], _active_sql("month")))
def _a09_month(fx):
    return A.active_users(A.completed(fx.tx), ["tenant_id"], "month")


SKETCH_ERROR = 0.03


@register("active_users_sketched", "A-09", W(["tx"], f"SELECT *, TRUE AS within_error FROM ({_active_sql('month')}) m"))
def _a09_sketch(fx):
    """Months from the days' sketches: no farther than SKETCH_ERROR from the exact count."""
    done = A.completed(fx.tx)
    exact = A.active_users(done, ["tenant_id"], "month")
    sketched = A.active_users_from_sketches(A.user_sketches(done, ["tenant_id"]), ["tenant_id"], "month")
    both = exact.join(sketched.withColumnRenamed("active_users", "estimate"), ["tenant_id", "month"], "left")
    near = F.abs(F.col("estimate") - F.col("active_users")) <= F.ceil(F.col("active_users") * SKETCH_ERROR)
    return both.select("tenant_id", "month", "active_users", F.coalesce(near, F.lit(False)).alias("within_error"))


@register("alert_workload", "A-17", W(["aml_alerts_fx"], f"""
SELECT alert_type, status, COUNT(*) AS alerts, COUNT(resolved_at) AS resolved,
       CASE WHEN COUNT(resolved_at) > 0 THEN
         {D("SUM(epoch_us(resolved_at) - epoch_us(created_at))")} / {D("COUNT(resolved_at)")} / 3600000000.0
       END AS mean_hours_to_resolve
FROM aml_alerts_fx GROUP BY alert_type, status"""))
def _a17(fx):
    return A.alert_workload(fx.aml_alerts)


@register("tier_quota", "A-18", W(["tenants", "users"], """
SELECT t.tenant_id, t.tier, COUNT(u.user_id) AS customers, CAST(c.user_cap AS DOUBLE) AS user_cap,
       COALESCE(COUNT(u.user_id) > c.user_cap, FALSE) AS over_cap
FROM tenants t
LEFT JOIN users u ON t.tenant_id = u.tenant_id
LEFT JOIN (VALUES ('lite', 50), ('pro', 500), ('startup', 500), ('growth', 5000), ('enterprise', NULL))
  AS c(tier, user_cap) ON t.tier = c.tier
GROUP BY t.tenant_id, t.tier, c.user_cap"""))
def _a18(fx):
    r = A.tier_quota(fx.tenants, fx.users, dims.tier_caps(fx.spark, Decimal("0.5")))
    return r.withColumn("user_cap", F.col("user_cap").cast("double"))


@register("tier_billing", "A-19", W(["tenants"], f"""
SELECT g.tier, g.tenants, {D("p.setup")} AS setup_fee, {D("p.setup * g.tenants")} AS setup_revenue,
       {D("p.fee")} AS monthly_fee, {D("p.cost")} AS monthly_cost,
       {D("p.fee - p.cost")} AS margin,
       CAST(round((p.fee - p.cost) * 100 / NULLIF(p.fee, 0)) AS DOUBLE) AS margin_pct,
       {D("p.fee * g.tenants")} AS monthly_revenue, {D("(p.fee - p.cost) * g.tenants")} AS monthly_profit
FROM (SELECT tier, COUNT(*) AS tenants FROM tenants GROUP BY tier) g
LEFT JOIN (VALUES ('lite', 50000.00, 17500.00, 10000.00), ('pro', 175000.00, 75000.00, 36000.00),
                  ('enterprise', 2500000.00, 350000.00, 63000.00), ('growth', 0.00, 0.00, 12000.00))
          AS p(tier, setup, fee, cost) ON g.tier = p.tier"""))
def _a19(fx):
    free = ("growth", Decimal("0"), Decimal("0"), Decimal("12000"))  # a free tier: margin without a percentage
    r = A.tier_billing(fx.tenants, dims.tier_price_list(fx.spark, [*dims.TIER_PRICE_LIST, free]))
    return r.withColumn("margin_pct", F.col("margin_pct").cast("double"))


@register("error_rate", "A-20", W(["users"], f"""
SELECT u.tenant_id, time_bucket(INTERVAL 1 DAY, e.ts) AS window_start, COUNT(*) AS events,
       COUNT(*) FILTER (WHERE e.event_type = 'error') AS errors,
       {D("COUNT(*) FILTER (WHERE e.event_type = 'error')")} / {D("COUNT(*)")} AS error_rate
FROM events e LEFT JOIN users u ON e.user_id = u.user_id
GROUP BY u.tenant_id, time_bucket(INTERVAL 1 DAY, e.ts)"""))
def _a20(fx):
    return A.error_rate(fx.events, fx.users, "1 day")


# ------------------------------------------------------------------ H-*
@register("holdings_from_ledger", "H-03", W(["holdings"], f"""
SELECT tenant_id, user_id, asset_type, {D("quantity")} AS quantity, created_at FROM holdings"""))
def _h03(fx):
    return H.holdings_from_ledger(fx.tx)


@register("ledger_balances", "H-03", W(["ledger_walk", "ledger_seq"], f"""
SELECT s.tenant_id, s.user_id, s.asset_type, s.created_at, s.order_id, s.line_no, s.partkey, s.suppkey,
       s.ext, {D("s.quantity")} AS quantity, s.transaction_type, {D("w.bal")} AS balance
FROM ledger_seq s JOIN ledger_walk w
  ON s.tenant_id = w.tenant_id AND s.user_id = w.user_id AND s.asset_type = w.asset_type AND s.rn = w.rn"""))
def _h03b(fx):
    return H.ledger_balances(fx.tx).drop("chunk")
