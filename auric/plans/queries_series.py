"""Registered queries: time series (Q), compliance (M, R), vault (U),
notifications (N) and the display scalars."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import compliance as M
from ..operators import holdings as H
from ..operators import reports as A
from ..operators import series as Q
from ..operators import vault as U
from ..sources import dims
from .oracle_tables import with_tables as W
from .queries import D, S, holdings_valued, tx_cols_sql
from .registry import register

END_MONTH = "2001-12-01"
ACTIVITY_AS_OF = "2001-12-01 00:00:00"
HIGH_AMOUNT = 45000
KYC_CAPS = {0: Decimal("0"), 1: Decimal("20000"), 2: Decimal("40000"), 3: None}
DAILY_LIMIT = 50000
VELOCITY_N, VELOCITY_SPAN = 3, 7 * 86400
REPORT_START, REPORT_END = "2001-01-01", "2001-06-30"

ALERT_SQL_COLS = "tenant_id, user_id, alert_type, ref, CAST(amount AS DOUBLE) AS amount, created_at"
TXREF = "concat_ws('|', CAST(order_id AS VARCHAR), CAST(line_no AS VARCHAR), CAST(partkey AS VARCHAR), CAST(suppkey AS VARCHAR))"


# ------------------------------------------------------------------ Q-01 … Q-11
@register("latest_price", "Q-01", W(["ticks"], f"""
SELECT asset_type, {D("price")} AS current_price, ts AS price_updated_at
FROM (SELECT *, row_number() OVER (PARTITION BY asset_type ORDER BY ts DESC, event_id DESC) AS rn FROM ticks)
WHERE rn = 1"""))
def _q01(fx):
    return Q.latest_price(fx.ticks)


@register("price_change_pct", "Q-02", W(["ticks"], f"""
, c AS (SELECT asset_type, CAST(ts AS DATE) AS day, price AS close FROM (
          SELECT *, row_number() OVER (PARTITION BY asset_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn
          FROM ticks) WHERE rn = 1),
l AS (SELECT *, lag(close) OVER (PARTITION BY asset_type ORDER BY day) AS prev_close FROM c)
SELECT asset_type, {S("day")} AS day, {D("close")} AS close, {D("prev_close")} AS prev_close,
       CASE WHEN prev_close <> 0 THEN {D("close - prev_close")} / {D("prev_close")} * 100.0 END AS change_pct
FROM l"""))
def _q02(fx):
    return Q.price_change_pct(fx.ticks)


@register("price_asof", "Q-03", W(["trades", "ticks"], f"""
SELECT t.asset_type, t.ts, t.event_id, t.user_id, {D("k.price")} AS price, k.ts AS price_ts
FROM trades t ASOF LEFT JOIN ticks k ON t.asset_type = k.asset_type AND t.ts >= k.ts"""))
def _q03(fx):
    return Q.price_asof(fx.trades, fx.ticks)


def history_sql(grain: str, end: str, step: str) -> str:
    """Portfolio value per user and period up to the period that begins at ``end``."""
    return f"""
, keys AS (SELECT tenant_id, user_id, asset_type, CAST(date_trunc('{grain}', min(created_at)) AS DATE) AS first_period
           FROM ledger_walk GROUP BY tenant_id, user_id, asset_type),
spine AS (SELECT tenant_id, user_id, asset_type,
                 CAST(unnest(generate_series(CAST(first_period AS TIMESTAMP), TIMESTAMP '{end}',
                                             INTERVAL {step})) AS DATE) AS {grain}
          FROM keys),
mb AS (SELECT s.tenant_id, s.user_id, s.asset_type, s.{grain}, arg_max(w.bal, w.rn) AS bal
       FROM spine s JOIN ledger_walk w
         ON s.tenant_id = w.tenant_id AND s.user_id = w.user_id AND s.asset_type = w.asset_type
        AND w.created_at < s.{grain} + INTERVAL {step}
       GROUP BY s.tenant_id, s.user_id, s.asset_type, s.{grain}),
px AS (SELECT m.asset_type, m.{grain},
              arg_max(t.price, (t.created_at, t.order_id, t.line_no, t.partkey, t.suppkey, t.ext, t.quantity,
                                t.transaction_type)) AS price
       FROM (SELECT DISTINCT asset_type, {grain} FROM mb) m JOIN tx t
         ON t.asset_type = m.asset_type AND t.created_at < m.{grain} + INTERVAL {step}
        AND t.status = 'completed' AND t.transaction_type IN ('BUY', 'SELL')
       GROUP BY m.asset_type, m.{grain}),
hist AS (SELECT mb.tenant_id, mb.user_id, mb.{grain},
                CAST(SUM(CAST(mb.bal * px.price AS DECIMAL(15,2))) AS DECIMAL(18,2)) AS portfolio_value
         FROM mb LEFT JOIN px ON mb.asset_type = px.asset_type AND mb.{grain} = px.{grain}
         GROUP BY mb.tenant_id, mb.user_id, mb.{grain})"""


HISTORY_SQL = history_sql("month", END_MONTH, "1 MONTH")
END_WEEK = "2001-11-26"  # the Monday of the week of END_MONTH


def return_sql(grain: str) -> str:
    """Change against the period before and since the year's first period."""
    return f"""
, w AS (SELECT *, lag(portfolio_value) OVER (PARTITION BY tenant_id, user_id ORDER BY {grain}) AS prev_value,
               first_value(portfolio_value) OVER (PARTITION BY tenant_id, user_id, year({grain}) ORDER BY {grain}
                                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ys
        FROM hist)
SELECT tenant_id, user_id, {S(grain)} AS {grain}, {D("portfolio_value")} AS portfolio_value,
       {D("portfolio_value - prev_value")} AS change,
       CASE WHEN prev_value <> 0 THEN {D("portfolio_value - prev_value")} / {D("prev_value")} * 100.0 END AS change_pct,
       CASE WHEN ys <> 0 THEN {D("portfolio_value - ys")} / {D("ys")} * 100.0 END AS ytd_pct
FROM w"""


@register("portfolio_history", "Q-04", W(["ledger_walk", "tx"], HISTORY_SQL + f"""
SELECT tenant_id, user_id, {S("month")} AS month, {D("portfolio_value")} AS portfolio_value FROM hist"""))
def _q04(fx):
    return Q.portfolio_history(fx.tx, None, END_MONTH)


@register("recent_activity", "Q-05", W(["tx"], f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, user_id ORDER BY created_at DESC, order_id DESC,
                                     line_no DESC, partkey DESC, suppkey DESC, ext DESC, quantity DESC,
                                     transaction_type DESC) AS rn FROM tx),
s AS (SELECT *, CAST(floor((epoch_us(TIMESTAMP '{ACTIVITY_AS_OF}') - epoch_us(created_at)) / 1000000) AS BIGINT) AS secs
      FROM r WHERE rn <= 3)
SELECT tenant_id, user_id, CAST(rn AS BIGINT) AS rn, order_id, line_no, transaction_type, asset_type,
       {D("quantity")} AS quantity, {D("total_value")} AS total_value, created_at,
       CASE transaction_type WHEN 'BUY' THEN 'Bought' WHEN 'SELL' THEN 'Sold' WHEN 'REDEEM' THEN 'Redeemed'
            WHEN 'TRANSFER' THEN 'Transferred' END
       || ' ' || regexp_replace(CAST(quantity AS VARCHAR), '\\.?0+$', '') || 'g '
       || upper(substr(asset_type, 1, 1)) || lower(substr(asset_type, 2)) || ' '
       || CASE asset_type WHEN 'GOLD' THEN 'BGT' WHEN 'SILVER' THEN 'BST' WHEN 'PLATINUM' THEN 'BPT' END AS title,
       CASE WHEN secs < 60 THEN 'just now'
            WHEN secs < 3600 THEN CAST(secs // 60 AS VARCHAR) || ' minute' || CASE WHEN secs // 60 = 1 THEN '' ELSE 's' END || ' ago'
            WHEN secs < 86400 THEN CAST(secs // 3600 AS VARCHAR) || ' hour' || CASE WHEN secs // 3600 = 1 THEN '' ELSE 's' END || ' ago'
            WHEN secs < 2592000 THEN CAST(secs // 86400 AS VARCHAR) || ' day' || CASE WHEN secs // 86400 = 1 THEN '' ELSE 's' END || ' ago'
            WHEN secs < 31536000 THEN CAST(secs // 2592000 AS VARCHAR) || ' month' || CASE WHEN secs // 2592000 = 1 THEN '' ELSE 's' END || ' ago'
            ELSE CAST(secs // 31536000 AS VARCHAR) || ' year' || CASE WHEN secs // 31536000 = 1 THEN '' ELSE 's' END || ' ago'
       END AS "when"
FROM s"""))
def _q05(fx):
    return Q.recent_activity(fx.tx, 3, ACTIVITY_AS_OF)


@register("top_orders", "Q-06", W(["tx"], f"""
SELECT {tx_cols_sql('x')}, CAST(x.rk AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY total_value DESC, created_at DESC, order_id DESC,
                               line_no DESC, partkey DESC, suppkey DESC, ext DESC, quantity DESC,
                               transaction_type DESC) AS rk
  FROM tx WHERE status = 'completed') x WHERE x.rk <= 5"""))
def _q06(fx):
    return Q.top_orders(fx.tx, 5)


@register("period_return", "Q-07", W(["ledger_walk", "tx"], HISTORY_SQL + return_sql("month")))
def _q07(fx):
    return Q.period_return(Q.portfolio_history(fx.tx, None, END_MONTH))


@register("period_return_week", "Q-07", W(["ledger_walk", "tx"], history_sql("week", END_WEEK, "7 DAY") + return_sql("week")))
def _q07_week(fx):
    return Q.period_return(Q.portfolio_history(fx.tx, None, END_MONTH, "week"), "week")


@register("price_alert", "Q-08", W(["ticks", "price_thresholds"], f"""
, p AS (SELECT *, lag(price) OVER (PARTITION BY asset_type ORDER BY ts, event_id) AS prev_price FROM ticks)
SELECT t.user_id, p.asset_type, {D("t.threshold")} AS threshold, p.ts, p.event_id, {D("p.prev_price")} AS prev_price,
       {D("p.price")} AS price,
       CASE WHEN p.prev_price < t.threshold AND t.threshold <= p.price THEN 'UP' ELSE 'DOWN' END AS direction
FROM p JOIN price_thresholds t ON p.asset_type = t.asset_type
WHERE p.prev_price IS NOT NULL
  AND ((p.prev_price < t.threshold AND t.threshold <= p.price)
    OR (p.prev_price >= t.threshold AND t.threshold > p.price))"""))
def _q08(fx):
    return Q.price_alert(fx.ticks, fx.price_thresholds)


@register("status_history", "Q-09", W(["transaction_history"], f"""
SELECT id, transaction_id, new_status, changed_at,
       lag(new_status) OVER w AS previous_status,
       {D("epoch_us(lead(changed_at) OVER w) - epoch_us(changed_at)")} / 1000000.0 AS seconds_in_status
FROM transaction_history WINDOW w AS (PARTITION BY transaction_id ORDER BY changed_at, id)"""))
def _q09(fx):
    return Q.status_history(fx.transaction_history)


@register("conversion_funnel", "Q-10", W(["web_events"], f"""
, s1 AS (SELECT user_id, min(ts) AS t FROM web_events WHERE step = 'landing' GROUP BY user_id),
s2 AS (SELECT e.user_id, min(e.ts) AS t FROM web_events e JOIN s1 ON e.user_id = s1.user_id
       WHERE e.step = 'pricing' AND e.ts > s1.t GROUP BY e.user_id),
s3 AS (SELECT e.user_id, min(e.ts) AS t FROM web_events e JOIN s2 ON e.user_id = s2.user_id
       WHERE e.step = 'cta' AND e.ts > s2.t GROUP BY e.user_id),
s4 AS (SELECT e.user_id, min(e.ts) AS t FROM web_events e JOIN s3 ON e.user_id = s3.user_id
       WHERE e.step = 'form' AND e.ts > s3.t GROUP BY e.user_id),
s5 AS (SELECT e.user_id, min(e.ts) AS t FROM web_events e JOIN s4 ON e.user_id = s4.user_id
       WHERE e.step = 'paid' AND e.ts > s4.t GROUP BY e.user_id),
c AS (SELECT (SELECT count(*) FROM s1) AS c1, (SELECT count(*) FROM s2) AS c2, (SELECT count(*) FROM s3) AS c3,
             (SELECT count(*) FROM s4) AS c4, (SELECT count(*) FROM s5) AS c5)
SELECT 1 AS step_no, 'landing' AS step, c1 AS users, CAST(NULL AS DOUBLE) AS step_rate,
       {D("c1")} / NULLIF({D("c1")}, 0) AS overall_rate FROM c
UNION ALL SELECT 2, 'pricing', c2, {D("c2")} / NULLIF({D("c1")}, 0), {D("c2")} / NULLIF({D("c1")}, 0) FROM c
UNION ALL SELECT 3, 'cta', c3, {D("c3")} / NULLIF({D("c2")}, 0), {D("c3")} / NULLIF({D("c1")}, 0) FROM c
UNION ALL SELECT 4, 'form', c4, {D("c4")} / NULLIF({D("c3")}, 0), {D("c4")} / NULLIF({D("c1")}, 0) FROM c
UNION ALL SELECT 5, 'paid', c5, {D("c5")} / NULLIF({D("c4")}, 0), {D("c5")} / NULLIF({D("c1")}, 0) FROM c"""))
def _q10(fx):
    return Q.conversion_funnel(fx.web_events)


@register("page_engagement", "Q-11", W(["web_events"], f"""
, g AS (SELECT step, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS gap_us
        FROM web_events)
SELECT step, COUNT(*) AS views, {D("SUM(gap_us)")} / {D("COUNT(*)")} / 1000000.0 AS avg_seconds
FROM g WHERE gap_us IS NOT NULL AND gap_us <= 1800000000 GROUP BY step"""))
def _q11(fx):
    return Q.page_engagement(fx.web_events, 1800)


# ------------------------------------------------------------------ M-01 … M-08, R-01
M01_SQL = f"""SELECT tenant_id, user_id, 'HIGH_AMOUNT' AS alert_type, {TXREF} AS ref,
       CAST(total_value AS DECIMAL(18,2)) AS amount, created_at
FROM tx WHERE total_value >= {HIGH_AMOUNT}"""
M02_SQL = f"""SELECT x.tenant_id, x.user_id, 'KYC_LIMIT' AS alert_type,
       concat_ws('|', CAST(x.order_id AS VARCHAR), CAST(x.line_no AS VARCHAR), CAST(x.partkey AS VARCHAR),
                 CAST(x.suppkey AS VARCHAR)) AS ref,
       CAST(x.total_value AS DECIMAL(18,2)) AS amount, x.created_at
FROM tx x LEFT JOIN users u ON x.tenant_id = u.tenant_id AND x.user_id = u.user_id
WHERE x.total_value > CASE COALESCE(u.kyc_level, 0) WHEN 1 THEN 20000.00 WHEN 2 THEN 40000.00 WHEN 3 THEN NULL
                      ELSE 0.00 END"""
M03_SQL = f"""SELECT d.tenant_id, d.user_id, 'DAILY_LIMIT' AS alert_type, CAST(d.day AS VARCHAR) AS ref,
       CAST(d.v AS DECIMAL(18,2)) AS amount, CAST(d.day AS TIMESTAMP) AS created_at
FROM (SELECT tenant_id, user_id, CAST(created_at AS DATE) AS day, SUM(total_value) AS v FROM tx
      WHERE status = 'completed' GROUP BY 1, 2, 3) d
LEFT JOIN tenants t ON d.tenant_id = t.tenant_id
WHERE d.v > COALESCE(CAST(json_extract_string(t.brand_config, '$.features.maxDailyLimit') AS DECIMAL(18,2)),
                     {DAILY_LIMIT})"""
M04_SQL = f"""SELECT tenant_id, user_id, 'SUSPICIOUS_PATTERN' AS alert_type, {TXREF} AS ref,
       CAST(total_value AS DECIMAL(18,2)) AS amount, created_at
FROM (SELECT *, count(*) OVER (PARTITION BY tenant_id, user_id ORDER BY CAST(epoch(created_at) AS BIGINT)
                                RANGE BETWEEN {VELOCITY_SPAN} PRECEDING AND CURRENT ROW) AS n FROM tx) z
WHERE n >= {VELOCITY_N}"""
M05_SQL = """SELECT u.tenant_id, u.user_id, 'PEP_MATCH' AS alert_type, u.nname AS ref,
       CAST(NULL AS DECIMAL(18,2)) AS amount, u.created_at
FROM (SELECT *, lower(trim(regexp_replace(first_name || ' ' || last_name, '[^A-Za-z0-9]+', ' ', 'g'))) AS nname
      FROM users) u
WHERE u.nname IN (SELECT lower(trim(regexp_replace(name, '[^A-Za-z0-9]+', ' ', 'g'))) FROM watchlist)"""


def _alerts(fx):
    return (M.alert_high_amount(fx.tx, HIGH_AMOUNT),
            M.alert_kyc_limit(fx.tx, fx.users, dims.kyc_level_caps(fx.spark, KYC_CAPS)),
            M.alert_daily_limit(fx.tx, fx.tenants, DAILY_LIMIT),
            M.alert_velocity(fx.tx, VELOCITY_N, VELOCITY_SPAN),
            M.alert_watchlist(fx.users, fx.watchlist))


@register("alert_high_amount", "M-01", W(["tx"], f"SELECT {ALERT_SQL_COLS} FROM ({M01_SQL})"))
def _m01(fx):
    return _alerts(fx)[0]


@register("alert_kyc_limit", "M-02", W(["tx", "users"], f"SELECT {ALERT_SQL_COLS} FROM ({M02_SQL})"))
def _m02(fx):
    return _alerts(fx)[1]


@register("alert_daily_limit", "M-03", W(["tx", "tenants"], f"SELECT {ALERT_SQL_COLS} FROM ({M03_SQL})"))
def _m03(fx):
    return _alerts(fx)[2]


@register("alert_velocity", "M-04", W(["tx"], f"SELECT {ALERT_SQL_COLS} FROM ({M04_SQL})"))
def _m04(fx):
    return _alerts(fx)[3]


@register("alert_watchlist", "M-05", W(["users", "watchlist"], f"SELECT {ALERT_SQL_COLS} FROM ({M05_SQL})"))
def _m05(fx):
    return _alerts(fx)[4]


ALL_ALERTS_SQL = f"({M01_SQL}) UNION ALL ({M02_SQL}) UNION ALL ({M03_SQL}) UNION ALL ({M04_SQL}) UNION ALL ({M05_SQL})"
# The report's watch-list screening runs on the last day of its period.
REPORT_ALERTS_SQL = ALL_ALERTS_SQL.replace("u.created_at\n", f"TIMESTAMP '{REPORT_END}' AS created_at\n")


def _all_alerts(fx, screened_at=None, since=None, until=None):
    """All rules in two passes over the ledger: single trades (those raised in [since, until)), and daily sums."""
    return M.all_alerts(
        M.trade_alerts(fx.tx, fx.users, dims.kyc_level_caps(fx.spark, KYC_CAPS), HIGH_AMOUNT, VELOCITY_N, VELOCITY_SPAN,
                       since, until),
        M.alert_daily_limit(fx.tx, fx.tenants, DAILY_LIMIT),
        M.alert_watchlist(fx.users, fx.watchlist, screened_at))


@register("risk_score", "M-06", W(["tx", "users", "tenants", "watchlist"], f"""
, a AS ({ALL_ALERTS_SQL}),
f AS (SELECT DISTINCT tenant_id, user_id, alert_type FROM a)
SELECT tenant_id, user_id, COUNT(*) AS rules_fired,
       CAST(least(100, greatest(0, SUM(CASE alert_type WHEN 'HIGH_AMOUNT' THEN 40 WHEN 'KYC_LIMIT' THEN 30
            WHEN 'DAILY_LIMIT' THEN 30 WHEN 'SUSPICIOUS_PATTERN' THEN 20 WHEN 'PEP_MATCH' THEN 50 ELSE 0 END)))
            AS INTEGER) AS risk_score
FROM f GROUP BY tenant_id, user_id"""))
def _m06(fx):
    return M.risk_score(_all_alerts(fx))


@register("regulatory_report", "M-07", W(["tx", "users", "tenants", "watchlist"], f"""
, a AS ({REPORT_ALERTS_SQL}),
c AS (SELECT * FROM tx WHERE status = 'completed' AND created_at >= DATE '{REPORT_START}'
        AND created_at < DATE '{REPORT_END}' + INTERVAL 1 DAY),
per AS (SELECT tenant_id, COUNT(*) AS fiu_n, SUM(total_value) AS fiu_amount,
               COUNT(*) FILTER (WHERE total_value >= {HIGH_AMOUNT}) AS ctr_n,
               SUM(total_value) FILTER (WHERE total_value >= {HIGH_AMOUNT}) AS ctr_amount FROM c GROUP BY tenant_id),
al AS (SELECT tenant_id, COUNT(*) AS str_n, SUM(amount) AS str_amount FROM a
       WHERE created_at >= DATE '{REPORT_START}' AND created_at < DATE '{REPORT_END}' + INTERVAL 1 DAY
       GROUP BY tenant_id),
j AS (SELECT COALESCE(per.tenant_id, al.tenant_id) AS tenant_id, per.fiu_n, per.fiu_amount, per.ctr_n,
             per.ctr_amount, al.str_n, al.str_amount
      FROM per FULL OUTER JOIN al ON per.tenant_id = al.tenant_id)
SELECT tenant_id, r.report_type, '{REPORT_START}' AS reporting_period_start, '{REPORT_END}' AS reporting_period_end,
       r.n, CAST(r.amount AS DOUBLE) AS amount, 'generated' AS status,
       '{{"type":"' || r.report_type || '","n":' || CAST(r.n AS VARCHAR) || ',"amount":' || CAST(r.amount AS VARCHAR)
         || '}}' AS report_data
FROM j, LATERAL (VALUES ('FIU', COALESCE(j.fiu_n, 0), CAST(COALESCE(j.fiu_amount, 0) AS DECIMAL(18,2))),
                        ('CTR', COALESCE(j.ctr_n, 0), CAST(COALESCE(j.ctr_amount, 0) AS DECIMAL(18,2))),
                        ('STR', COALESCE(j.str_n, 0), CAST(COALESCE(j.str_amount, 0) AS DECIMAL(18,2))))
     r(report_type, n, amount)"""))
def _m07(fx):
    alerts = _all_alerts(fx, REPORT_END, REPORT_START, F.date_add(F.lit(REPORT_END).cast("date"), 1))
    return M.regulatory_report(fx.tx, alerts, REPORT_START, REPORT_END, HIGH_AMOUNT)


@register("audit_diff", "M-08", W(["audit_logs"], """
, k AS (SELECT *, unnest(list_distinct(list_concat(COALESCE(json_keys(old_values), []),
                                                   COALESCE(json_keys(new_values), [])))) AS key
        FROM audit_logs),
v AS (SELECT id, tenant_id, user_id, created_at, key,
             COALESCE(list_contains(json_keys(old_values), key), FALSE) AS had,
             COALESCE(list_contains(json_keys(new_values), key), FALSE) AS has,
             json_extract_string(old_values, '$."' || key || '"') AS old_value,
             json_extract_string(new_values, '$."' || key || '"') AS new_value FROM k)
SELECT id, tenant_id, user_id, created_at, key, old_value, new_value,
       CASE WHEN NOT had THEN 'added' WHEN NOT has THEN 'removed' ELSE 'changed' END AS kind
FROM v WHERE NOT had OR NOT has OR old_value IS DISTINCT FROM new_value"""))
def _m08(fx):
    return M.audit_diff(fx.audit_logs)


@register("payment_reconciliation", "R-01", W(["tx", "payments"], """
, l AS (SELECT tenant_id, order_id, CAST(SUM(total_value) AS DECIMAL(18,2)) AS ledger_total
       FROM tx GROUP BY tenant_id, order_id),
p AS (SELECT tenant_id, order_id, SUM(amount) AS amount, SUM(refund_amount) AS refund_amount
      FROM payments WHERE status = 'completed' GROUP BY tenant_id, order_id)
SELECT COALESCE(l.tenant_id, p.tenant_id) AS tenant_id, COALESCE(l.order_id, p.order_id) AS order_id, CAST(l.ledger_total AS DOUBLE) AS ledger_total,
       CAST(p.amount AS DOUBLE) AS amount, CAST(p.refund_amount AS DOUBLE) AS refund_amount,
       CAST(p.amount - p.refund_amount AS DOUBLE) AS net_received,
       CAST(p.amount - l.ledger_total AS DOUBLE) AS difference,
       CASE WHEN p.order_id IS NULL THEN 'missing_payment' WHEN l.order_id IS NULL THEN 'orphan_payment'
            WHEN p.amount = l.ledger_total THEN 'matched' ELSE 'amount_mismatch' END AS state
FROM l FULL OUTER JOIN p ON l.tenant_id = p.tenant_id AND l.order_id = p.order_id"""))
def _r01(fx):
    return M.payment_reconciliation(fx.tx, fx.payments)


# ------------------------------------------------------------------ U-01 … U-03, N-01
@register("vault_stock", "U-01", W(["vault_inventory"], f"""
SELECT provider_code, asset_type, status, COUNT(*) AS lots, {D("SUM(weight_grams)")} AS weight_grams,
       {D("SUM(weight_grams * purity)")} AS fine_weight_grams, {D("SUM(available_amount)")} AS available_amount,
       {D("SUM(tokenized_amount)")} AS tokenized_amount, {D("SUM(insurance_value)")} AS insured_value
FROM vault_inventory GROUP BY provider_code, asset_type, status"""))
def _u01(fx):
    return U.vault_stock(fx.vault_inventory)


@register("vault_capability", "U-02", W(["vault_inventory", "vault_providers"], f"""
SELECT l.provider_code, l.lot_order_id, l.lot_line_no, l.lot_partkey, l.lot_suppkey, l.tenant_id, l.asset_type,
       {D("l.weight_grams")} AS weight_grams, {D("l.purity")} AS purity,
       {D("l.tokenized_amount")} AS tokenized_amount, {D("l.available_amount")} AS available_amount,
       {D("l.insurance_value")} AS insurance_value, l.status,
       COALESCE(list_contains(p.supported_assets, l.asset_type), FALSE) AS asset_supported,
       COALESCE(list_has_any(p.certification_standards, ['LBMA', 'LPPM']), FALSE) AS certified
FROM vault_inventory l LEFT JOIN vault_providers p ON l.provider_code = p.code
WHERE NOT COALESCE(list_contains(p.supported_assets, l.asset_type), FALSE)
   OR NOT COALESCE(list_has_any(p.certification_standards, ['LBMA', 'LPPM']), FALSE)"""))
def _u02(fx):
    return U.vault_capability(fx.vault_inventory, dims.vault_providers(fx.spark))


@register("backing_ratio", "U-03", W(["holdings", "vault_inventory"], f"""
, o AS (SELECT tenant_id, asset_type, SUM(quantity) AS q FROM holdings GROUP BY 1, 2),
v AS (SELECT tenant_id, asset_type, SUM(tokenized_amount) AS t FROM vault_inventory GROUP BY 1, 2)
SELECT COALESCE(o.tenant_id, v.tenant_id) AS tenant_id, COALESCE(o.asset_type, v.asset_type) AS asset_type,
       {D("COALESCE(o.q, 0)")} AS tokens_outstanding, {D("COALESCE(v.t, 0)")} AS tokenized_in_vault,
       CASE WHEN COALESCE(o.q, 0) <> 0 THEN {D("COALESCE(v.t, 0)")} / {D("COALESCE(o.q, 0)")} END AS backing_ratio,
       COALESCE(v.t, 0) < COALESCE(o.q, 0) AS shortfall
FROM o FULL OUTER JOIN v ON o.tenant_id = v.tenant_id AND o.asset_type = v.asset_type"""))
def _u03(fx):
    return U.backing_ratio(H.holdings_from_ledger(fx.tx), fx.vault_inventory)


@register("render_notifications", "N-01", W(["notification_templates", "tenants"], """
SELECT n.tenant_id, n.template_code, n.template_type,
       replace(n.subject, '{{companyName}}',
               COALESCE(json_extract_string(t.brand_config, '$.companyName'), t.company_name)) AS subject,
       replace(n.content, '{{companyName}}',
               COALESCE(json_extract_string(t.brand_config, '$.companyName'), t.company_name)) AS content
FROM notification_templates n JOIN tenants t ON n.tenant_id = t.tenant_id WHERE n.is_active"""))
def _n01(fx):
    return U.render_notifications(fx.notification_templates, fx.tenants)


# ------------------------------------------------------------------ scalars (§2.12)
def _inr_sql(v: str) -> str:
    s = f"CAST(abs(CAST({v} AS DECIMAL(38,3))) AS VARCHAR)"
    ip = f"split_part({s}, '.', 1)"
    fr = f"rtrim(split_part({s}, '.', 2), '0')"
    grouped = (f"CASE WHEN length({ip}) <= 3 THEN {ip} ELSE "
               f"reverse(rtrim(regexp_replace(reverse(substr({ip}, 1, length({ip}) - 3)), '(\\d\\d)', '\\1,', 'g'), ','))"
               f" || ',' || right({ip}, 3) END")
    return (f"'₹' || CASE WHEN {v} < 0 THEN '-' ELSE '' END || {grouped}"
            f" || CASE WHEN {fr} <> '' THEN '.' || {fr} ELSE '' END")


@register("portfolio_display", "§2.12", W(["users", "holdings_valued"], f"""
, s AS (SELECT u.tenant_id, u.user_id, COALESCE(SUM(h.total_value), 0) AS total_value
        FROM users u LEFT JOIN holdings_valued h ON u.tenant_id = h.tenant_id AND u.user_id = h.user_id
        GROUP BY u.tenant_id, u.user_id)
SELECT tenant_id, user_id, {D("total_value")} AS total_value, {_inr_sql("total_value")} AS total_display,
       '₹' || CAST(CAST(floor(total_value / 1000 + 0.5) AS BIGINT) AS VARCHAR) || 'K' AS axis_label
FROM s"""))
def _scalars(fx):
    s = A.portfolio_summary(fx.users, holdings_valued(fx))
    return s.select("tenant_id", "user_id", "total_value", X.money_inr(F.col("total_value")).alias("total_display"),
                    X.axis_k(F.col("total_value")).alias("axis_label"))
