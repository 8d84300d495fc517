"""Registered batch twins of the streaming jobs (W-01 … W-06) and the
per-tenant insert of S-03. The streaming jobs themselves are checked against
these twins in tests/test_streaming.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds
from ..sources import dims, sinks
from ..streaming import jobs as Wj
from .oracle_tables import with_tables as W
from .queries import D
from .queries_series import HIGH_AMOUNT, KYC_CAPS, M01_SQL, M02_SQL
from .registry import register

RATE, BURST = (1, 21600), 1          # one request per six hours, burst 1 (FIXTURES §4)
DEN = RATE[1] * 1_000_000


@register("rate_violations", "W-01", W(["requests"], """
SELECT client, time_bucket(INTERVAL 15 MINUTE, ts) AS window_start,
       time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE AS window_end, COUNT(*) AS requests
FROM requests GROUP BY client, time_bucket(INTERVAL 15 MINUTE, ts) HAVING COUNT(*) > 1"""))
def _w01(fx):
    return Wj.rate_violations(fx.requests, "15 minutes", 1)


@register("login_failures", "W-02", W(["audit_logs"], """
, w AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, created_at) - k * INTERVAL 6 HOUR AS window_start
        FROM audit_logs, range(0, 4) r(k) WHERE action = 'error')
SELECT user_id, window_start, window_start + INTERVAL 1 DAY AS window_end, COUNT(*) AS failures
FROM w GROUP BY user_id, window_start HAVING COUNT(*) >= 2"""))
def _w02(fx):
    return Wj.login_failures(fx.audit_logs, "1 day", "6 hours", 2)


@register("leaky_bucket", "W-03", W(["requests"], f"""
, seq AS (SELECT client, ts, event_id, epoch_us(ts) AS t,
                 row_number() OVER (PARTITION BY client ORDER BY ts, event_id) AS rn FROM requests),
walk AS (SELECT * FROM (
  WITH RECURSIVE w(client, rn, ex, last_t, refused) AS (
    SELECT client, rn, CAST(0 AS HUGEINT), t, FALSE FROM seq WHERE rn = 1
    UNION ALL
    SELECT s.client, s.rn,
           CASE WHEN greatest(0, w.ex - {RATE[0]} * (s.t - w.last_t) + {DEN}) > {BURST * DEN} THEN w.ex
                ELSE greatest(0, w.ex - {RATE[0]} * (s.t - w.last_t) + {DEN}) END,
           CASE WHEN greatest(0, w.ex - {RATE[0]} * (s.t - w.last_t) + {DEN}) > {BURST * DEN} THEN w.last_t
                ELSE s.t END,
           greatest(0, w.ex - {RATE[0]} * (s.t - w.last_t) + {DEN}) > {BURST * DEN}
    FROM w JOIN seq s ON s.client = w.client AND s.rn = w.rn + 1
  ) SELECT * FROM w) x)
SELECT s.client, s.ts, s.event_id, w.refused,
       {D(f"CAST((2 * w.ex * 1000000 + {DEN}) // (2 * {DEN}) AS DECIMAL(38,0)) * 0.000001")} AS excess
FROM seq s JOIN walk w ON s.client = w.client AND s.rn = w.rn"""))
def _w03(fx):
    return folds.leaky_bucket(fx.requests, RATE, BURST).drop("excess_scaled")


@register("live_metrics", "W-04", W(["tx"], f"""
SELECT tenant_id, asset_type, time_bucket(INTERVAL 1 DAY, created_at) AS window_start, COUNT(*) AS transactions,
       COUNT(*) FILTER (WHERE transaction_type = 'BUY') AS buy_orders,
       COUNT(*) FILTER (WHERE transaction_type = 'SELL') AS sell_orders,
       {D("SUM(quantity)")} AS quantity, {D("SUM(total_value)")} AS volume,
       {D("COALESCE(SUM(total_value) FILTER (WHERE transaction_type = 'BUY'), 0)")} AS buy_volume,
       {D("COALESCE(SUM(total_value) FILTER (WHERE transaction_type = 'SELL'), 0)")} AS sell_volume
FROM tx WHERE status = 'completed' GROUP BY tenant_id, asset_type, time_bucket(INTERVAL 1 DAY, created_at)"""))
def _w04(fx):
    return Wj.live_metrics(fx.tx, "1 day")


@register("live_alerts", "W-06", W(["tx", "users"], f"""
SELECT tenant_id, user_id, alert_type, ref, CAST(amount AS DOUBLE) AS amount, created_at
FROM (({M01_SQL}) UNION ALL ({M02_SQL}))"""))
def _w06(fx):
    return Wj.live_alerts(fx.tx, fx.users, HIGH_AMOUNT, dims.kyc_level_caps(fx.spark, KYC_CAPS))


@register("insert_from_query", "S-03", W(["tenants"], """
SELECT tenant_id, 'UPI' AS code, 'UPI Payments' AS name, 'razorpay' AS gateway_provider, TRUE AS is_enabled,
       CAST(0.50 AS DOUBLE) AS fee_percentage, CAST(0.00 AS DOUBLE) AS fee_fixed
FROM tenants WHERE status = 'active'"""))
def _s03(fx):
    return sinks.insert_from_query(fx.tenants.filter(F.col("status") == "active"),
                                   sinks.UPI_METHOD_ROW)
