"""Aggregations and reporting views.

Pattern used throughout: aggregate the large fact table first (Spark plans a
partial + final hash aggregate, so the shuffle carries one row per group and
map task rather than every fact row), then join the small result to the
dimension. That keeps a dominant tenant from turning into one skewed join
partition and means the join never sees the fact table.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


MONEY = "decimal(15,2)"


def _zero() -> Column:
    return F.lit(0).cast(MONEY)


def _count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def _sum_if(cond: Column, value: Column) -> Column:
    return F.sum(F.when(cond, value))


def _day(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.to_date(c)


def _lit_date(d) -> Column:
    if isinstance(d, (_dt.date, _dt.datetime)):
        d = d.isoformat()[:10]
    return F.lit(d).cast("date")


def completed(tx: DataFrame) -> DataFrame:
    return tx.filter(F.col("status") == "completed")


# --------------------------------------------------------------------- A-01
def portfolio_summary(users: DataFrame, holdings_valued: DataFrame) -> DataFrame:
    """Per user: total, gold, silver, platinum value; zeros when no holdings."""
    a = F.col("asset_type")
    v = F.col("total_value")
    per_user = holdings_valued.groupBy("tenant_id", "user_id").agg(
        F.sum(v).alias("total_value"),
        _sum_if(a == "GOLD", v).alias("gold_value"),
        _sum_if(a == "SILVER", v).alias("silver_value"),
        _sum_if(a == "PLATINUM", v).alias("platinum_value"),
    )
    out = users.select("tenant_id", "user_id").join(per_user, ["tenant_id", "user_id"], "left")
    return out.select("tenant_id", "user_id",
                      *[F.coalesce(F.col(c), _zero()).alias(c)
                        for c in ("total_value", "gold_value", "silver_value", "platinum_value")])


# --------------------------------------------------------------------- A-02
def portfolio_listing(holdings: DataFrame, user_id=None) -> DataFrame:
    """Holdings newest first (PostgreSQL DESC: NULLs first), with position."""
    h = holdings if user_id is None else holdings.filter(F.col("user_id") == F.lit(user_id))
    w = Window.partitionBy("tenant_id", "user_id").orderBy(F.col("created_at").desc_nulls_first(),
                                                           F.col("asset_type"))
    return h.withColumn("listing_pos", F.row_number().over(w).cast("bigint"))


# --------------------------------------------------------------------- A-03
def user_metrics(users: DataFrame, as_of) -> DataFrame:
    """Admin dashboard user block: 'new today' is ``created_at >= as_of``."""
    return users.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("total_users"),
        _count_if(F.col("kyc_status") == "verified").alias("verified_users"),
        _count_if(F.col("created_at") >= _lit_date(as_of).cast("timestamp_ntz")).alias("new_today"),
    )


# --------------------------------------------------------------------- A-04
def trading_metrics(tx: DataFrame) -> DataFrame:
    """Completed trades per tenant (WHERE filter: tenants without trades drop)."""
    t = F.col("transaction_type")
    v = F.col("total_value")
    return completed(tx).groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        _count_if(t == "BUY").alias("buy_orders"),
        _count_if(t == "SELL").alias("sell_orders"),
        F.coalesce(_sum_if(t == "BUY", v), _zero()).alias("total_buy_volume"),
        F.coalesce(_sum_if(t == "SELL", v), _zero()).alias("total_sell_volume"),
    )


# --------------------------------------------------------------------- A-05
def asset_breakdown(tx: DataFrame) -> DataFrame:
    return completed(tx).groupBy("tenant_id", "asset_type").agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum("quantity").alias("total_quantity"),
        F.sum("total_value").alias("total_value"),
    )


# --------------------------------------------------------------------- A-06
def user_summary(tenants: DataFrame, users_login: DataFrame, as_of) -> DataFrame:
    """Per tenant, empty tenants kept with zeros; 'today' is a date equality."""
    d = _lit_date(as_of)
    per = users_login.groupBy("tenant_id").agg(
        F.count("user_id").alias("total_users"),
        _count_if(F.col("kyc_status") == "verified").alias("verified_users"),
        _count_if(_day("created_at") == d).alias("new_today"),
        _count_if(_day("last_login_at") == d).alias("active_today"),
    )
    out = tenants.select("tenant_id", "company_name").join(per, "tenant_id", "left")
    return out.select("tenant_id", "company_name",
                      *[F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
                        for c in ("total_users", "verified_users", "new_today", "active_today")])


# --------------------------------------------------------------------- A-07
def transaction_summary(tenants: DataFrame, tx: DataFrame) -> DataFrame:
    """Per tenant over completed trades, tenants without trades kept.

    The view's ``LEFT JOIN … ON … AND status='completed'`` is a pre-filter of
    the right side; aggregating before the join gives the same rows."""
    t = F.col("transaction_type")
    v = F.col("total_value")
    per = completed(tx).groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        _count_if(t == "BUY").alias("buy_transactions"),
        _count_if(t == "SELL").alias("sell_transactions"),
        _sum_if(t == "BUY", v).alias("total_buy_volume"),
        _sum_if(t == "SELL", v).alias("total_sell_volume"),
        F.sum(v).alias("total_volume"),
    )
    out = tenants.select("tenant_id", "company_name").join(per, "tenant_id", "left")
    zero_n = F.lit(0).cast("bigint")
    return out.select(
        "tenant_id", "company_name",
        *[F.coalesce(F.col(c), zero_n).alias(c)
          for c in ("total_transactions", "buy_transactions", "sell_transactions")],
        *[F.coalesce(F.col(c), _zero()).alias(c)
          for c in ("total_buy_volume", "total_sell_volume", "total_volume")],
    )


# --------------------------------------------------------------------- A-08
def portfolio_view(tenants: DataFrame, users: DataFrame, holdings_valued: DataFrame) -> DataFrame:
    """Tenant–user–holding rows with quantity > 0; name is NULL if a part is."""
    h = holdings_valued.filter(F.col("quantity") > 0)
    u = users.select("tenant_id", "user_id", "first_name", "last_name")
    j = h.join(u, ["tenant_id", "user_id"]).join(tenants.select("tenant_id", "company_name"), "tenant_id")
    return j.select("tenant_id", "company_name", "user_id",
                    F.concat(F.col("first_name"), F.lit(" "), F.col("last_name")).alias("user_name"),
                    "asset_type", "quantity", "current_price", "total_value")


# --------------------------------------------------------------------- A-09
def daily_metrics(users: DataFrame, tx_fees: DataFrame) -> DataFrame:
    """Per tenant and day, the 15 measures of the daily metrics table.

    ``tx_fees`` is the ledger with a ``fee`` column (A-12). Totals of users
    are running sums over the days present; 'active' is distinct trading
    users that day."""
    u = users.groupBy("tenant_id", _day("created_at").alias("metric_date")).agg(
        F.count(F.lit(1)).alias("new_users"),
        _count_if(F.col("kyc_status") == "verified").alias("new_verified"))
    t, a, v = F.col("transaction_type"), F.col("asset_type"), F.col("total_value")
    x = completed(tx_fees).groupBy("tenant_id", _day("created_at").alias("metric_date")).agg(
        F.countDistinct("user_id").alias("active_users"),
        F.count(F.lit(1)).alias("total_transactions"),
        _count_if(t == "BUY").alias("buy_transactions"),
        _count_if(t == "SELL").alias("sell_transactions"),
        F.sum(v).alias("total_volume"),
        _sum_if(a == "GOLD", v).alias("gold_volume"),
        _sum_if(a == "SILVER", v).alias("silver_volume"),
        _sum_if(a == "PLATINUM", v).alias("platinum_volume"),
        F.sum("fee").alias("revenue"))
    j = u.join(x, ["tenant_id", "metric_date"], "full_outer")
    n0 = F.lit(0).cast("bigint")
    j = j.select("tenant_id", "metric_date",
                 *[F.coalesce(F.col(c), n0).alias(c) for c in
                   ("new_users", "new_verified", "active_users", "total_transactions",
                    "buy_transactions", "sell_transactions")],
                 *[F.coalesce(F.col(c), _zero()).cast(MONEY).alias(c) for c in
                   ("total_volume", "gold_volume", "silver_volume", "platinum_volume", "revenue")])
    w = Window.partitionBy("tenant_id").orderBy("metric_date").rowsBetween(Window.unboundedPreceding, 0)
    return j.select(
        "tenant_id", "metric_date", "new_users",
        F.sum("new_users").over(w).alias("total_users"),
        "active_users",
        F.sum("new_verified").over(w).alias("kyc_verified_users"),
        "total_transactions", "buy_transactions", "sell_transactions",
        "total_volume", "gold_volume", "silver_volume", "platinum_volume", "revenue")


# ------------------------------------------------- A-09, A-16: distinct users
def active_users(events: DataFrame, keys, grain: str, ts_col: str = "created_at") -> DataFrame:
    """Exact distinct users per key and period (day, week or month). Distinct users
    do not add up over days, so this reads the events of the whole period."""
    from .series import period_of
    return events.groupBy(*keys, period_of(ts_col, grain).alias(grain)).agg(F.countDistinct("user_id").alias("active_users"))


def user_sketches(events: DataFrame, keys, ts_col: str = "created_at", log2_size: int = 14) -> DataFrame:
    """A mergeable sketch of the distinct users of every key and day (HyperLogLog, of
    at most 2**log2_size registers). Stored by day (:func:`auric.sources.sinks.write_by_day`),
    it answers any longer period without reading the events again."""
    return events.groupBy(*keys, _day(ts_col).alias("metric_date")).agg(
        F.hll_sketch_agg("user_id", log2_size).alias("users"))


def active_users_from_sketches(sketches: DataFrame, keys, grain: str) -> DataFrame:
    """Estimated distinct users per key and period, from the days' sketches alone. The
    standard error is about 1.04 / sqrt(2**log2_size), 0.8 % at 14."""
    from .series import period_of
    return sketches.groupBy(*keys, period_of("metric_date", grain).alias(grain)).agg(
        F.hll_sketch_estimate(F.hll_union_agg("users")).alias("active_users"))


# --------------------------------------------------------------------- A-10
def period_volume(tx: DataFrame, as_of) -> DataFrame:
    """Completed volume today and month-to-date, per tenant and asset, plus an
    'ALL' row per tenant (one rollup aggregation, one scan)."""
    d = _lit_date(as_of)
    start = F.trunc(d, "month").cast("timestamp_ntz")
    end = F.date_add(d, 1).cast("timestamp_ntz")
    m = completed(tx).filter((F.col("created_at") >= start) & (F.col("created_at") < end))
    v = F.col("total_value")
    r = m.rollup("tenant_id", "asset_type").agg(
        F.coalesce(_sum_if(_day("created_at") == d, v), _zero()).alias("today_volume"),
        F.coalesce(F.sum(v), _zero()).alias("month_volume"),
        F.grouping_id().alias("gid"))
    return (r.filter(F.col("gid") < 2)
             .select("tenant_id",
                     F.when(F.col("gid") == 1, F.lit("ALL")).otherwise(F.col("asset_type")).alias("asset_type"),
                     "today_volume", "month_volume"))


# --------------------------------------------------------------------- A-11
def volume_rollup(tx: DataFrame) -> DataFrame:
    """Asset × type volume with per-asset subtotals and a grand total."""
    return completed(tx).rollup("asset_type", "transaction_type").agg(
        F.grouping_id().alias("gid"),
        F.count(F.lit(1)).alias("n"),
        F.sum("total_value").alias("volume"))


# --------------------------------------------------------------------- A-12
def payment_fees(tx: DataFrame, methods: DataFrame) -> DataFrame:
    """fee = amount × pct / 100 + fixed (2 decimals, half up); min/max flags.

    Methods belong to a tenant; only enabled ones price a row, other rows keep
    a NULL fee."""
    m = methods.filter(F.col("is_enabled")).select(
        "tenant_id", F.col("code").alias("payment_method"), "fee_percentage", "fee_fixed", "min_amount", "max_amount")
    j = tx.join(m, ["tenant_id", "payment_method"], "left")
    v = F.col("total_value")
    fee = (v * F.col("fee_percentage") * F.lit("0.01").cast("decimal(3,2)") + F.col("fee_fixed")).cast(MONEY)
    priced = F.col("fee_percentage").isNotNull()
    # a row no fee rule applies to (disabled or missing method) is not flagged
    return j.select(
        *tx.columns,
        fee.alias("fee"),
        (priced & (v < F.coalesce(F.col("min_amount"), _zero()))).alias("below_min"),
        (priced & F.coalesce(v > F.col("max_amount"), F.lit(False))).alias("above_max"))


# --------------------------------------------------------------------- A-13
def revenue(tx_fees: DataFrame) -> DataFrame:
    return completed(tx_fees).groupBy("tenant_id", _day("created_at").alias("metric_date")).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("fee"), _zero()).alias("revenue"))


# --------------------------------------------------------------------- A-14
def payment_outcomes(payments: DataFrame) -> DataFrame:
    s = F.col("status")
    r = payments.groupBy("payment_method").agg(
        F.count(F.lit(1)).alias("payments"),
        _count_if(s == "completed").alias("completed"),
        _count_if(s == "failed").alias("failed"),
        F.sum("refund_amount").alias("refunded_amount"))
    return r.withColumn("success_rate", F.col("completed").cast("double") / F.col("payments").cast("double"))


# --------------------------------------------------------------------- A-15
def unread_notifications(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("user_id", "category").agg(
        F.count(F.lit(1)).alias("total"),
        _count_if(~F.col("is_read")).alias("unread"))


# --------------------------------------------------------------------- A-16
def audit_activity(audit: DataFrame, approximate: bool = False) -> DataFrame:
    users = (F.approx_count_distinct("user_id") if approximate else F.countDistinct("user_id"))
    return audit.groupBy("tenant_id", "entity_type", "action", _day("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("events"), users.alias("distinct_users"))


# --------------------------------------------------------------------- A-17
def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def alert_workload(alerts: DataFrame) -> DataFrame:
    """Alerts by type and status; mean hours from creation to resolution."""
    dur = _micros("resolved_at") - _micros("created_at")
    r = alerts.groupBy("alert_type", "status").agg(
        F.count(F.lit(1)).alias("alerts"),
        F.count("resolved_at").alias("resolved"),
        F.sum(dur).alias("dur_us"))
    mean = (F.col("dur_us").cast("double") / F.col("resolved").cast("double") / F.lit(3600000000.0))
    return r.select("alert_type", "status", "alerts", "resolved",
                    F.when(F.col("resolved") > 0, mean).alias("mean_hours_to_resolve"))


# --------------------------------------------------------------------- A-18
def tier_quota(tenants: DataFrame, users: DataFrame, caps: DataFrame) -> DataFrame:
    """Customers per tenant against the tier's cap; NULL cap = unlimited."""
    per = users.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("customers"))
    j = (tenants.select("tenant_id", "tier").join(per, "tenant_id", "left")
         .join(caps, "tier", "left"))
    n = F.coalesce(F.col("customers"), F.lit(0).cast("bigint"))
    return j.select("tenant_id", "tier", n.alias("customers"), "user_cap",
                    F.coalesce(n > F.col("user_cap"), F.lit(False)).alias("over_cap"))


# --------------------------------------------------------------------- A-19
def tier_billing(tenants: DataFrame, price_list: DataFrame) -> DataFrame:
    """Per tier: tenants, setup and monthly fee, cost, margin, margin % (whole
    percent, half up; NULL for a free tier), setup and monthly revenue, monthly
    profit. Tiers without a price row keep NULL money."""
    per = tenants.groupBy("tier").agg(F.count(F.lit(1)).alias("tenants"))
    j = per.join(price_list, "tier", "left")
    margin = (F.col("monthly_fee") - F.col("monthly_cost")).cast(MONEY)
    pct = F.round(margin * F.lit(100) / F.nullif(F.col("monthly_fee"), F.lit(0).cast(MONEY)), 0).cast("int")
    return j.select("tier", "tenants", "setup_fee", "monthly_fee", "monthly_cost",
                    (F.col("setup_fee") * F.col("tenants")).cast("decimal(20,2)").alias("setup_revenue"),
                    margin.alias("margin"), pct.alias("margin_pct"),
                    (F.col("monthly_fee") * F.col("tenants")).cast("decimal(20,2)").alias("monthly_revenue"),
                    (margin * F.col("tenants")).cast("decimal(20,2)").alias("monthly_profit"))


# --------------------------------------------------------------------- A-20
def error_rate(events: DataFrame, users: DataFrame, width: str = "1 day") -> DataFrame:
    """Share of failed events per tenant and clock-aligned window. Events of
    unknown users (a failed sign-in) count under the NULL tenant."""
    e = events.join(users.select("user_id", "tenant_id"), "user_id", "left")
    r = e.groupBy("tenant_id", F.window("ts", width).alias("w")).agg(
        F.count(F.lit(1)).alias("events"),
        _count_if(F.col("event_type") == "error").alias("errors"))
    return r.select("tenant_id", F.col("w.start").alias("window_start"), "events", "errors",
                    (F.col("errors").cast("double") / F.col("events").cast("double")).alias("error_rate"))
