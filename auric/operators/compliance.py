"""Compliance (AML) rules and reconciliation.

Every alert rule returns the same shape so the rules can be merged with
``unionByName``: (tenant_id, user_id, alert_type, ref, amount, created_at).
Thresholds are arguments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .holdings import join_nullsafe

MONEY = "decimal(15,2)"
ALERT_COLS = ("tenant_id", "user_id", "alert_type", "ref", "amount", "created_at")


def _tx_ref() -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in ("order_id", "line_no", "partkey", "suppkey")])


def _alert(df: DataFrame, kind: str, ref: Column, amount: Column, ts: Column) -> DataFrame:
    return df.select("tenant_id", "user_id", F.lit(kind).alias("alert_type"), ref.alias("ref"),
                     amount.cast("decimal(18,2)").alias("amount"), ts.alias("created_at"))


# --------------------------------------------------------------------- M-01
def alert_high_amount(tx: DataFrame, threshold) -> DataFrame:
    t = tx.filter(F.col("total_value") >= F.lit(threshold).cast(MONEY))
    return _alert(t, "HIGH_AMOUNT", _tx_ref(), F.col("total_value"), F.col("created_at"))


# --------------------------------------------------------------------- M-02
def _with_cap(tx: DataFrame, users: DataFrame, caps: DataFrame) -> DataFrame:
    """Trades with the cap of their user's KYC level. An unknown user is level
    0; a level that is not listed has no clearance (cap 0). NULL = unlimited."""
    u = users.select("tenant_id", "user_id", "kyc_level")
    c = caps.select("kyc_level", F.struct("cap").alias("_c"))
    j = tx.join(u, ["tenant_id", "user_id"], "left").withColumn("kyc_level", F.coalesce("kyc_level", F.lit(0)))
    cap = F.when(F.col("_c").isNull(), F.lit(0).cast(MONEY)).otherwise(F.col("_c.cap"))
    return j.join(c, "kyc_level", "left").withColumn("cap", cap)


def alert_kyc_limit(tx: DataFrame, users: DataFrame, caps: DataFrame) -> DataFrame:
    """Trades above the cap of the user's KYC level (see :func:`_with_cap`)."""
    t = _with_cap(tx, users, caps).filter(F.col("total_value") > F.col("cap"))
    return _alert(t, "KYC_LIMIT", _tx_ref(), F.col("total_value"), F.col("created_at"))


# --------------------------------------------------------------------- M-03
def alert_daily_limit(tx: DataFrame, tenants: DataFrame, default_limit) -> DataFrame:
    """Completed value per user and day above the tenant's ``maxDailyLimit``
    (brand config), or ``default_limit`` when the tenant sets none. The
    per-day sums are a partial aggregate; the tenant table is small."""
    day = F.to_date("created_at")
    d = (tx.filter(F.col("status") == "completed")
         .groupBy("tenant_id", "user_id", day.alias("day")).agg(F.sum("total_value").alias("day_value")))
    lim = tenants.select("tenant_id", F.get_json_object("brand_config", "$.features.maxDailyLimit")
                         .cast("decimal(18,2)").alias("tenant_limit"))
    j = d.join(lim, "tenant_id", "left")
    limit = F.coalesce(F.col("tenant_limit"), F.lit(default_limit).cast("decimal(18,2)"))
    t = j.filter(F.col("day_value") > limit)
    return _alert(t, "DAILY_LIMIT", F.col("day").cast("string"), F.col("day_value"),
                  F.col("day").cast("timestamp_ntz"))


# --------------------------------------------------------------------- M-04
def alert_velocity(tx: DataFrame, n: int, span_seconds: int) -> DataFrame:
    """SUSPICIOUS_PATTERN: a trade that is the n-th or later within the
    trailing ``span_seconds`` (inclusive) of the same user.

    Trades are first counted per (user, second). These narrow counts are bucketed by
    ``floor(t / span)``, and each is exploded into its own and, as context, the next
    bucket, so everything in ``[t − span, t]`` lies in its own bucket and a window per
    (user, bucket) sums exactly; a hot user is spread over one task per bucket. Only
    the seconds that fire are joined back to the trades."""
    t = _with_seconds(tx)
    hits = _velocity_hits(t, n, span_seconds)
    t = join_nullsafe(t, hits, VELOCITY_KEY, "left_semi").drop("_t")
    return _alert(t, "SUSPICIOUS_PATTERN", _tx_ref(), F.col("total_value"), F.col("created_at"))


VELOCITY_KEY = ["tenant_id", "user_id", "_t"]


def _with_seconds(tx: DataFrame) -> DataFrame:
    return tx.withColumn("_t", F.unix_seconds(F.col("created_at").cast("timestamp")))


def _velocity_hits(timed: DataFrame, n: int, span_seconds: int) -> DataFrame:
    """The (user, second)s that are the n-th trade or later of the trailing span."""
    counts = timed.filter(F.col("_t").isNotNull()).groupBy(*VELOCITY_KEY).agg(F.count(F.lit(1)).alias("_n"))
    b = F.floor(F.col("_t") / F.lit(span_seconds))
    copies = F.array(F.struct(b.alias("b"), F.lit(True).alias("own")), F.struct((b + 1).alias("b"), F.lit(False).alias("own")))
    rows = counts.withColumn("_x", F.explode(copies)).select(*VELOCITY_KEY, "_n", F.col("_x.b").alias("_b"), F.col("_x.own").alias("_own"))
    w = Window.partitionBy("tenant_id", "user_id", "_b").orderBy("_t").rangeBetween(-span_seconds, 0)
    return rows.withColumn("_recent", F.sum("_n").over(w)).filter(F.col("_own") & (F.col("_recent") >= n)).select(*VELOCITY_KEY)


# --------------------------------------------------------- M-01, M-02, M-04
def trade_alerts(tx: DataFrame, users: DataFrame, caps: DataFrame, threshold, n: int, span_seconds: int,
                 since=None, until=None) -> DataFrame:
    """The three rules on single trades (M-01, M-02, M-04): each trade gets its cap
    and whether its second fired, and explodes into the rules that did. Equal to the
    union of the three operators; beside the narrow counts the ledger is read once.

    ``since`` and ``until`` (dates, the first inclusive) ask for the alerts raised
    between them only. These depend on no trade after them nor on one more than a span
    before, so no other trades are counted."""
    at, counted = F.col("created_at"), tx
    if since is not None:
        since = F.lit(since).cast("date").cast("timestamp_ntz")
        tx, counted = tx.filter(at >= since), counted.filter(at >= since - F.make_dt_interval(secs=F.lit(span_seconds)))
    if until is not None:
        until = F.lit(until).cast("date").cast("timestamp_ntz")
        tx, counted = tx.filter(at < until), counted.filter(at < until)
    hits = _velocity_hits(_with_seconds(counted), n, span_seconds).withColumn("_fired", F.lit(True))
    t = _with_cap(join_nullsafe(_with_seconds(tx), hits, VELOCITY_KEY, "left"), users, caps)
    v = F.col("total_value")
    fired = F.array(F.when(v >= F.lit(threshold).cast(MONEY), "HIGH_AMOUNT"),
                    F.when(v > F.col("cap"), "KYC_LIMIT"),
                    F.when(F.col("_fired"), "SUSPICIOUS_PATTERN"))
    return t.select("tenant_id", "user_id", F.explode(F.array_compact(fired)).alias("alert_type"),
                    _tx_ref().alias("ref"), v.cast("decimal(18,2)").alias("amount"), "created_at")


# --------------------------------------------------------------------- M-05
def normalise_name(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, "[^A-Za-z0-9]+", " ")))


def alert_watchlist(users: DataFrame, watchlist: DataFrame, screened_at=None) -> DataFrame:
    """PEP_MATCH: the user's normalised full name equals a listed name. A user
    with an unknown name part has no full name and cannot match. The alert is
    raised at ``screened_at``, the time of the screening run (default: sign-up,
    the first screening), so a later run reports users of any age."""
    full = F.concat(F.col("first_name"), F.lit(" "), F.col("last_name"))
    u = users.withColumn("nname", normalise_name(full))
    wl = watchlist.select(normalise_name(F.col("name")).alias("nname")).distinct()
    t = u.join(wl, "nname", "left_semi")
    at = F.col("created_at") if screened_at is None else F.lit(screened_at).cast("timestamp_ntz")
    return _alert(t, "PEP_MATCH", F.col("nname"), F.lit(None), at)


# --------------------------------------------------------------------- M-06
RISK_WEIGHTS = {"HIGH_AMOUNT": 40, "KYC_LIMIT": 30, "DAILY_LIMIT": 30, "SUSPICIOUS_PATTERN": 20, "PEP_MATCH": 50}


def all_alerts(*rules: DataFrame) -> DataFrame:
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def risk_score(alerts: DataFrame, weights: dict | None = None) -> DataFrame:
    """Per user: weighted sum of the distinct rules that fired, clipped 0…100."""
    weights = weights or RISK_WEIGHTS
    wmap = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    fired = alerts.select("tenant_id", "user_id", "alert_type").distinct()
    s = fired.groupBy("tenant_id", "user_id").agg(
        F.sum(F.coalesce(wmap[F.col("alert_type")], F.lit(0))).alias("raw"),
        F.count(F.lit(1)).alias("rules_fired"))
    return s.select("tenant_id", "user_id", "rules_fired",
                    F.least(F.lit(100), F.greatest(F.lit(0), F.col("raw"))).cast("int").alias("risk_score"))


# --------------------------------------------------------------------- M-07
def regulatory_report(tx: DataFrame, alerts: DataFrame, start, end, cash_threshold) -> DataFrame:
    """Per tenant and report type over [start, end] (both days inclusive):
    FIU = all completed trades, CTR = completed trades ≥ cash threshold,
    STR = alerts raised. Totals also packed into ``report_data`` JSON."""
    lo = F.lit(start).cast("date").cast("timestamp_ntz")
    hi = F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")
    c = tx.filter((F.col("status") == "completed") & (F.col("created_at") >= lo) & (F.col("created_at") < hi))
    big = F.col("total_value") >= F.lit(cash_threshold).cast(MONEY)
    per = c.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("fiu_n"), F.sum("total_value").alias("fiu_amount"),
        F.count(F.when(big, 1)).alias("ctr_n"), F.sum(F.when(big, F.col("total_value"))).alias("ctr_amount"))
    a = (alerts.filter((F.col("created_at") >= lo) & (F.col("created_at") < hi))
         .groupBy("tenant_id").agg(F.count(F.lit(1)).alias("str_n"), F.sum("amount").alias("str_amount")))
    j = per.join(a, "tenant_id", "full_outer")
    rows = F.array(*[F.struct(F.lit(t).alias("report_type"),
                              F.coalesce(F.col(f"{p}_n"), F.lit(0).cast("bigint")).alias("n"),
                              F.coalesce(F.col(f"{p}_amount"), F.lit(0)).cast("decimal(18,2)").alias("amount"))
                     for t, p in (("FIU", "fiu"), ("CTR", "ctr"), ("STR", "str"))])
    r = j.select("tenant_id", F.explode(rows).alias("r")).select("tenant_id", "r.*")
    return r.select("tenant_id", "report_type",
                    F.lit(start).cast("date").alias("reporting_period_start"),
                    F.lit(end).cast("date").alias("reporting_period_end"),
                    "n", "amount",
                    F.to_json(F.struct(F.col("report_type").alias("type"), "n", "amount")).alias("report_data"),
                    F.lit("generated").alias("status"))


# --------------------------------------------------------------------- M-08
def audit_diff(audit: DataFrame) -> DataFrame:
    """Keys added, removed or changed between old_values and new_values, by
    presence of the key: a JSON null is a value."""
    m = "map<string,string>"
    empty = F.create_map().cast(m)
    o = F.coalesce(F.from_json("old_values", m), empty)
    n = F.coalesce(F.from_json("new_values", m), empty)
    d = audit.select("id", "tenant_id", "user_id", "created_at", o.alias("o"), n.alias("n"))
    d = d.select("*", F.explode(F.array_union(F.map_keys("o"), F.map_keys("n"))).alias("key"))
    ov, nv = F.col("o")[F.col("key")], F.col("n")[F.col("key")]
    had, has = F.map_contains_key("o", F.col("key")), F.map_contains_key("n", F.col("key"))
    kind = F.when(~had, "added").when(~has, "removed").when(~ov.eqNullSafe(nv), "changed")
    return (d.select("id", "tenant_id", "user_id", "created_at", "key", ov.alias("old_value"),
                     nv.alias("new_value"), kind.alias("kind"))
              .filter(F.col("kind").isNotNull()))


# --------------------------------------------------------------------- R-01
def payment_reconciliation(tx: DataFrame, payments: DataFrame) -> DataFrame:
    """Ledger totals per (tenant, order) against the money received: matched,
    amount_mismatch, missing_payment, orphan_payment. Only completed payments
    count, summed per order, so failed attempts and retries change nothing;
    refunds are netted in ``net_received``."""
    key = ["tenant_id", "order_id"]
    led = tx.groupBy(*key).agg(F.sum("total_value").cast("decimal(18,2)").alias("ledger_total"))
    p = payments.filter(F.col("status") == "completed").groupBy(*key).agg(
        F.sum("amount").cast("decimal(18,2)").alias("amount"),
        F.sum("refund_amount").cast("decimal(18,2)").alias("refund_amount"))
    j = led.join(p, key, "full_outer")
    state = (F.when(F.col("amount").isNull(), "missing_payment")
             .when(F.col("ledger_total").isNull(), "orphan_payment")
             .when(F.col("amount") == F.col("ledger_total"), "matched").otherwise("amount_mismatch"))
    return j.select(*key, "ledger_total", "amount", "refund_amount",
                    (F.col("amount") - F.col("refund_amount")).alias("net_received"),
                    (F.col("amount") - F.col("ledger_total")).alias("difference"),
                    state.alias("state"))
