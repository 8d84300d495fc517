"""Edge cases of the reporting views and filters."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from auric.operators import filters as P
from auric.operators import reports as A
from auric.operators import compliance as M
from auric.sources import dims


def test_empty_tenant_kept_with_zeros_and_redeem_counted(spark):
    tenants = spark.createDataFrame([(1, "A"), (2, "B")], "tenant_id long, company_name string")
    tx = spark.createDataFrame(
        [(1, "BUY", "completed", Decimal("10.00")), (1, "REDEEM", "completed", Decimal("5.00")),
         (1, "SELL", "pending", Decimal("7.00"))],
        "tenant_id long, transaction_type string, status string, total_value decimal(15,2)")
    r = {x.tenant_id: x for x in A.transaction_summary(tenants, tx).collect()}
    assert r[2].total_transactions == 0 and r[2].total_volume == Decimal("0.00")
    assert r[1].total_transactions == 2 and r[1].buy_transactions == 1 and r[1].sell_transactions == 0
    assert r[1].total_volume == Decimal("15.00")  # REDEEM is in the total, in neither side
    # A-04 grouped form drops the empty tenant
    assert {x.tenant_id for x in A.trading_metrics(tx).collect()} == {1}


def test_null_name_part_gives_null_user_name(spark):
    tenants = spark.createDataFrame([(1, "A")], "tenant_id long, company_name string")
    users = spark.createDataFrame([(1, 1, "Asha", None), (1, 2, "Ravi", "K")],
                                  "tenant_id long, user_id long, first_name string, last_name string")
    h = spark.createDataFrame([(1, 1, "GOLD", Decimal(1), Decimal(1), Decimal(1)),
                               (1, 2, "GOLD", Decimal(1), Decimal(1), Decimal(1))],
                              "tenant_id long, user_id long, asset_type string, quantity decimal(20,8), "
                              "current_price decimal(15,2), total_value decimal(15,2)")
    names = {r.user_id: r.user_name for r in A.portfolio_view(tenants, users, h).collect()}
    assert names == {1: None, 2: "Ravi K"}


def test_default_fill_only_omitted_columns(spark):
    df = spark.createDataFrame([(1, None)], "user_id long, kyc_status string")
    r = P.default_fill(df, {"kyc_status": "pending", "kyc_level": 0}).first()
    assert r.kyc_status is None and r.kyc_level == 0


def test_tier_cap_null_is_unlimited(spark):
    tenants = spark.createDataFrame([(1, "enterprise"), (2, "lite")], "tenant_id long, tier string")
    users = spark.createDataFrame([(1,)] * 200 + [(2,)] * 101, "tenant_id long")
    r = {x.tenant_id: x.over_cap for x in A.tier_quota(tenants, users, dims.tier_caps(spark)).collect()}
    assert r == {1: False, 2: True}


def test_listing_puts_null_created_first(spark):
    h = spark.createDataFrame([(1, 1, "GOLD", dt.datetime(2001, 1, 1)), (1, 1, "SILVER", None)],
                              "tenant_id long, user_id long, asset_type string, created_at timestamp_ntz")
    r = A.portfolio_listing(h).orderBy("listing_pos").collect()
    assert [x.asset_type for x in r] == ["SILVER", "GOLD"]


def test_regulatory_report_json(spark, fx_small):
    alerts = M.alert_high_amount(fx_small.tx, 45000)
    r = M.regulatory_report(fx_small.tx, alerts, "2001-01-01", "2001-06-30", 45000)
    row = r.filter(F.col("report_type") == "FIU").orderBy("tenant_id").first()
    import json
    d = json.loads(row.report_data)
    assert d["type"] == "FIU" and d["n"] == row.n and Decimal(str(d["amount"])) == row.amount


def test_velocity_buckets_match_brute_force(spark):
    """A very active user across many 7-day buckets: exact trailing counts."""
    import random
    rnd = random.Random(3)
    base = dt.datetime(2000, 1, 1)
    rows, times = [], []
    for i in range(400):
        t = base + dt.timedelta(hours=rnd.randint(0, 24 * 200))
        rows.append((1, 1, i, 1, 1, 1, Decimal("1.00"), t))
        times.append(t)
    tx = spark.createDataFrame(rows, "tenant_id long, user_id long, order_id long, line_no int, partkey long, "
                                     "suppkey long, total_value decimal(15,2), created_at timestamp_ntz")
    span = 7 * 86400
    got = sorted(r.ref for r in M.alert_velocity(tx, 5, span).collect())
    want = sorted(f"{i}|1|1|1" for i, t in enumerate(times)
                  if sum(1 for u in times if 0 <= (t - u).total_seconds() <= span) >= 5)
    assert got == want and len(want) > 50


def test_page_engagement_gap_crosses_midnight(spark):
    from auric.operators import series as Q
    web = spark.createDataFrame(
        [(1, 1, "landing", dt.datetime(2024, 1, 1, 23, 50)), (2, 1, "pricing", dt.datetime(2024, 1, 2, 0, 5)),
         (3, 1, "form", dt.datetime(2024, 1, 2, 3, 0))],
        "event_id long, user_id long, step string, ts timestamp_ntz")
    r = {x.step: x.avg_seconds for x in Q.page_engagement(web, 1800).collect()}
    assert r == {"landing": 900.0}  # the 2 h 55 min gap after 'pricing' exceeds the cap


def test_price_alert_finds_every_crossing(spark, fx_small, monkeypatch):
    """However many bands and parts there are, the crossings are those of a plain comparison of all pairs."""
    from auric.operators import series as Q
    key = lambda r: (r.user_id, r.event_id, r.threshold, r.direction)
    rows = sorted((r.asset_type, r.ts, r.event_id, r.price) for r in fx_small.ticks.collect())
    limits = fx_small.price_thresholds.collect()
    want = []
    for a, b in zip(rows, rows[1:]):
        if a[0] == b[0]:
            want += [(t.user_id, b[2], t.threshold, "UP" if a[3] < b[3] else "DOWN") for t in limits
                     if t.asset_type == a[0] and (a[3] < t.threshold <= b[3] or b[3] < t.threshold <= a[3])]
    for bands, per_part in ((1, 100_000), (4, 3), (256, 100_000)):
        monkeypatch.setattr(Q, "BANDS", bands)
        monkeypatch.setattr(Q, "USERS_PER_PART", per_part)
        got = Q.price_alert(fx_small.ticks, fx_small.price_thresholds).collect()
        assert sorted(map(key, got)) == sorted(want) and want
