"""Series that are summarised per day: odd rows and hot keys against plain models."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from auric.operators import compliance as M
from auric.operators import holdings as H
from auric.operators import reports as A
from auric.operators import series as Q
from test_ledger import make_tx

T0 = dt.datetime(2001, 1, 1)
WEB = "event_id long, user_id long, step string, ts timestamp_ntz"


def reached(events, steps):
    """Earliest end of every prefix of the steps, by the definition."""
    out, last = [], None
    for k, s in enumerate(steps):
        times = [t for t, x in events if x == s and (k == 0 or (last is not None and t > last))]
        last = min(times) if times and (k == 0 or last is not None) else None
        out.append(last)
    return out


def test_funnel_equals_the_definition(spark):
    r, rows = random.Random(3), []
    for user in range(150):
        for _ in range(r.randint(0, 25)):
            t = T0 + dt.timedelta(minutes=r.choice([0, 1, 5, 700, 1439, 1440, 1441, 2880, 5000]) + r.randint(0, 2))
            rows.append((len(rows), user, r.choice([*Q.FUNNEL_STEPS, "other", None]), t))
    rows += [(len(rows), 500, "landing", None), (len(rows) + 1, None, "landing", T0), (len(rows) + 2, None, "pricing", T0)]
    web = spark.createDataFrame(rows, WEB)
    for steps in (Q.FUNNEL_STEPS, ("pricing", "paid"), ("paid",)):
        want = [0] * len(steps)
        for user in {x[1] for x in rows}:
            for k, t in enumerate(reached([(x[3], x[2]) for x in rows if x[1] == user and x[3] is not None], steps)):
                want[k] += t is not None
        assert [x.users for x in Q.conversion_funnel(web, steps).orderBy("step_no").collect()] == want


def test_status_history_of_odd_and_hot_rows(spark):
    r = random.Random(4)
    rows = [(i, 1 if i % 3 else r.randint(2, 5), r.choice(["pending", "completed", None]), T0 + dt.timedelta(hours=r.randint(0, 400)))
            for i in range(300)]
    rows += [(900, 1, "late", None), (901, None, "a", T0), (902, None, "b", T0 + dt.timedelta(days=2)), (903, 7, "only", None)]
    df = spark.createDataFrame(rows, "id long, transaction_id long, new_status string, changed_at timestamp_ntz")
    want = {}
    for key in {x[1] for x in rows}:
        own = sorted((x for x in rows if x[1] == key), key=lambda x: (x[3] is not None, x[3] or T0, x[0]))
        for k, x in enumerate(own):
            nxt = own[k + 1][3] if k + 1 < len(own) else None
            secs = (nxt - x[3]).total_seconds() if nxt is not None and x[3] is not None else None
            want[x[0]] = (own[k - 1][2] if k else None, secs)
    assert {x.id: (x.previous_status, x.seconds_in_status) for x in Q.status_history(df).collect()} == want


def test_a_level_that_every_user_watches_is_many_keys(spark, monkeypatch):
    monkeypatch.setattr(Q, "USERS_PER_PART", 50)
    users = spark.range(1000).select(F.col("id").alias("user_id"), F.lit("GOLD").alias("asset_type"),
                                     F.lit(Decimal("100.00")).cast("decimal(15,2)").alias("threshold"))
    ticks = spark.createDataFrame([("GOLD", T0 + dt.timedelta(hours=i), Decimal(90 + 20 * (i % 2)), i) for i in range(4)],
                                  "asset_type string, ts timestamp_ntz, price decimal(15,2), event_id long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = Q.price_alert(ticks, users).withColumn("task", F.spark_partition_id())
        assert got.count() == 3000 and got.select("task").distinct().count() >= 6
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_history_prices_of_the_ledger_itself(spark, fx_small):
    for grain in ("day", "week", "month"):
        own = Q.portfolio_history(fx_small.tx, None, "1999-06-30", grain)
        given = Q.portfolio_history(fx_small.tx, Q.ledger_ticks(fx_small.tx), "1999-06-30", grain)
        assert sorted(map(str, own.collect())) == sorted(map(str, given.collect()))


def test_period_balances_of_rows_without_a_time(spark):
    tx = make_tx(spark, [(1, "GOLD", 0, "BUY", 5), (1, "GOLD", 60, "BUY", 2)])
    tx = tx.withColumn("created_at", F.when(F.col("order_id") == 1, F.col("created_at")))
    got = Q.period_end_balances(tx, "2001-02-10").orderBy("period").collect()
    assert [(str(r.period), r.balance) for r in got] == [("2001-01-01", 7), ("2001-02-01", 7)]


def test_null_keys_meet_in_holdings(spark):
    tx = make_tx(spark, [(1, "GOLD", 0, "BUY", 10), (1, "GOLD", 5, "BUY", 4), (1, "GOLD", 9, "SELL", 3)])
    tx = tx.withColumn("asset_type", F.lit(None).cast("string"))
    held = spark.createDataFrame([(1, 1, None, Decimal(6), Decimal("7.00"), T0 - dt.timedelta(days=1))],
                                 "tenant_id long, user_id long, asset_type string, quantity decimal(20,8), "
                                 "current_price decimal(15,2), created_at timestamp_ntz")
    added = H.add_tokens(held, tx.where("transaction_type = 'BUY'")).collect()
    assert [(r.quantity, r.current_price, r.created_at) for r in added] == [(20, Decimal("7.00"), T0 - dt.timedelta(days=1))]
    left = H.remove_tokens(held, tx.where("transaction_type = 'SELL'")).collect()
    assert [(r.asset_type, r.quantity) for r in left] == [(None, 3)]
    old = held.withColumnRenamed("created_at", "updated_at")
    same = H.touch_updated_at(old, held.select(*H.TX_KEY, "quantity"), "2002-01-01 00:00:00").collect()
    assert [r.updated_at for r in same] == [T0 - dt.timedelta(days=1)]


def test_error_rate_counts_events_of_unknown_users(spark):
    events = spark.createDataFrame([(1, "error", T0), (9, "error", T0), (None, "view", T0)], "user_id long, event_type string, ts timestamp_ntz")
    users = spark.createDataFrame([(1, 7)], "user_id long, tenant_id long")
    got = {(r.tenant_id, r.events, r.errors) for r in A.error_rate(events, users).collect()}
    assert got == {(7, 1, 1), (None, 2, 1)}


def test_velocity_of_null_and_busy_users(spark):
    rows = [(1, "GOLD", k // 3, "BUY", 1) for k in range(12)] + [(2, "GOLD", 0, "BUY", 1)]
    tx = make_tx(spark, rows)
    both = tx.unionByName(tx.withColumn("user_id", F.lit(None).cast("long")).withColumn("order_id", F.col("order_id") + 100))
    got = [r.user_id for r in M.alert_velocity(both, 6, 120).collect()]
    times = {}
    for row in both.collect():
        times.setdefault(row.user_id, []).append(row.created_at)
    want = [u for u, ts in times.items() for t in ts
            if sum(t - dt.timedelta(seconds=120) <= x <= t for x in ts) >= 6]
    assert sorted(map(str, got)) == sorted(map(str, want)) and None in got
