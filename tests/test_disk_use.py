"""What large tables leave on disk: shared exchanges, pushed filters, rows that a columnar file can pack."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from auric.operators import compliance as M
from auric.operators import series as Q
from auric.plans.registry import REGISTRY, load_all

T0 = dt.datetime(2001, 1, 1)


def lines(df, *words):
    text = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return [x for x in text.split("\n") if all(w in x for w in words)]


def test_crossings_of_many_users_are_many_tasks_and_in_one_order(spark):
    n = 3000
    users = spark.createDataFrame([(i, "GOLD", Decimal(100)) for i in range(n)],
                                  "user_id long, asset_type string, threshold decimal(15,2)")
    ticks = spark.createDataFrame([("GOLD", T0 + dt.timedelta(hours=i), Decimal(90 + 20 * (i % 2)), i) for i in range(9)],
                                  "asset_type string, ts timestamp_ntz, price decimal(15,2), event_id long")
    rows = Q.price_alert(ticks, users).withColumns(
        {"task": F.spark_partition_id(), "at": F.monotonically_increasing_id()}).collect()
    assert len(rows) == 8 * n and len({(r.event_id, r.user_id) for r in rows}) == 8 * n
    tasks = {r.task for r in rows}
    assert len(tasks) > 1
    for task in tasks:  # a crossing's users of a part lie together, and every crossing has them in the same order
        own = sorted((r for r in rows if r.task == task), key=lambda r: r.at)
        runs = [[own[0]]]
        for a, b in zip(own, own[1:]):
            if a.event_id != b.event_id:
                runs.append([])
            runs[-1].append(b)
        orders = {tuple(r.user_id for r in run) for run in runs}
        assert len(orders) * 8 == len(runs) and all(len(x) < 2 * Q.USERS_PER_PART for x in orders)


def test_alerts_of_users_without_an_id_and_twice(spark):
    users = spark.createDataFrame([(None, "GOLD", Decimal(100)), (1, "GOLD", Decimal(100)), (1, "GOLD", Decimal(100)),
                                   (2, None, Decimal(100)), (3, "GOLD", None)],
                                  "user_id long, asset_type string, threshold decimal(15,2)")
    ticks = spark.createDataFrame([("GOLD", T0, Decimal(90), 1), ("GOLD", T0 + dt.timedelta(hours=1), Decimal(110), 2)],
                                  "asset_type string, ts timestamp_ntz, price decimal(15,2), event_id long")
    got = [(r.user_id, r.event_id, r.direction) for r in Q.price_alert(ticks, users).collect()]
    assert sorted(got, key=str) == [(1, 2, "UP"), (1, 2, "UP"), (None, 2, "UP")]


def test_history_derives_and_deals_the_ledger_once(spark, fx_small):
    """Balances and prices share the exchange of the trades, so its rows lie on disk once."""
    df = Q.period_return(Q.portfolio_history(fx_small.tx, None, "2001-12-01", "week"), "week")
    df.collect()
    assert len(lines(df, "FileScan", "l_orderkey")) == 1


def test_history_without_an_asset_or_a_time(spark):
    """A trade without an asset has no price, one without a time moves the balance and gives no price."""
    from test_ledger import make_tx
    tx = make_tx(spark, [(1, "GOLD", 0, "BUY", 5), (1, "GOLD", 10, "BUY", 2), (2, "SILVER", 10, "BUY", 3)])
    tx = tx.withColumn("created_at", F.when(F.col("order_id") != F.lit(tx.agg(F.min("order_id")).first()[0]), F.col("created_at")))
    tx = tx.withColumn("asset_type", F.when(F.col("asset_type") == "GOLD", "GOLD"))
    got = {(r.user_id, r.month): r.portfolio_value for r in Q.portfolio_history(tx, None, "2001-01-31").collect()}
    price = tx.filter("user_id = 1 and created_at is not null").first().price
    assert got == {(1, dt.date(2001, 1, 1)): 7 * price, (2, dt.date(2001, 1, 1)): None}


def test_alerts_of_a_period_are_those_of_all_times(spark):
    rows = [(1, u, 10 * u + i, 1, 1, 1, Decimal(60000 if i == 3 else 10), T0 + dt.timedelta(days=d))
            for u in range(1, 4) for i, d in enumerate((0, 2 * u, 7, 8, 9 + u, 16, 17, 30))]
    rows.append((1, 1, 99, 1, 1, 1, Decimal(60000), None))
    tx = spark.createDataFrame(rows, "tenant_id long, user_id long, order_id long, line_no int, partkey long, suppkey long, "
                                     "total_value decimal(15,2), created_at timestamp_ntz")
    users = spark.createDataFrame([(1, 1, 1), (1, 2, 0)], "tenant_id long, user_id long, kyc_level int")
    caps = spark.createDataFrame([(0, Decimal(5)), (1, Decimal(20000))], "kyc_level int, cap decimal(15,2)")
    alerts = lambda *period: M.trade_alerts(tx, users, caps, 45000, 3, 7 * 86400, *period)
    for since, until in (("2001-01-08", "2001-01-12"), ("2001-01-09", None), (None, "2001-01-09"), ("2001-01-17", "2001-01-18")):
        want = alerts()
        want = want.filter(F.col("created_at") >= since) if since else want
        want = want.filter(F.col("created_at") < until) if until else want
        got = sorted(map(str, alerts(since, until).filter("created_at is not null").collect()))
        assert got == sorted(map(str, want.filter("created_at is not null").collect())) and got


def test_a_report_counts_the_trades_of_its_period(spark, fx_small):
    """Every scan of the ledger for the half-year report has a lower bound of the time."""
    load_all()
    scans = lines(REGISTRY["regulatory_report"].build(fx_small), "FileScan", "l_orderkey")
    assert scans and all("GreaterThanOrEqual(l_shipdate" in x for x in scans)


def test_orders_meet_customers_before_lines(fx_small):
    text = fx_small.tx._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("(l_orderkey#") < text.index("(o_custkey#")
