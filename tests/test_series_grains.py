"""Portfolio history at day and week grain against a plain replay."""
import datetime as dt
from collections import defaultdict
from decimal import Decimal

from pyspark.sql import functions as F

from auric.functions import scalars as X
from auric.operators import compliance as M
from auric.operators import series as Q


def _tx(spark, rows):
    """rows: (user, asset, day offset, type, quantity, price)"""
    t0 = dt.datetime(2001, 1, 1, 12)
    full = [(1, u, i, 1, k, a, Decimal(q), Decimal(p), "completed", t0 + dt.timedelta(days=d), 1, 1, 0.0)
            for i, (u, a, d, k, q, p) in enumerate(rows)]
    return spark.createDataFrame(full, "tenant_id long, user_id long, order_id long, line_no int, transaction_type string, "
                                       "asset_type string, quantity decimal(20,8), price decimal(15,2), status string, "
                                       "created_at timestamp_ntz, partkey long, suppkey long, ext double")


ROWS = [(1, "GOLD", 0, "BUY", 2, 100), (2, "GOLD", 3, "BUY", 1, 110), (1, "SILVER", 4, "BUY", 10, 5),
        (1, "GOLD", 9, "SELL", 1, 90), (2, "SILVER", 12, "BUY", 1, 7)]


def test_history_uses_the_price_of_the_time(spark):
    tx = _tx(spark, ROWS)
    for grain, step in (("day", 1), ("week", 7)):
        got = {(r.user_id, r[grain]): r.portfolio_value
               for r in Q.portfolio_history(tx, Q.ledger_ticks(tx), "2001-01-20", grain).collect()}
        want = {}
        for k in range(0, 20, step):  # 2001-01-01 is a Monday
            bal, price = defaultdict(Decimal), {}
            for u, a, d, kind, q, p in ROWS:
                if d < k + step:
                    bal[u, a] += q if kind == "BUY" else -q
                    price[a] = p
            for u in {x for x, _ in bal}:
                want[u, dt.date(2001, 1, 1) + dt.timedelta(days=k)] = sum(
                    b * price[a] for (x, a), b in bal.items() if x == u)
        assert got == want


def test_audit_diff_goes_by_presence_of_keys(spark):
    rows = [(1, '{"a":null,"b":1,"c":2}', '{"a":null,"b":null,"d":3}')]
    df = spark.createDataFrame(rows, "id long, old_values string, new_values string").withColumns(
        {"tenant_id": F.lit(1), "user_id": F.lit(1), "created_at": F.lit(None).cast("timestamp_ntz")})
    assert {(r.key, r.kind) for r in M.audit_diff(df).collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}


def test_reconciliation_counts_money_received(spark):
    tx = spark.createDataFrame([(1, 7, Decimal(10)), (2, 7, Decimal(4))], "tenant_id long, order_id long, total_value decimal(15,2)")
    pay = spark.createDataFrame([(1, 7, Decimal(10), Decimal(0), "failed"), (1, 7, Decimal(6), Decimal(0), "completed"),
                                 (1, 7, Decimal(4), Decimal(1), "completed"), (2, 7, Decimal(4), Decimal(0), "failed")],
                                "tenant_id long, order_id long, amount decimal(15,2), refund_amount decimal(15,2), status string")
    got = {(r.tenant_id, r.state, r.net_received) for r in M.payment_reconciliation(tx, pay).collect()}
    assert got == {(1, "matched", Decimal("9.00")), (2, "missing_payment", None)}


def test_iso_text(spark):
    df = spark.createDataFrame([(dt.datetime(2001, 2, 3, 4, 5, 6, 789000),)], "t timestamp_ntz")
    assert df.select(X.iso_text(F.col("t")).alias("s")).first().s == "2001-02-03T04:05:06.789Z"


def test_funnel_without_users_has_null_rates(spark):
    web = spark.createDataFrame([], "event_id long, user_id long, step string, ts timestamp_ntz")
    assert [(r.users, r.step_rate, r.overall_rate) for r in Q.conversion_funnel(web).collect()] == [(0, None, None)] * 5


def test_filled_rows_are_neither_shuffled_nor_sorted_twice(spark):
    """Closings are dealt by user before they are filled forward, into many tasks."""
    df = Q.period_return(Q.portfolio_history(_tx(spark, ROWS), None, "2001-12-31", "week"), "week")
    text = df._jdf.queryExecution().executedPlan().toString()
    above = text[:text.index("Generate explode(sequence")]
    assert "Exchange hashpartitioning" not in above and above.count("Sort [") == 1
    assert "Exchange hashpartitioning(tenant_id" in text and f", {Q.FILL_TASKS})" in text


def test_returns_of_missing_values_and_years(spark):
    rows = [(1, None, dt.date(2000, 11, 1), 10), (1, None, dt.date(2000, 12, 1), 20), (1, None, dt.date(2001, 1, 1), None),
            (1, None, dt.date(2001, 2, 1), 30), (1, 2, dt.date(2001, 3, 1), 4), (1, 2, dt.date(2001, 4, 1), 6),
            (1, 2, dt.date(2002, 4, 1), 3)]
    df = spark.createDataFrame([(*r[:3], None if r[3] is None else Decimal(r[3])) for r in rows],
                               "tenant_id long, user_id long, month date, portfolio_value decimal(18,2)")
    got = {(r.user_id, r.month): (r.change, r.change_pct, r.ytd_pct) for r in Q.period_return(df).collect()}
    assert got == {(None, rows[0][2]): (None, None, 0.0), (None, rows[1][2]): (10, 100.0, 100.0),
                   (None, rows[2][2]): (None, None, None), (None, rows[3][2]): (None, None, None),
                   (2, rows[4][2]): (None, None, 0.0), (2, rows[5][2]): (2, 50.0, 50.0), (2, rows[6][2]): (-3, -50.0, 0.0)}
