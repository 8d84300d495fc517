"""Streams with keyed state: requests and ledger rows that arrive out of order or
late give the results of the batch operators."""

import datetime as dt
import random
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from auric.operators import folds
from auric.operators import holdings as H
from auric.streaming import jobs as Wj
from auric.streaming import keyed
from ledger_model import replay_clamped

T0 = dt.datetime(2001, 1, 1)


@pytest.fixture(scope="module")
def scratch(tmp_path_factory):
    return str(tmp_path_factory.mktemp("keyed"))


def files(spark, rows, schema, path, n):
    """``rows`` in the given order, in ``n`` files that a stream takes one by one."""
    step = -(-len(rows) // n)
    for k in range(n):
        spark.createDataFrame(rows[k * step:(k + 1) * step], schema).coalesce(1).write.parquet(f"{path}/f={k:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


REQUEST = "client long, ts timestamp_ntz, event_id long"


def some_requests(n=400):
    r, t, rows = random.Random(5), 0, []
    for i in range(n):
        t += r.choice([1, 1, 2, 4, 9, 30])
        rows.append((r.choice([1, 1, 1, 2, 3]), T0 + dt.timedelta(seconds=t), i))
    return rows


def batch_decisions(spark, rows):
    got = folds.leaky_bucket(spark.createDataFrame(rows, REQUEST), (1, 10), 2).collect()
    return {(r.client, r.event_id): r.refused for r in got}


def run_bucket(spark, rows, scratch, n_files, watermark):
    name = uuid.uuid4().hex
    # A request of a client of its own, long after the others, moves the watermark past them.
    rows = [*rows, (-1, T0 + dt.timedelta(days=30), -1)]
    stream = files(spark, rows, REQUEST, f"{scratch}/{name}", n_files)
    out = f"{scratch}/{name}_out"
    Wj.run_available_now(keyed.leaky_bucket_stream(stream, (1, 10), 2, watermark), name, keyed.decisions_writer(out), "append")
    return out


def test_w03_shuffled_requests_are_folded_in_order(spark, scratch):
    rows = some_requests()
    arrival = sorted(rows, key=lambda x: (x[1] + dt.timedelta(seconds=random.Random(x[2]).randint(0, 290))))
    assert arrival != rows
    out = run_bucket(spark, arrival, scratch, 6, "5 minutes")
    got = keyed.decisions(spark, out).where("client > 0").collect()
    assert not any(r.late for r in got) and len(got) == len(rows)
    want = batch_decisions(spark, rows)
    assert {(r.client, r.event_id): r.refused for r in got} == want and 20 < sum(want.values()) < 350


def test_w03_late_requests_are_set_aside_and_counted(spark, scratch):
    rows = some_requests()
    late = [x for x in rows if x[2] % 50 == 7]  # they arrive last, long after their time
    out = run_bucket(spark, [x for x in rows if x not in late] + late, scratch, 8, "1 minute")
    got = keyed.decisions(spark, out).where("client > 0").collect()
    assert len(got) == len(rows)
    aside = {r.event_id for r in got if r.late}
    assert {x[2] for x in late[:-1]} <= aside <= {x[2] for x in late}
    assert all(r.refused is None for r in got if r.late)
    folded = [x for x in rows if x[2] not in aside]
    assert {(r.client, r.event_id): r.refused for r in got if not r.late} == batch_decisions(spark, folded)
    counts = keyed.decision_counts(spark, out).agg(F.sum("decided"), F.sum("refused"), F.sum("late")).first()
    assert counts[0] + counts[2] == len(rows) and counts[2] == len(aside)


def test_w03_repeated_requests_count_each(spark, scratch):
    rows = [(1, T0, 7)] * 5
    out = run_bucket(spark, rows, scratch, 2, "1 minute")
    got = [r.refused for r in keyed.decisions(spark, out).where("client = 1").collect()]
    assert sorted(got) == [False, False, False, True, True]


# ------------------------------------------------------------------------ W-05
def test_day_summaries_scan_to_the_replay():
    r = random.Random(6)
    for _ in range(300):
        rows = [(r.randint(0, 5) * 86_400_000_000 + r.randint(0, 9), i, 1, 1, 1, 0.0, Decimal(r.randint(1, 9)), r.random() < 0.5)
                for i in range(r.randint(1, 14))]
        days = {}
        for x in rows:
            days.setdefault(x[0] // 86_400_000_000, []).append(x)
        got = keyed.scan(keyed.summarise(sorted(v, key=keyed._in_order)) for _, v in sorted(days.items()))
        events = [("k", keyed._in_order(x), "BUY" if x[7] else "SELL", x[6]) for x in rows]
        balance, created, _ = replay_clamped(events)["k"]
        assert got == (balance, created[0][1] if balance else None)


def holdings(df):
    return {(r.tenant_id, r.user_id, r.asset_type, r.quantity, r.created_at) for r in df.collect()}


def test_w05_rows_in_any_order_equal_h03(spark, fx_small, scratch):
    tx = fx_small.tx
    name = uuid.uuid4().hex
    rows = [tuple(x) for x in tx.orderBy("order_id", "line_no").collect()]
    random.Random(2).shuffle(rows)
    stream = files(spark, rows, tx.schema, f"{scratch}/{name}", 4)
    log = f"{scratch}/{name}_log"
    Wj.run_available_now(keyed.live_holdings_stream(stream), name, Wj.changelog_writer(log))
    want = holdings(H.holdings_from_ledger(tx))
    assert holdings(Wj.current_holdings(spark, log)) == want and len(want) > 100
    # A trigger hands back the keys it touched, and no others.
    first = spark.createDataFrame(rows[:-(-len(rows) // 4)], tx.schema)
    touched = first.where("status = 'completed' AND transaction_type IN ('BUY', 'SELL')").select(*H.TX_KEY).distinct().count()
    assert spark.read.parquet(f"{log}/batch_id=0").count() == touched


def test_w05_null_times_and_keys(spark, fx_small, scratch):
    tx = fx_small.tx.where("status = 'completed'").limit(40)
    name = uuid.uuid4().hex
    odd = tx.withColumn("created_at", F.when(F.col("line_no") > 2, F.col("created_at"))).withColumn(
        "tenant_id", F.when(F.col("line_no") > 3, F.col("tenant_id")))
    rows = [tuple(x) for x in odd.collect()]
    stream = files(spark, rows + rows, tx.schema, f"{scratch}/{name}", 2)
    log = f"{scratch}/{name}_log"
    Wj.run_available_now(keyed.live_holdings_stream(stream), name, Wj.changelog_writer(log))
    twice = spark.createDataFrame(rows + rows, tx.schema)
    assert holdings(Wj.current_holdings(spark, log)) == holdings(H.holdings_from_ledger(twice))
