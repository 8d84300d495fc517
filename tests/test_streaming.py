"""Streaming jobs (availableNow over files arriving in time order) equal
their batch twins."""

import uuid

import pytest
from pyspark.sql import functions as F

from auric.sources import dims
from auric.streaming import jobs as Wj


@pytest.fixture(scope="module")
def scratch(tmp_path_factory):
    return str(tmp_path_factory.mktemp("streams"))


def _files_by(df, col, fmt, path):
    """Write one parquet file per period, in time order (file names sort)."""
    keys = sorted(r.k for r in df.select(F.date_format(col, fmt).alias("k")).distinct().collect())
    for k in keys:
        df.filter(F.date_format(col, fmt) == k).coalesce(1).write.mode("overwrite").parquet(f"{path}/p={k}")
    return path


def _stream_dirs(spark, base, schema):
    # each period directory is one file; stream the files in name order
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(base)


def test_w01_rate_counts_stream_equals_batch(spark, fx_small, scratch):
    req = fx_small.requests
    src = _files_by(req, "ts", "yyyy-MM-dd", f"{scratch}/req")
    stream = _stream_dirs(spark, src, req.schema)
    log = f"{scratch}/w01_{uuid.uuid4().hex}"
    Wj.run_available_now(Wj.rate_counts_stream(stream, "15 minutes"), f"w01_{uuid.uuid4().hex}",
                         Wj.changelog_writer(log))
    cur = Wj.latest_by_key(spark, log, ["client", "window_start"]).filter("requests > 1")
    got = {(r.client, r.window_start.replace(tzinfo=None), r.requests) for r in cur.collect()}
    want = {(r.client, r.window_start, r.requests) for r in Wj.rate_violations(req, "15 minutes", 1).collect()}
    assert got == want and len(want) == 13


def test_w04_live_metrics_equals_batch(spark, fx_small, scratch):
    tx = fx_small.tx
    src = _files_by(tx, "created_at", "yyyy-MM", f"{scratch}/tx4")
    stream = _stream_dirs(spark, src, tx.schema)
    log = f"{scratch}/w04_{uuid.uuid4().hex}"
    Wj.run_available_now(Wj.live_metrics_stream(stream, "1 day"), f"w04_{uuid.uuid4().hex}",
                         Wj.changelog_writer(log))
    cur = Wj.latest_by_key(spark, log, ["tenant_id", "asset_type", "window_start"])
    norm = lambda rows: {(r.tenant_id, r.asset_type, r.window_start.replace(tzinfo=None), r.transactions,
                          r.volume) for r in rows}
    assert norm(cur.collect()) == norm(Wj.live_metrics(tx, "1 day").collect())


def test_w06_stream_static_alerts_equal_batch(spark, fx_small, scratch):
    tx = fx_small.tx
    src = _files_by(tx, "created_at", "yyyy", f"{scratch}/tx6")
    stream = _stream_dirs(spark, src, tx.schema)
    caps = dims.kyc_level_caps(spark, {0: 0, 1: 20000, 2: 40000, 3: None})
    out = f"{scratch}/w06_{uuid.uuid4().hex}"
    Wj.run_available_now(Wj.live_alerts(stream, fx_small.users, 45000, caps), f"w06_{uuid.uuid4().hex}",
                         Wj.changelog_writer(out), output_mode="append")
    key = lambda r: (r.alert_type, r.ref, r.amount)
    got = sorted(key(r) for r in spark.read.parquet(out).collect())
    want = sorted(key(r) for r in Wj.live_alerts(tx, fx_small.users, 45000, caps).collect())
    assert got == want


def test_w02_sliding_failures_stream_equals_batch(spark, fx_small, scratch):
    audit = fx_small.audit_logs
    src = _files_by(audit, "created_at", "yyyy-MM-dd", f"{scratch}/audit")
    stream = _stream_dirs(spark, src, audit.schema)
    log = f"{scratch}/w02_{uuid.uuid4().hex}"
    Wj.run_available_now(Wj.login_failure_counts_stream(stream, "1 day", "6 hours"), f"w02_{uuid.uuid4().hex}",
                         Wj.changelog_writer(log))
    cur = Wj.latest_by_key(spark, log, ["user_id", "window_start"]).filter("failures >= 2")
    got = {(r.user_id, r.window_start.replace(tzinfo=None), r.failures) for r in cur.collect()}
    want = {(r.user_id, r.window_start, r.failures)
            for r in Wj.login_failures(audit, "1 day", "6 hours", 2).collect()}
    assert got == want and len(want) > 0


def test_changelog_compaction_keeps_latest_state(spark, scratch):
    log, base = f"{scratch}/cl_{uuid.uuid4().hex}", f"{scratch}/base_{uuid.uuid4().hex}"
    w = Wj.changelog_writer(log)
    w(spark.createDataFrame([(1, 10), (2, 20)], "k long, v long"), 0)
    w(spark.createDataFrame([(1, 11)], "k long, v long"), 1)
    w(spark.createDataFrame([(3, 30)], "k long, v long"), 2)
    Wj.compact_changelog(spark, log, ["k"], 1, base)
    assert {(r.k, r.v) for r in spark.read.parquet(base).collect()} == {(1, 11), (2, 20)}
    assert {(r.k, r.v) for r in Wj.latest_by_key(spark, log, ["k"]).collect()} == {(1, 11), (2, 20), (3, 30)}
    both = Wj.latest_by_key(spark, log, ["k"], base=base)  # the base and the batches after it
    assert {(r.k, r.v) for r in both.collect()} == {(1, 11), (2, 20), (3, 30)}
    w(spark.createDataFrame([(2, None)], "k long, v long"), 0)  # the log's old batches are no longer read
    assert {(r.k, r.v) for r in Wj.latest_by_key(spark, log, ["k"], base=base).collect()} == {(1, 11), (2, 20), (3, 30)}


def test_replayed_batch_replaces_its_earlier_attempt(spark, scratch):
    log = f"{scratch}/idem_{uuid.uuid4().hex}"
    w = Wj.changelog_writer(log)
    w(spark.createDataFrame([(1, 10), (2, 20)], "k long, v long"), 0)
    w(spark.createDataFrame([(1, 10), (2, 20)], "k long, v long"), 0)  # replay of batch 0
    assert spark.read.parquet(log).count() == 2


# ------------------------------------------------- windows that lose no late row
def _with_late_days(spark, df, col, scratch):
    """A stream of the table by day, in which two days arrive after all others."""
    name = uuid.uuid4().hex
    days = sorted(r.k for r in df.select(F.date_format(col, "yyyy-MM-dd").alias("k")).distinct().collect())
    late = days[1:3]
    for k in [d for d in days if d not in late] + late:
        df.filter(F.date_format(col, "yyyy-MM-dd") == k).coalesce(1).write.parquet(f"{scratch}/{name}/p={k}")
    return _stream_dirs(spark, f"{scratch}/{name}", df.schema), late


def _counts(spark, out):
    return spark.read.parquet(f"{out}/counts").agg(F.sum("rows_in"), F.sum("counted"), F.sum("set_aside")).first()


def test_w01_late_requests_are_set_aside_and_counted(spark, fx_small, scratch):
    req = fx_small.requests
    stream, late = _with_late_days(spark, req, "ts", scratch)
    out = f"{scratch}/{uuid.uuid4().hex}"
    Wj.run_available_now(stream, uuid.uuid4().hex, Wj.rate_counts_writer(out), "append")
    aside = spark.read.parquet(f"{out}/late")
    assert {str(r.d) for r in aside.select(F.to_date("ts").alias("d")).distinct().collect()} == set(late)
    rows_in, counted, set_aside = _counts(spark, out)
    assert rows_in == req.count() == counted + set_aside and set_aside == aside.count() > 0
    kept = req.join(aside.select("event_id"), "event_id", "left_anti")
    want = {(r.client, r.window_start, r.requests) for r in Wj.rate_violations(kept, "15 minutes", 0).collect()}
    got = Wj.window_totals(spark, out, ["client"])
    assert {(r.client, r.window_start, r.requests) for r in got.collect()} == want
    # Adding the rows set aside gives what the batch operator finds in all of them.
    both = got.select("client", "window_start", "requests").unionByName(
        Wj.rate_violations(aside.select("client", "ts"), "15 minutes", 0).select("client", "window_start", "requests"))
    whole = {(r.client, r.window_start, r.n) for r in both.groupBy("client", "window_start").agg(F.sum("requests").alias("n")).collect()}
    assert whole == {(r.client, r.window_start, r.requests) for r in Wj.rate_violations(req, "15 minutes", 0).collect()}


def test_w02_and_w04_in_time_order_set_nothing_aside(spark, fx_small, scratch):
    audit, tx = fx_small.audit_logs, fx_small.tx
    out = f"{scratch}/{uuid.uuid4().hex}"
    stream = _stream_dirs(spark, _files_by(audit, "created_at", "yyyy-MM", f"{scratch}/audit8"), audit.schema)
    Wj.run_available_now(stream, uuid.uuid4().hex, Wj.login_failure_writer(out, "1 day", "6 hours"), "append")
    got = {(r.user_id, r.window_start, r.failures) for r in Wj.window_totals(spark, out, ["user_id"]).collect()}
    want = {(r.user_id, r.window_start, r.failures) for r in Wj.login_failures(audit, "1 day", "6 hours", 1).collect()}
    rows_in, counted, aside = _counts(spark, out)
    assert got == want and rows_in == counted == sum(x[2] for x in want) and aside == 0

    out = f"{scratch}/{uuid.uuid4().hex}"
    stream = _stream_dirs(spark, _files_by(tx, "created_at", "yyyy", f"{scratch}/tx8"), tx.schema)
    Wj.run_available_now(stream, uuid.uuid4().hex, Wj.live_metrics_writer(out), "append")
    cols = ["tenant_id", "asset_type", "window_start", "transactions", "buy_orders", "sell_orders", "quantity", "volume",
            "buy_volume", "sell_volume"]
    norm = lambda df: {tuple(r) for r in df.select(*cols).collect()}
    assert norm(Wj.window_totals(spark, out, ["tenant_id", "asset_type"])) == norm(Wj.live_metrics(tx))


def test_windowed_writer_replays_a_batch(spark, scratch):
    rows = lambda *t: spark.createDataFrame([(1, s) for s in t], "client long, s long").select(
        "client", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"))
    out = f"{scratch}/{uuid.uuid4().hex}"
    w = Wj.rate_counts_writer(out, "1 minute", "30 seconds")
    w(rows(5, 10, 70), 0)
    for _ in range(2):
        w(rows(100, 20, 65, 500), 1)  # the watermark is 40: nothing is closed
    w(rows(30, 469, 420), 2)  # the watermark is 470: the first minutes are closed, [420, 480) is open
    counts = [tuple(r)[:3] for r in spark.read.parquet(f"{out}/counts").orderBy("batch_id").collect()]
    assert counts == [(3, 3, 0), (4, 4, 0), (3, 2, 1)]
    got = {(int(r.window_start.timestamp()), r.requests) for r in Wj.window_totals(spark, out, ["client"]).collect()}
    assert got == {(0, 3), (60, 3), (420, 2), (480, 1)}
