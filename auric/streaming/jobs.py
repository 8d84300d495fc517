"""Structured Streaming twins of the batch operators.

Conventions shared by every job:

* Event time arrives as ``TIMESTAMP_NTZ``; ``withWatermark`` refuses NTZ, so
  it is cast to ``TIMESTAMP`` (session zone pinned to UTC) first.
* Late data: 10-minute watermark by default. The windowed streams on Spark's own
  state drop rows later than that; :func:`windowed_writer` sets them aside and
  counts them. W-03 and W-05 keep state per key (:mod:`auric.streaming.keyed`).
* Sinks are upserts by key written through ``foreachBatch`` as a changelog
  with one ``batch_id=N`` directory per micro-batch; the current table is the
  latest row per key (:func:`latest_by_key`). A batch overwrites its own
  directory, so a replay after a lost executor or a restarted query replaces
  the earlier attempt and nothing is counted twice.
* Checkpoints go to the shared ``spark.checkpoint.dir`` (see
  :func:`auric.session.checkpoint_dir`), never a machine-local folder.
"""

from __future__ import annotations

import os
from typing import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import compliance as M
from ..session import checkpoint_dir

WATERMARK = "10 minutes"


def event_time(df: DataFrame, col: str = "ts", out: str = "event_time") -> DataFrame:
    return df.withColumn(out, F.col(col).cast("timestamp"))


def file_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """Parquet files landing in ``path`` as a stream. A trigger takes all new
    files unless ``max_files`` limits it."""
    r = spark.readStream.schema(schema)
    return (r if max_files is None else r.option("maxFilesPerTrigger", max_files)).parquet(path)


# --------------------------------------------------------------- sink helpers
def _batch_dir(path: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/batch_id={batch_id}"


def changelog_writer(path: str):
    """foreachBatch function writing the batch's updated rows into its own
    ``batch_id=N`` partition with overwrite: a replayed batch (after a lost
    executor or a restart) replaces its earlier attempt instead of adding to
    it, so the sink is idempotent."""
    def write(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(_batch_dir(path, batch_id))
    return write


def _newest(log: DataFrame, keys: Iterable[str]) -> DataFrame:
    keys = list(keys)
    rest = [c for c in log.columns if c not in (*keys, "batch_id")]
    r = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r"))
    return r.select(*[c if c in keys else F.col("r")[c].alias(c) for c in log.columns if c != "batch_id"])


def latest_by_key(spark: SparkSession, path: str, keys: Iterable[str], base: str | None = None) -> DataFrame:
    """Current state of an upsert changelog: last batch's row per key (a partial
    aggregate, no window over the log). With ``base``, a snapshot made by
    :func:`compact_changelog`, only the batches after it are read from the log."""
    log = spark.read.parquet(path)
    if base is not None:
        folded = spark.read.parquet(base)
        upto = folded.agg(F.max("batch_id")).first()[0]  # one number; a partition value
        log = log.filter(F.col("batch_id") > upto).unionByName(folded.filter(F.col("batch_id") == upto))
    return _newest(log, keys)


def compact_changelog(spark: SparkSession, path: str, keys: Iterable[str], upto_batch: int, out: str) -> None:
    """Fold a changelog's batches ≤ ``upto_batch`` into one base snapshot at
    ``out`` (one row per key, tagged with ``upto_batch`` as its batch id), for
    ``latest_by_key(…, base=out)``: each read stays proportional to the live
    keys, not to the number of triggers. The write goes to a new location; the
    old log stays, so a failure midway loses nothing."""
    log = spark.read.parquet(path).filter(F.col("batch_id") <= upto_batch)
    _newest(log, keys).write.mode("overwrite").parquet(_batch_dir(out, upto_batch))


def run_available_now(df: DataFrame, name: str, write_fn, output_mode: str = "update") -> str:
    """Run a streaming DataFrame over everything available, then stop."""
    spark = df.sparkSession
    ckpt = os.path.join(checkpoint_dir(spark), "streams", name)
    q = (df.writeStream.outputMode(output_mode).foreachBatch(write_fn)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return ckpt


# ------------------------------------------------- windows that lose no late row
BEFORE_ALL = -(1 << 62)  # a watermark that no window's end has reached


def windowed_writer(path: str, time_col: str, width: str, partial, slide: str | None = None,
                    watermark: str = WATERMARK):
    """foreachBatch for windowed measures in which late rows are set aside, not lost.

    A row counts in each window that holds its time. A window is closed once the
    watermark (the newest time of earlier batches less the delay) has reached its
    end; a row for a closed window goes to ``late/``, the others to ``partial``,
    which sums them per key and window ``w``. The sums of a batch go to its own
    folder of ``sums/`` and add up over batches (:func:`window_totals`), so there
    is no state beside the log, and a replayed batch replaces its earlier attempt.
    ``counts/`` has a row per batch: rows in and set aside, observed as they pass,
    rows counted, taken from the sums as written, and the watermark that the next
    batch starts from."""
    root = path.rstrip("/")
    delay_us = F.unix_micros(F.lit("1970-01-01").cast("timestamp") + F.expr(f"INTERVAL {watermark}"))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        closed = None
        if batch_id:
            last = spark.read.parquet(_batch_dir(f"{root}/counts", batch_id - 1))
            closed = last.select("watermark").first()[0]  # one row
        at = F.col(time_col).cast("timestamp")
        rows = batch.withColumn("w", F.window(at, width, slide) if slide else F.window(at, width))
        late = F.unix_micros(F.col("w.end")) <= F.lit(BEFORE_ALL if closed is None else closed)
        rows = rows.withColumn("_late", F.coalesce(late, F.lit(False)))
        seen = Observation()
        (rows.observe(seen, F.count(F.lit(1)).alias("rows_in"), F.count_if("_late").alias("set_aside"),
                      F.max(F.unix_micros(at) - delay_us).alias("newest"))
         .filter("_late").drop("_late").write.mode("overwrite").parquet(_batch_dir(f"{root}/late", batch_id)))
        sums = _batch_dir(f"{root}/sums", batch_id)
        partial(rows.filter(~F.col("_late"))).write.mode("overwrite").parquet(sums)
        counted = spark.read.parquet(sums).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        mark = max((x for x in (closed, seen.get["newest"]) if x is not None), default=None)
        spark.createDataFrame([(seen.get["rows_in"], counted, seen.get["set_aside"], mark)],
                              "rows_in long, counted long, set_aside long, watermark long").coalesce(1).write.mode(
            "overwrite").parquet(_batch_dir(f"{root}/counts", batch_id))
    return write


def window_totals(spark: SparkSession, path: str, keys: Iterable[str]) -> DataFrame:
    """The measures per key and window: the sums of all batches added up."""
    sums = spark.read.parquet(f"{path.rstrip('/')}/sums")
    keys = [*keys, "window_start", "window_end"]
    kinds = dict(sums.dtypes)
    return sums.groupBy(*keys).agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in sums.columns
                                     if c not in (*keys, "batch_id")])


def _per_window(rows: DataFrame, keys: list[str], *measures) -> DataFrame:
    r = rows.groupBy(*keys, "w").agg(F.count(F.lit(1)).alias("rows"), *measures)
    bounds = [F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end")]
    return r.select(*keys, *bounds, *[c for c in r.columns if c not in (*keys, "w")])


def rate_counts_writer(path: str, width: str = "15 minutes", watermark: str = WATERMARK):
    """W-01 with late requests set aside: requests per client and window."""
    return windowed_writer(path, "ts", width, lambda rows: _per_window(
        rows, ["client"], F.count(F.lit(1)).alias("requests")), watermark=watermark)


def login_failure_writer(path: str, width: str, slide: str, failure_action: str = "error", watermark: str = WATERMARK):
    """W-02 with late attempts set aside: failures per user and sliding window."""
    write = windowed_writer(path, "created_at", width, lambda rows: _per_window(
        rows, ["user_id"], F.count(F.lit(1)).alias("failures")), slide, watermark)
    return lambda batch, batch_id: write(batch.filter(F.col("action") == failure_action), batch_id)


def live_metrics_writer(path: str, width: str = "1 day", watermark: str = WATERMARK):
    """W-04 with late trades set aside: the measures of :func:`live_metrics`."""
    write = windowed_writer(path, "created_at", width, lambda rows: _per_window(
        rows, ["tenant_id", "asset_type"], *_trade_measures()), watermark=watermark)
    return lambda batch, batch_id: write(batch.filter(F.col("status") == "completed"), batch_id)


# --------------------------------------------------------------------- W-01
def rate_violations(requests: DataFrame, width: str = "15 minutes", max_requests: int = 100) -> DataFrame:
    """Batch: clients above ``max_requests`` per clock-aligned window."""
    r = requests.groupBy("client", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return r.filter(F.col("requests") > max_requests).select(
        "client", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "requests")


def rate_counts_stream(requests: DataFrame, width: str = "15 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Stream: running count per (client, window); emit in update mode and
    keep the latest per key — the violations are the rows above the limit."""
    e = event_time(requests).withWatermark("event_time", watermark)
    r = e.groupBy("client", F.window("event_time", width).alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return r.select("client", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "requests")


# --------------------------------------------------------------------- W-02
def login_failures(audit: DataFrame, width: str, slide: str, n: int, failure_action: str = "error") -> DataFrame:
    """Batch: users with at least ``n`` failed attempts in a sliding window."""
    f = audit.filter(F.col("action") == failure_action)
    r = f.groupBy("user_id", F.window("created_at", width, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("failures"))
    return r.filter(F.col("failures") >= n).select(
        "user_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "failures")


def login_failure_counts_stream(audit: DataFrame, width: str, slide: str, failure_action: str = "error",
                                watermark: str = WATERMARK) -> DataFrame:
    e = event_time(audit.filter(F.col("action") == failure_action), "created_at").withWatermark("event_time", watermark)
    r = e.groupBy("user_id", F.window("event_time", width, slide).alias("w")).agg(F.count(F.lit(1)).alias("failures"))
    return r.select("user_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "failures")


# --------------------------------------------------------------------- W-04
def _trade_measures() -> list:
    t, v = F.col("transaction_type"), F.col("total_value")
    zero = F.lit(0).cast("decimal(25,2)")
    return [F.count(F.lit(1)).alias("transactions"),
            F.count(F.when(t == "BUY", 1)).alias("buy_orders"),
            F.count(F.when(t == "SELL", 1)).alias("sell_orders"),
            F.sum("quantity").alias("quantity"),
            F.sum(v).alias("volume"),
            F.coalesce(F.sum(F.when(t == "BUY", v)), zero).alias("buy_volume"),
            F.coalesce(F.sum(F.when(t == "SELL", v)), zero).alias("sell_volume")]


def live_metrics(tx: DataFrame, width: str = "1 day") -> DataFrame:
    """Batch twin: A-04/A-05 measures per tenant, asset and window."""
    c = tx.filter(F.col("status") == "completed")
    r = c.groupBy("tenant_id", "asset_type", F.window("created_at", width).alias("w")).agg(*_trade_measures())
    return r.select("tenant_id", "asset_type", F.col("w.start").alias("window_start"), "transactions",
                    "buy_orders", "sell_orders", "quantity", "volume", "buy_volume", "sell_volume")


def live_metrics_stream(tx: DataFrame, width: str = "1 day", watermark: str = WATERMARK) -> DataFrame:
    e = event_time(tx, "created_at").withWatermark("event_time", watermark)
    r = e.filter(F.col("status") == "completed").groupBy(
        "tenant_id", "asset_type", F.window("event_time", width).alias("w")).agg(*_trade_measures())
    return r.select("tenant_id", "asset_type", F.col("w.start").alias("window_start"), "transactions",
                    "buy_orders", "sell_orders", "quantity", "volume", "buy_volume", "sell_volume")


# --------------------------------------------------------------------- W-05
def current_holdings(spark: SparkSession, holdings_log: str) -> DataFrame:
    """Holdings that :func:`auric.streaming.keyed.live_holdings_stream` wrote as a changelog."""
    h = latest_by_key(spark, holdings_log, ["tenant_id", "user_id", "asset_type"])
    return h.filter(F.col("quantity") > 0)


# --------------------------------------------------------------------- W-06
def live_alerts(tx: DataFrame, users: DataFrame, threshold, caps: DataFrame) -> DataFrame:
    """M-01 and M-02 over a (streaming or batch) ledger; the user table is a
    static side of a stream–static join."""
    return M.alert_high_amount(tx, threshold).unionByName(M.alert_kyc_limit(tx, users, caps))
