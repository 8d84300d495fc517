"""Streams with state per key on ``transformWithState`` (W-03, W-05).

The state lives in the session's RocksDB state store: a trigger reads and writes
the keys of its rows and nothing else, however long the history. The store's
versions and the checkpoint make a replayed batch start from the same state.

* :func:`leaky_bucket_stream` holds a client's requests back until the watermark
  has passed them, so requests that arrive out of order are folded in order; later
  ones are handed back marked, never folded and never lost.
* :func:`live_holdings_stream` keeps the rows and the summary of every (key, day).
  A row of any age replaces its day's summary; the key's days are then scanned.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import folds
from ..operators import holdings as H
from ..session import ship_package

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WATERMARK = "10 minutes"


def use_keyed_state(spark: SparkSession) -> None:
    """Session settings that streams with keyed state need before they start."""
    spark.conf.set(STORE, ROCKS_DB)
    ship_package(spark)


# --------------------------------------------------------------------- W-03
class LeakyBucket(StatefulProcessor):
    """State of a client: its bucket (scaled excess, time of its last accepted
    request), the requests that wait for the watermark, and its timer."""

    def __init__(self, rate, burst: int):
        a, b = folds.fraction(rate)
        self.drain, self.unit = a, b * 1_000_000
        self.most = int(burst) * self.unit
        self.idle = folds.idle_us(rate, burst)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "excess long, last long")
        self.waiting = handle.getMapState("waiting", "us long, event_id long", "copies long")
        self.timer = handle.getValueState("timer", "ms long")

    def _arm(self, ms: int) -> None:
        if self.timer.exists():
            old = self.timer.get()[0]
            if old <= ms:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        first = None
        for r in rows:
            if r.us < passed:
                yield Row(client=key[0], us=r.us, event_id=r.event_id, refused=None, excess_scaled=None, late=True)
                continue
            at = (r.us, r.event_id)
            copies = self.waiting.getValue(at)[0] if self.waiting.containsKey(at) else 0
            self.waiting.updateValue(at, (copies + 1,))
            first = r.us if first is None else min(first, r.us)
        if first is not None:
            self._arm(first // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        waiting = sorted((tuple(k), v[0]) for k, v in self.waiting.iterator())
        excess, last = self.bucket.get() if self.bucket.exists() else (None, None)
        for (us, event_id), copies in waiting:
            if us >= passed:
                self._arm(us // 1000)
                break
            for _ in range(copies):
                new = 0 if excess is None else max(0, excess - self.drain * (us - last) + self.unit)
                refused = new > self.most
                if not refused:
                    excess, last = new, us
                yield Row(client=key[0], us=us, event_id=event_id, refused=refused, excess_scaled=excess or 0, late=False)
            self.waiting.removeKey((us, event_id))
        else:  # nothing waits: the bucket goes once it is empty for certain
            if last is not None and last + self.idle <= passed:
                self.bucket.clear()
                return
            if last is not None:
                self._arm((last + self.idle) // 1000 + 1)
        if last is not None:
            self.bucket.update((excess, last))

    def close(self) -> None:
        pass


def leaky_bucket_stream(requests: DataFrame, rate=(1, 21600), burst: int = 1, watermark: str = WATERMARK) -> DataFrame:
    """Stream of decisions (client, us, event_id, refused, excess_scaled, late):
    one row per request. A request is decided when the watermark has passed its
    time; one that arrives after that comes back with ``late`` and no decision.

    The event time itself is left out of what reaches the operator, as Spark would
    drop late rows there without a trace."""
    use_keyed_state(requests.sparkSession)
    e = requests.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", watermark)
    rows = e.select("client", F.unix_micros("event_time").alias("us"), "event_id")
    client = requests.schema["client"].dataType.simpleString()
    return rows.groupBy("client").transformWithState(
        LeakyBucket(rate, burst), f"client {client}, us long, event_id long, refused boolean, excess_scaled long, "
                                  "late boolean", "Append", "EventTime")


def decisions_writer(path: str):
    """foreachBatch: decided and late requests go to ``late=false`` and
    ``late=true`` of the batch's own folder, in one pass."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("late").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")
    return write


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """All that :func:`decisions_writer` wrote, with its batch."""
    return spark.read.parquet(path).withColumn("late", F.col("late") == "true")


def decision_counts(spark: SparkSession, path: str) -> DataFrame:
    """Per batch: requests decided, refused and set aside as late."""
    return decisions(spark, path).groupBy("batch_id").agg(
        F.count_if(~F.col("late")).alias("decided"), F.count_if(F.col("refused")).alias("refused"),
        F.count_if(F.col("late")).alias("late"))


# --------------------------------------------------------------------- W-05
ROW = ("struct<us:long,order_id:long,line_no:long,partkey:long,suppkey:long,ext:double,quantity:decimal(20,8),"
       "buy:boolean>")


def _in_order(r: tuple) -> tuple:
    """The ledger's total order: nulls first, BUY before SELL."""
    return tuple((x is not None, x if x is not None else 0) for x in (*r[:7], not r[7]))


def summarise(rows: list[tuple]) -> tuple[Decimal, Decimal, int | None, int | None, bool]:
    """Of one day's rows in order: their signed sum, the lowest running sum, the
    first event's time, the time of the first event after the last lowest point,
    and whether there is one."""
    total, lowest, after, has_after = Decimal(0), None, None, False
    for r in rows:
        total += r[6] if r[7] else -r[6]
        if lowest is None or total <= lowest:
            lowest, after, has_after = total, None, False
        elif not has_after:
            after, has_after = r[0], True
    return total, lowest, rows[0][0], after, has_after


def scan(days: Iterable[tuple]) -> tuple[Decimal, int | None]:
    """The clamped balance and the time since which it has not been zero, from a
    key's day summaries in order."""
    total = low = Decimal(0)
    begin, begun = None, False
    for csum, cmin, first, after, has_after in days:
        if total + cmin <= low:  # the balance is zero at the day's last lowest point
            begin, begun = after, has_after
        elif not begun:
            begin, begun = first, True
        low = min(low, total + cmin)
        total += csum
    return total - low, begin if total > low else None


class LiveHoldings(StatefulProcessor):
    """State of a key: for each day its rows and their summary."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getMapState("rows", "day int", f"rows array<{ROW}>")
        self.days = handle.getMapState("days", "day int", "csum decimal(38,8), cmin decimal(38,8), first long, "
                                                          "after long, has_after boolean")

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        new: dict[int, list[tuple]] = {}
        for r in rows:
            new.setdefault(r.day, []).append((r.us, r.order_id, r.line_no, r.partkey, r.suppkey, r.ext, r.quantity, r.buy))
        for day, added in new.items():
            known = [tuple(x) for x in self.rows.getValue((day,))[0]] if self.rows.containsKey((day,)) else []
            both = sorted(known + added, key=_in_order)
            self.rows.updateValue((day,), (both,))
            self.days.updateValue((day,), summarise(both))
        quantity, begin = scan(v for _, v in sorted((k[0], tuple(v)) for k, v in self.days.iterator()))
        yield Row(**dict(zip(H.TX_KEY, key)), quantity=quantity.quantize(Decimal("0.00000001")), us=begin)

    def close(self) -> None:
        pass


def live_holdings_stream(tx: DataFrame) -> DataFrame:
    """Stream of holdings (key, quantity, created_at): a row per key that a batch
    touched; quantity 0 once it is gone. Rows may arrive in any order and at any
    age: each changes its own day's summary, and the key's summaries are scanned."""
    use_keyed_state(tx.sparkSession)
    ev = tx.filter((F.col("status") == "completed") & F.col("transaction_type").isin("BUY", "SELL"))
    # Rows without a time sort first, in a day of their own.
    day = F.coalesce(F.date_diff(F.to_date("created_at"), F.lit("0001-01-01").cast("date")), F.lit(-1))
    ev = ev.select(*H.TX_KEY, day.cast("int").alias("day"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("us"),
                   "order_id", F.col("line_no").cast("long").alias("line_no"), "partkey", "suppkey",
                   F.col("ext").cast("double").alias("ext"), F.col("quantity").cast("decimal(20,8)").alias("quantity"),
                   (F.col("transaction_type") == "BUY").alias("buy"))
    keys = ", ".join(f"{k} {tx.schema[k].dataType.simpleString()}" for k in H.TX_KEY)
    out = ev.groupBy(*H.TX_KEY).transformWithState(LiveHoldings(), f"{keys}, quantity decimal(20,8), us long", "Update", "None")
    return out.select(*H.TX_KEY, "quantity", F.timestamp_micros("us").cast("timestamp_ntz").alias("created_at"))
