"""Sequential state machines that have no closed form (K-02, W-03).

A refused sell (or a refused request) changes no state, so later outcomes
depend on every earlier decision; no window expression or monoid summary
captures that. Spark still does all the distribution work: the rows are
hash-partitioned by key and sorted within partitions by the total order, and
a small fold streams over each partition in Arrow batches. State is one scalar
per key and is carried across batch boundaries; no key is ever collected into an
array, a pandas group, or the driver. What needs no walk is kept out of it:

The sell gate is bounded from below by the clamped replay, so most (key, day)
chunks are admitted whole and only the others are walked (:func:`sell_gate`).
The leaky bucket splits further: after a gap of (burst + 1) / rate between two
requests the bucket is empty whatever came before, so every such gap starts a
session that is folded on its own, and a client is spread over its sessions.
"""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .holdings import chunk_of

UNITS = 10 ** 8  # decimal(20,8) quantities as exact integer units
UNIT = Decimal("0.00000001")
WIDE = "decimal(38,0)"


def _sorted_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


# --------------------------------------------------------------------- K-02
def _gate_walk_fold(batches):
    """Walk each key's unsafe requests in order. The state is what the refused sells
    left in the balance; ``before`` is the balance if none had been refused."""
    cur_key, left = None, 0
    for b in batches:
        admitted, after = [], []
        rows = (b.column(c).to_pylist() for c in ("_id", "transaction_type", "q_units", "before"))
        for k, kind, q, s in zip(*rows):
            q, bal = int(q), int(s)
            if k != cur_key:
                cur_key, left = k, 0
            bal += left
            ok = kind == "BUY" or (bal > 0 and bal >= q)  # a holding is there and large enough; equal allowed
            if not ok:
                left += q
            admitted.append(ok)
            after.append(Decimal(left))
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(admitted, pa.bool_()), pa.array(after, pa.decimal128(38, 0))],
            [*b.schema.names, "admitted", "left"])


def _gate_parts(tx: DataFrame, key, order, snapshot: DataFrame | None, chunk: str):
    """Requests with their running sum ``ls`` inside the chunk; a row per (key,
    chunk) with its sum and ``offset``, the balance before it if no sell were
    refused; the walked requests of unsafe chunks. A key with NULL parts is a key;
    ``_key`` holds all parts, so it joins without being split."""
    ev = tx.filter((F.col("status") == "completed") & F.col("transaction_type").isin("BUY", "SELL"))
    cols = list(dict.fromkeys([*key, *order, "transaction_type", "quantity"]))
    units = (F.col("quantity") * F.lit(UNITS)).cast(WIDE)
    # Key parts are read from ``_key``: chunks and rows then need the same columns, and share one exchange.
    given = [c for c in cols if c not in key]
    ev = ev.select(F.struct(*key).alias("_key"), chunk_of(chunk).alias("_chunk"), *given, units.alias("q_units"))
    zero, one = F.lit(0).cast(WIDE), F.lit(1).cast(WIDE)
    part = Window.partitionBy("_key", "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    is_buy = F.col("transaction_type") == "BUY"
    rows = ev.withColumn("dq", F.when(is_buy, F.col("q_units")).otherwise(-F.col("q_units")))
    rows = rows.withColumn("ls", F.sum("dq").over(part).cast(WIDE))
    # What a sell needs at the chunk's start if all before it in the chunk pass.
    need = F.when(~is_buy, F.greatest(F.col("q_units"), one) - (F.col("ls") - F.col("dq")))
    chunks = rows.groupBy("_key", "_chunk").agg(
        F.sum("dq").cast(WIDE).alias("csum"), F.min("ls").alias("cmin"), F.max(need).cast(WIDE).alias("need"),
        F.min("q_units").alias("least"))
    if snapshot is not None:
        start = (F.col("balance") * F.lit(UNITS)).cast(WIDE)
        snap = snapshot.select(F.struct(*key).alias("_key"), start.alias("start"))
        chunks = chunks.join(snap, "_key", "left").withColumn("start", F.coalesce("start", zero))
    else:
        chunks = chunks.withColumn("start", zero)
    whole = Window.partitionBy("_key")
    before = whole.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("offset", (F.col("start") + F.coalesce(F.sum("csum").over(before), zero)).cast(WIDE))
    # The clamped balance of the replay that refuses nothing: never above the gate's.
    lowest = F.min((F.col("offset") + F.col("cmin")).cast(WIDE)).over(before)
    bound = F.col("offset") - F.least(zero, F.coalesce(lowest, zero))
    safe = (F.coalesce(F.col("need") <= bound, F.lit(True))) & (F.min("least").over(whole) >= 0)
    chunks = chunks.select("_key", "_chunk", "csum", "start", "offset", safe.alias("safe"))
    unsafe = rows.join(chunks.filter(~F.col("safe")).select("_key", "_chunk", "offset"), ["_key", "_chunk"])
    walk = unsafe.select(
        F.to_json("_key", {"ignoreNullFields": "false"}).alias("_id"), "_chunk",
        *[F.col("_key")[c].alias(c) if c in key else c for c in cols], "q_units",
        (F.col("offset") + F.col("ls") - F.col("dq")).cast(WIDE).alias("before"))
    schema = walk.schema.add("admitted", T.BooleanType()).add("left", T.DecimalType(38, 0))
    walked = _sorted_by_key(walk, list(key), ["_chunk", *order]).mapInArrow(_gate_walk_fold, schema)
    return rows, chunks, walked, cols


def _units_balance(c: Column) -> Column:
    return (c.cast("decimal(28,0)") * F.lit(UNIT)).cast("decimal(20,8)")  # 28 digits keep the last place


def _gate_order(key, order):
    from ..sources.fixtures import TX_ORDER
    return list(order or [c for c in TX_ORDER if c not in key])


def _refused() -> Column:
    return F.when(~F.col("admitted"), F.col("q_units"))


def sell_gate(tx: DataFrame, key=("tenant_id", "user_id", "asset_type"), order=None,
              snapshot: DataFrame | None = None, chunk: str = "day") -> DataFrame:
    """Replay completed BUY/SELL requests in total order; a SELL is admitted
    iff a holding exists and covers the quantity. Returns every request with
    ``admitted`` and the ``balance`` after it.

    *Bound and walk.* A replay that clamps at zero instead of refusing never
    holds more than the gate (by induction over the rows, for quantities that
    are not negative), and it has a closed form over (key, chunk) summaries. A
    chunk whose greatest need that bound covers is admitted whole; only the
    requests of the other chunks are walked in order. The gate's balance is the
    running sum of all requests plus what refused sells left in it, so the walk
    carries that one number, and safe chunks take it from a prefix sum over chunks.
    A hot key's rows thus lie in a task per chunk, and its walk sees the chunks that
    may refuse. A key with a negative quantity is walked whole.

    ``snapshot`` (key…, balance) starts each key from its stored balance, so
    ``tx`` need only hold the rows after the snapshot. NULL key parts are values."""
    order = _gate_order(key, order)
    rows, chunks, walked, cols = _gate_parts(tx, key, order, snapshot, chunk)
    out = [*cols, "admitted", "balance"]
    bal = F.col("before") + F.col("left") + F.when(F.col("transaction_type") == "BUY", F.col("q_units")).otherwise(
        -F.col("q_units"))
    slow = walked.withColumn("balance", _units_balance(bal)).select(*out)
    refused = walked.groupBy(F.struct(*key).alias("_key"), "_chunk").agg(F.sum(_refused()).alias("refused"))
    earlier = Window.partitionBy("_key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    known = chunks.join(refused, ["_key", "_chunk"], "left").withColumn(
        "left", F.coalesce(F.sum("refused").over(earlier), F.lit(0)).cast(WIDE))
    known = known.filter("safe").select("_key", "_chunk", (F.col("offset") + F.col("left")).alias("start_balance"))
    fast = rows.join(known, ["_key", "_chunk"]).select(
        *[F.col("_key")[c].alias(c) if c in key else c for c in cols], F.lit(True).alias("admitted"),
        _units_balance(F.col("start_balance") + F.col("ls")).alias("balance"))
    return fast.unionByName(slow)


def sell_gate_final(tx: DataFrame, key=("tenant_id", "user_id", "asset_type"), order=None,
                    snapshot: DataFrame | None = None, chunk: str = "day") -> DataFrame:
    """Per key: final balance and number of refused sells: the sum of all requests
    plus what the refused ones left, from the chunks and the walk alone."""
    order = _gate_order(key, order)
    _, chunks, walked, _ = _gate_parts(tx, key, order, snapshot, chunk)
    # The last chunk as a whole: the plan below is then the walk's own, and is not run again.
    last = F.max(F.struct("_chunk", "offset", "csum", "safe"))
    sums = chunks.groupBy("_key").agg(last.alias("c")).select("_key", (F.col("c.offset") + F.col("c.csum")).alias("total"))
    refused = walked.filter(~F.col("admitted")).groupBy(F.struct(*key).alias("_key")).agg(
        F.sum("q_units").alias("left"), F.count(F.lit(1)).alias("n"))
    zero = F.lit(0)
    g = sums.join(refused, "_key", "left")
    return g.select(*[F.col("_key")[c].alias(c) for c in key],
                    _units_balance(F.col("total") + F.coalesce("left", zero)).alias("final_balance"),
                    F.coalesce("n", zero.cast("long")).alias("n_rejected"))


# --------------------------------------------------------------------- W-03
def _bucket_fold(rate_num: int, rate_den_us: int, burst_units: int):
    """Leaky bucket in exact integers: excess is kept in units of 1/rate_num of
    a request per ``rate_den_us`` microseconds — see :func:`leaky_bucket`."""
    def fold(batches):
        cur, excess, last = None, 0, None
        for pdf in batches:
            clients = list(zip(pdf["client"].tolist(), pdf["session"].tolist()))
            ts = pdf["ts_us"].tolist()
            ex0, last0 = pdf["ex0"].tolist(), pdf["last0"].tolist()
            refused, exc_out = [], []
            for c, t, e0, l0 in zip(clients, ts, ex0, last0):
                if c != cur:
                    cur = c
                    excess, last = (None, None) if e0 < 0 else (e0, l0)  # -1: no stored state
                if excess is None:
                    new = 0
                else:
                    # excess' = max(0, excess - rate*dt + 1), scaled by rate_den_us
                    new = max(0, excess - rate_num * (t - last) + rate_den_us)
                if new > burst_units:
                    refused.append(True)
                    exc_out.append(excess if excess is not None else 0)
                else:
                    excess, last = new, t
                    refused.append(False)
                    exc_out.append(new)
            out = pdf.drop(columns=["ts_us", "session", "ex0", "last0"])
            out["refused"] = refused
            out["excess_scaled"] = exc_out
            yield out
    return fold


def fraction(rate) -> tuple[int, int]:
    return (int(rate[0]), int(rate[1])) if isinstance(rate, tuple) else Decimal(str(rate)).as_integer_ratio()


def idle_us(rate, burst: int) -> int:
    """Microseconds without a request after which a bucket is empty for certain."""
    a, b = fraction(rate)
    return -(-(int(burst) + 1) * b * 1_000_000 // a)


def _sessions(ev: DataFrame, order, gap_us: int) -> DataFrame:
    """Number each client's sessions from 0: a gap of ``gap_us`` or more to the
    request before starts a new one. Gaps inside a day are counted per (client, day);
    one row per day (first and last time, gaps) tells whether the day itself starts a
    session and how many there were before, so a busy client is not one window."""
    ev = ev.withColumn("day", F.to_date(F.col(order[0])))
    day = Window.partitionBy("client", "day").orderBy(*order)
    gap = F.col("ts_us") - F.lag("ts_us").over(day)
    ev = ev.withColumn("new", F.coalesce((gap >= gap_us).cast("long"), F.lit(0).cast("long")))
    ev = ev.withColumn("in_day", F.sum("new").over(day.rowsBetween(Window.unboundedPreceding, 0)))
    days = ev.groupBy("client", "day").agg(F.min("ts_us").alias("first"), F.max("ts_us").alias("last"),
                                           F.sum("new").alias("n"))
    before = Window.partitionBy("client").orderBy("day")
    jump = F.coalesce((F.col("first") - F.lag("last").over(before) >= gap_us).cast("long"), F.lit(0).cast("long"))
    days = days.withColumn("jump", jump)
    upto = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    days = days.select("client", "day", (F.sum(F.col("n") + F.col("jump")).over(upto) - F.col("n")).alias("earlier"))
    ev = ev.join(days, ["client", "day"])
    return ev.withColumn("session", F.col("earlier") + F.col("in_day")).drop("day", "new", "in_day", "earlier")


def leaky_bucket(requests: DataFrame, rate, burst: int,
                 client_col: str = "client", order=("ts", "event_id"),
                 snapshot: DataFrame | None = None) -> DataFrame:
    """W-03 batch: per client, ``excess = max(0, excess − rate·Δt + 1)`` (first
    request 0); a request is refused when the new excess exceeds ``burst`` and
    a refused request changes no state. Integer microseconds throughout: the
    rate is held as an exact fraction so no float rounding enters.

    ``rate`` is requests per second, or a ``(requests, seconds)`` pair such as
    ``(10, 1)`` for the API limit or ``(1, 21600)`` for one per six hours.

    ``snapshot`` (client, excess_scaled, last_us), e.g. from
    :func:`bucket_state`, starts each client from its stored state so that
    ``requests`` need only hold the newer rows (snapshot + delta)."""
    a, b = fraction(rate)
    rate_num, rate_den_us = a, b * 1_000_000  # requests per microsecond = num / den
    burst_units = int(burst) * rate_den_us
    ev = requests.select(F.col(client_col).alias("client"), *[c for c in order],
                         F.unix_micros(F.col(order[0]).cast("timestamp")).alias("ts_us"))
    ev = _sessions(ev, order, idle_us(rate, burst))
    if snapshot is not None:
        ev = ev.join(snapshot.select("client", F.col("excess_scaled").alias("ex0"),
                                     F.col("last_us").alias("last0")), "client", "left")
        # keep the columns integral in Arrow/pandas: -1 marks "no stored state"; only
        # a client's first session goes on from the stored one
        on = F.col("session") == 0
        ev = (ev.withColumn("ex0", F.when(on & F.col("ex0").isNotNull(), F.col("ex0")).otherwise(F.lit(-1).cast("long")))
                .withColumn("last0", F.when(on & F.col("last0").isNotNull(), F.col("last0"))
                            .otherwise(F.lit(-1).cast("long"))))
    else:
        ev = ev.withColumn("ex0", F.lit(-1).cast("long")).withColumn("last0", F.lit(-1).cast("long"))
    schema = ev.drop("ts_us", "session", "ex0", "last0").schema.add("refused", T.BooleanType()).add(
        "excess_scaled", T.LongType())
    folded = _sorted_by_key(ev, ["client", "session"], list(order)).mapInPandas(
        _bucket_fold(rate_num, rate_den_us, burst_units), schema)
    # excess in requests, rounded half up to 6 places with integer arithmetic
    micro = F.floor((F.col("excess_scaled").cast("decimal(38,0)") * 2000000 + rate_den_us) / (2 * rate_den_us))
    exc = (micro.cast("decimal(38,0)") * F.lit(Decimal("0.000001"))).cast("decimal(20,6)")
    return folded.select("client", *order, "refused", exc.alias("excess"), "excess_scaled")


def bucket_state(bucketed: DataFrame, order=("ts", "event_id")) -> DataFrame:
    """Per client: the state after its last accepted request (for snapshot +
    delta): scaled excess and that request's time in microseconds."""
    acc = bucketed.filter(~F.col("refused"))
    o = F.struct(*order)
    return acc.groupBy("client").agg(
        F.max_by("excess_scaled", o).alias("excess_scaled"),
        F.max_by(F.unix_micros(F.col(order[0]).cast("timestamp")), o).alias("last_us"))
