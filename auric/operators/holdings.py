"""Holdings and valuation.

H-03 is the core: replaying completed BUY/SELL rows with ``bal = max(0, bal ± q)``.
Its closed form is the reflected walk ``bal_i = S_i − min(0, min_{j≤i} S_j)``
where ``S`` is the running signed sum. A running sum per key is a window over
the whole key, which puts a hot user (possibly a third of the ledger) into a
single task. We therefore scan in two levels:

1. rows are windowed per (key, chunk) — chunk = calendar day by default — to
   get the local running sum and local running minimum;
2. a tiny per-(key, chunk) summary (chunk sum, chunk minimum) is prefix-scanned
   per key to give each chunk its offset and the minimum of all earlier chunks;
3. holdings (H-03) follow from the summaries alone; only the balance of every
   row (:func:`ledger_balances`) joins them back on (key, chunk), which is
   already the partitioning of step 1.

A hot key is thus spread over as many tasks as it has active chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.fixtures import TX_KEY, TX_ORDER

QTY = "decimal(20,8)"
RUN = "decimal(38,8)"
MONEY = "decimal(15,2)"


def _trades(tx: DataFrame) -> DataFrame:
    return tx.filter((F.col("status") == "completed") & F.col("transaction_type").isin("BUY", "SELL"))


def _signed() -> Column:
    q = F.col("quantity").cast(RUN)
    return F.when(F.col("transaction_type") == "BUY", q).otherwise(-q)


def time_chunk(created_at: Column, chunk: str) -> Column:
    """Calendar bucket that spreads one key's rows over tasks."""
    if chunk == "day":
        return F.to_date(created_at)
    if chunk == "month":
        return F.trunc(F.to_date(created_at), "month")
    if chunk == "hour":
        return F.date_trunc("hour", created_at)
    raise ValueError(f"unknown chunk {chunk!r}")


# --------------------------------------------------------------------- H-03
def ledger_balances(tx: DataFrame, chunk: str = "day", extra=(), initial: DataFrame | None = None) -> DataFrame:
    """Per completed BUY/SELL row: the clamped balance after it (``balance``).

    Output keeps the ledger identity columns, ``chunk`` and any ``extra``
    columns. Both branches of the plan (rows and chunk summaries) shuffle the
    same columns, so Spark reuses one exchange instead of scanning twice.

    ``initial`` (key, s0, m0) continues a replay from a stored state: ``s0`` is
    the running signed sum so far and ``m0`` = min(0, lowest running sum so
    far). Keys without a row start from zero (the streaming W-05 uses this)."""
    extra = list(extra)
    ev = _trades(tx).select(*TX_KEY, *[c for c in TX_ORDER if c not in TX_KEY], *extra,
                            _signed().alias("dq"))
    ev = ev.withColumn("chunk", chunk_of(chunk))
    wl = (Window.partitionBy(*TX_KEY, "chunk").orderBy(*TX_ORDER)
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ev = ev.withColumn("ls", F.sum("dq").over(wl).cast(RUN))
    ev = ev.withColumn("lmin", F.min("ls").over(wl))
    summary = chunk_offsets(ev.groupBy(*TX_KEY, "chunk").agg(F.sum("dq").cast(RUN).alias("csum"),
                                                              F.min("ls").alias("cmin")), initial)
    j = join_nullsafe(ev, summary.select(*TX_KEY, "chunk", "offset", "prior_min"), [*TX_KEY, "chunk"])
    s = (F.col("offset") + F.col("ls")).cast(RUN)
    m = F.least(F.coalesce(F.col("prior_min"), F.col("offset") + F.col("lmin")), F.col("offset") + F.col("lmin"))
    bal = (s - F.least(F.lit(0).cast(RUN), m)).cast(QTY)
    return j.select(*TX_KEY, *[c for c in TX_ORDER if c not in TX_KEY], *extra, "chunk",
                    bal.alias("balance"))


def chunk_of(chunk: str) -> Column:
    """Chunk of a ledger row; rows without a time sort first, in a chunk of their own."""
    c = time_chunk(F.col("created_at"), chunk)
    return F.coalesce(c, F.lit("0001-01-01").cast("timestamp_ntz" if chunk == "hour" else "date"))


def join_nullsafe(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match, as in grouping; right's key columns go."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    j = left.join(r, cond, how)
    return j if how in ("left_semi", "left_anti") else j.drop(*[f"_r_{k}" for k in keys])


def chunk_offsets(summary: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Exclusive prefix over a key's chunks: offset (sum of earlier chunk sums)
    and prior_min (minimum running sum reached in earlier chunks), optionally
    continuing from a stored (s0, m0) per key."""
    ws = Window.partitionBy(*TX_KEY).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    if initial is not None:
        summary = join_nullsafe(summary, initial.select(*TX_KEY, "s0", "m0"), TX_KEY, "left")
        s0, m0 = F.coalesce(F.col("s0"), F.lit(0)), F.col("m0")
    else:
        s0, m0 = F.lit(0), F.lit(None)
    s = summary.withColumn("offset", (s0 + F.coalesce(F.sum("csum").over(ws), F.lit(0))).cast(RUN))
    s = s.withColumn("gmin", (F.col("offset") + F.col("cmin")).cast(RUN))
    return s.withColumn("prior_min", F.least(F.min("gmin").over(ws), m0.cast(RUN)))


def chunk_summary(tx: DataFrame, chunk: str = "day") -> DataFrame:
    """One row per (key, chunk) with all that the replay needs of its rows:
    ``csum`` and ``cmin`` (sum and lowest running sum), the chunk's first event,
    and the first event after its last lowest point. Whether that point was a
    zero balance depends on earlier chunks only through (offset, minimum), so
    the rows themselves are never joined back: the ledger is shuffled once."""
    ev = _trades(tx).select(*TX_KEY, *[c for c in TX_ORDER if c not in TX_KEY], _signed().alias("dq"))
    ev = ev.withColumn("chunk", chunk_of(chunk))
    whole = Window.partitionBy(*TX_KEY, "chunk")
    upto = whole.orderBy(*TX_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    o = F.struct(*TX_ORDER)
    at = F.struct(o.alias("o"), F.col("created_at").alias("t"))
    ev = ev.withColumn("ls", F.sum("dq").over(upto).cast(RUN)).withColumn("cmin", F.min("ls").over(whole))
    ev = ev.withColumn("low", F.max(F.when(F.col("ls") == F.col("cmin"), o)).over(whole))
    return ev.groupBy(*TX_KEY, "chunk").agg(
        F.sum("dq").cast(RUN).alias("csum"), F.min("ls").alias("cmin"),
        F.min(at).alias("first_event"), F.min(F.when(o > F.col("low"), at)).alias("first_after"),
        F.max(o).alias("last"))


def fold_chunks(summary: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Per key from chunk summaries: ``s`` (running signed sum), ``m`` (= min(0,
    lowest running sum)), ``quantity`` (= s − m, the clamped balance), whether
    any row reached zero, and the first event after the last zero. ``initial``
    (key, s0, m0) continues from a stored state."""
    c = chunk_offsets(summary, initial)
    c = c.withColumn("zero", F.col("gmin") <= F.least(F.lit(0).cast(RUN), F.col("prior_min")))
    # The last chunk with a zero counts from after that zero; later chunks from their start.
    last_zero = F.max(F.when(F.col("zero"), F.col("chunk"))).over(Window.partitionBy(*TX_KEY))
    c = c.withColumn("lzc", last_zero)
    begin = (F.when(F.col("lzc").isNull() | (F.col("chunk") > F.col("lzc")), F.col("first_event"))
             .when(F.col("chunk") == F.col("lzc"), F.col("first_after")))
    k = c.groupBy(*TX_KEY).agg(
        F.max_by((F.col("offset") + F.col("csum")).cast(RUN), "chunk").alias("s"),
        F.least(F.lit(0).cast(RUN), F.min(F.least("gmin", "prior_min"))).alias("m"),
        F.max("zero").alias("any_zero"), F.min(begin).alias("begin"), F.max("last").alias("last"))
    return k.select(*TX_KEY, "s", "m", (F.col("s") - F.col("m")).cast(QTY).alias("quantity"), "any_zero",
                    F.col("begin.t").alias("created_at"), "last")


def dealt_trades(tx: DataFrame, chunk: str = "day") -> DataFrame:
    """Completed trades dealt by (key, chunk): the key, ``chunk`` and ``o``, the place
    in the ledger's order with the price last. Balances and prices both need just these
    columns, so they share the exchange; single columns would be pruned apart and the
    ledger derived and shuffled for each."""
    o = F.struct(*TX_ORDER, "price")
    return _trades(tx).select(*TX_KEY, chunk_of(chunk).alias("chunk"), o.alias("o")).repartition(*TX_KEY, "chunk")


def chunk_closings(trades: DataFrame, tasks: int) -> DataFrame:
    """Per (key, chunk) of :func:`dealt_trades`: the clamped ``balance`` at the chunk's
    end, in ``tasks`` tasks by (tenant, user). Only a row per chunk is shuffled again."""
    upto = Window.partitionBy(*TX_KEY, "chunk").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    ev = trades.select(*TX_KEY, "chunk", "o", "o.transaction_type", "o.quantity").withColumn("dq", _signed())
    summary = ev.withColumn("ls", F.sum("dq").over(upto).cast(RUN)).groupBy(*TX_KEY, "chunk").agg(
        F.sum("dq").cast(RUN).alias("csum"), F.min("ls").alias("cmin"))
    c = chunk_offsets(summary.repartition(tasks, "tenant_id", "user_id"))
    low = F.least(F.lit(0).cast(RUN), F.col("prior_min"), F.col("gmin"))
    return c.select(*TX_KEY, "chunk", (F.col("offset") + F.col("csum") - low).cast(QTY).alias("balance"))


def holdings_from_ledger(tx: DataFrame, chunk: str = "day") -> DataFrame:
    """H-03: one row per (tenant, user, asset) with a positive replayed balance.
    ``created_at`` is the first event after the balance was last zero. NULL
    keys are keys of their own, as in grouping."""
    k = fold_chunks(chunk_summary(tx, chunk))
    return k.filter(F.col("quantity") > 0).select(*TX_KEY, "quantity", "created_at")


def advance_state(events: DataFrame, prev: DataFrame | None, chunk: str = "day") -> DataFrame:
    """Fold a batch of ledger rows onto a stored per-key replay state.

    State per key: ``s``, ``m``, ``quantity``, ``created_at`` and ``last`` (the
    order of its last row; :func:`fold_chunks`). Only the batch is read; the result has one new
    state row per touched key. Rows of a key must arrive in order (later
    batches never precede earlier)."""
    init = None if prev is None else prev.select(*TX_KEY, F.col("s").alias("s0"), F.col("m").alias("m0"),
                                                 F.col("created_at").alias("prev_created"))
    k = fold_chunks(chunk_summary(events, chunk), init)
    if init is not None:
        k = join_nullsafe(k, init.select(*TX_KEY, "prev_created"), TX_KEY, "left")
    else:
        k = k.withColumn("prev_created", F.lit(None).cast("timestamp_ntz"))
    created = (F.when(F.col("quantity") == 0, F.lit(None).cast("timestamp_ntz"))
               .when(~F.col("any_zero") & F.col("prev_created").isNotNull(), F.col("prev_created"))
               .otherwise(F.col("created_at")))
    return k.select(*TX_KEY, "s", "m", "quantity", created.alias("created_at"), "last")


# --------------------------------------------------------------------- H-01
def add_tokens(holdings: DataFrame, buys: DataFrame) -> DataFrame:
    """Merge a batch of BUYs: add to the holding if present, else open one at
    the time of its first buy and the price of its last. ``current_price`` and
    ``created_at`` of an existing holding stay; total_value follows (H-04)."""
    o = F.struct(*[c for c in TX_ORDER if c in buys.columns])
    b = buys.groupBy(*TX_KEY).agg(F.sum("quantity").alias("quantity"), F.max_by("price", o).alias("current_price"),
                                  F.min("created_at").alias("created_at"))
    # Grouped rather than joined, so that NULL key parts meet. kind 0: the holding, 1: its buys.
    both = holdings.select(*TX_KEY, "quantity", "current_price", "created_at", F.lit(0).alias("kind")).unionByName(
        b.withColumn("kind", F.lit(1)))

    def first_of(c):
        return F.coalesce(F.max(F.when(F.col("kind") == 0, F.col(c))), F.max(F.when(F.col("kind") == 1, F.col(c)))).alias(c)

    return holding_value(both.groupBy(*TX_KEY).agg(
        F.coalesce(F.sum("quantity"), F.lit(0)).cast(QTY).alias("quantity"), first_of("current_price"), first_of("created_at")))


# --------------------------------------------------------------------- H-02
def remove_tokens(holdings: DataFrame, sells: DataFrame) -> DataFrame:
    """Subtract one batched removal per key; rows at or below zero are deleted,
    keys without a holding are a no-op. Price and opening time stay."""
    s = sells.groupBy(*TX_KEY).agg(F.sum("quantity").alias("sub_q"))
    j = join_nullsafe(holdings.select(*TX_KEY, "quantity", "current_price", "created_at"), s, TX_KEY, "left")
    q = (F.col("quantity") - F.coalesce(F.col("sub_q"), F.lit(0))).cast(QTY)
    return holding_value(j.select(*TX_KEY, q.alias("quantity"), "current_price", "created_at").filter(F.col("quantity") > 0))


# --------------------------------------------------------------------- H-04
def holding_value(holdings: DataFrame, price_col: str = "current_price") -> DataFrame:
    """Trigger semantics: total_value = quantity × price; NULL price → NULL."""
    return holdings.withColumn("total_value", (F.col("quantity") * F.col(price_col)).cast(MONEY))


# --------------------------------------------------------------------- H-05
def mark_to_market(holdings: DataFrame, assets: DataFrame) -> DataFrame:
    """Refresh current_price from the (seeded, 3-row) asset dimension, then H-04."""
    a = assets.select(F.col("code").alias("asset_type"), "current_price")
    h = holdings.drop("current_price", "total_value").join(a, "asset_type", "left")
    return holding_value(h).select(*TX_KEY, "quantity", "current_price", "total_value",
                                   *[c for c in holdings.columns
                                     if c not in (*TX_KEY, "quantity", "current_price", "total_value")])


# --------------------------------------------------------------------- H-06
def average_cost(tx: DataFrame) -> DataFrame:
    """Average purchase price per key = Σ buy value / Σ buy quantity."""
    b = tx.filter((F.col("status") == "completed") & (F.col("transaction_type") == "BUY"))
    r = b.groupBy(*TX_KEY).agg(F.sum("total_value").cast("decimal(18,2)").alias("buy_value"),
                               F.sum("quantity").cast("decimal(18,8)").alias("buy_quantity"))
    avg = (F.col("buy_value") / F.nullif(F.col("buy_quantity"), F.lit(0).cast("decimal(18,8)"))).cast(MONEY)
    return r.withColumn("average_purchase_price", avg)


# --------------------------------------------------------------------- H-07
def unrealised_pnl(valued: DataFrame, avg_cost: DataFrame) -> DataFrame:
    """value − quantity × average cost, and the change in percent of cost."""
    j = valued.join(avg_cost.select(*TX_KEY, "average_purchase_price"), TX_KEY, "left")
    cost = (F.col("quantity") * F.col("average_purchase_price")).cast(MONEY)
    pnl = (F.col("total_value") - cost).cast(MONEY)
    pct = pnl.cast("double") / F.nullif(cost, F.lit(0).cast(MONEY)).cast("double") * F.lit(100.0)
    return j.select(*TX_KEY, "quantity", "total_value", "average_purchase_price",
                    cost.alias("cost_basis"), pnl.alias("unrealised_pnl"), pct.alias("change_pct"))


# --------------------------------------------------------------------- H-08
def touch_updated_at(old: DataFrame, new: DataFrame, as_of, value_cols=("quantity",)) -> DataFrame:
    """Rows whose values changed (or that are new) get ``updated_at = as_of``;
    unchanged rows keep their old ``updated_at``; rows gone from ``new`` drop."""
    o = old.select(*TX_KEY, *[F.col(c).alias(f"old_{c}") for c in value_cols], "updated_at")
    j = join_nullsafe(new, o, TX_KEY, "left")
    same = F.lit(True)
    for c in value_cols:
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    ts = F.lit(as_of).cast("timestamp_ntz")
    upd = F.when(F.col("updated_at").isNotNull() & same, F.col("updated_at")).otherwise(ts)
    return j.select(*new.columns, upd.alias("updated_at"))
