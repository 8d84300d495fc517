"""Distinct users of longer periods from stored daily sketches."""

from pyspark.sql import functions as F

from auric.operators import reports as A
from auric.sources import sinks


def events(spark, n_users, days):
    """Every user is seen on three of the days, a few have no id."""
    u = spark.range(n_users).select(F.col("id").alias("user_id"), F.explode(F.array(
        *[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(days)).cast("int") for k in range(3)])).alias("d"))
    at = F.lit("2001-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=F.col("d"))
    return u.select(F.when(F.col("user_id") % 1000 != 7, F.col("user_id")).alias("user_id"), at.alias("created_at"),
                    F.pmod(F.col("user_id"), F.lit(2)).alias("tenant_id"))


def test_estimates_of_weeks_and_months_are_within_their_error(spark):
    ev = events(spark, 60_000, 59)
    days = A.user_sketches(ev, ["tenant_id"]).persist()
    for grain in ("day", "week", "month"):
        exact = {(r.tenant_id, r[grain]): r.active_users for r in A.active_users(ev, ["tenant_id"], grain).collect()}
        got = {(r.tenant_id, r[grain]): r.active_users
               for r in A.active_users_from_sketches(days, ["tenant_id"], grain).collect()}
        assert got.keys() == exact.keys() and max(exact.values()) > 1_000
        assert all(abs(got[k] - n) <= 0.03 * n for k, n in exact.items())  # more than three standard errors
    days.unpersist()


def test_a_day_computed_again_replaces_its_sketch(spark, tmp_path):
    path = str(tmp_path / "sketches")
    ev = events(spark, 500, 10)
    late = ev.filter("created_at < '2001-01-03'").withColumn("user_id", F.col("user_id") + 10_000)
    sinks.write_by_day(A.user_sketches(ev, ["tenant_id"]), path)
    first_days = ev.unionByName(late).filter("created_at < '2001-01-03'")
    sinks.write_by_day(A.user_sketches(first_days, ["tenant_id"]), path)  # the two days again, with late rows
    got = {r.tenant_id: r.active_users for r in A.active_users_from_sketches(
        spark.read.parquet(path), ["tenant_id"], "month").collect()}
    want = {r.tenant_id: r.active_users for r in A.active_users(ev.unionByName(late), ["tenant_id"], "month").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 0.03 * want[k] for k in want)


def test_a_day_without_known_users_counts_none(spark):
    ev = spark.createDataFrame([(None, 1)], "user_id long, tenant_id int").withColumn(
        "created_at", F.lit("2001-01-01").cast("timestamp_ntz"))
    days = A.user_sketches(ev, ["tenant_id"])
    assert [r.active_users for r in A.active_users_from_sketches(days, ["tenant_id"], "week").collect()] == [0]
    assert [r.active_users for r in A.active_users(ev, ["tenant_id"], "week").collect()] == [0]
