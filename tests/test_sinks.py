"""Writers: ledger append, per-tenant layout, report export."""

import json
import os
import uuid

from pyspark.sql import functions as F

from auric.operators import compliance as M
from auric.sources import sinks


def test_append_ledger_adds_batches_and_survives_a_retry(spark, fx_small, tmp_path):
    path = str(tmp_path / f"ledger_{uuid.uuid4().hex}")
    part = fx_small.tx.filter("tenant_id < 5")
    sinks.append_ledger(part, path, batch_id=1)
    sinks.append_ledger(part, path, batch_id=1)  # retried
    back = spark.read.parquet(path)
    assert back.count() == part.count() and {r.status for r in back.select("status").distinct().collect()} == {"pending"}
    assert sorted(d for d in os.listdir(f"{path}/batch_id=1") if d.startswith("tenant_id="))
    sinks.append_ledger(part, path, batch_id=2)
    assert spark.read.parquet(path).count() == 2 * part.count()


def test_dominant_tenant_is_several_files(spark, fx_small, tmp_path):
    path = str(tmp_path / "layout")
    big = fx_small.tx.withColumn("tenant_id", F.when(F.col("order_id") % 3 > 0, F.lit(1)).otherwise(F.col("tenant_id")))
    sinks.tenant_layout(big, path, files=12)
    assert len([f for f in os.listdir(f"{path}/tenant_id=1") if f.endswith(".parquet")]) >= 6
    assert spark.read.parquet(path).count() == fx_small.tx.count()


def test_report_export_replaces_the_report_in_either_overwrite_mode(spark, tmp_path):
    path, key = str(tmp_path / "rep"), "spark.sql.sources.partitionOverwriteMode"
    make = lambda t: spark.createDataFrame([(t, 1)], "tenant_id long, n long")
    for mode in ("dynamic", "static"):
        spark.conf.set(key, mode)
        try:
            sinks.report_export(make(1), path)
            sinks.report_export(make(2), path)
        finally:
            spark.conf.unset(key)
        assert [r.tenant_id for r in spark.read.json(path).collect()] == [2]


def test_stored_tables_round_trip(spark, fx_small, tmp_path):
    from auric.sources.schemas import TABLES
    assert len(TABLES) == 20
    users = fx_small.users.withColumnRenamed("user_id", "id")
    path = str(tmp_path / "users")
    sinks.conform(users, "users").write.parquet(path)
    back = sinks.scan_table(spark, path, "users")
    assert back.schema == TABLES["users"].schema and back.count() == users.count()
    dirty = spark.createDataFrame([("7",), ("seven",)], "kyc_level string")
    assert [r.kyc_level for r in sinks.conform(dirty, "users").collect()] == [7, None]


def test_report_export_json_and_csv(spark, fx_small, tmp_path):
    alerts = M.alert_high_amount(fx_small.tx, 45000)
    rep = M.regulatory_report(fx_small.tx, alerts, "2001-01-01", "2001-06-30", 45000)
    jpath, cpath = str(tmp_path / "rep_json"), str(tmp_path / "rep_csv")
    sinks.report_export(rep, jpath, "json", period_col="reporting_period_start")
    sinks.report_export(rep.drop("report_data"), cpath, "csv")
    j = spark.read.json(jpath)
    assert j.count() == rep.count()
    one = j.filter(F.col("report_type") == "FIU").first()
    assert json.loads(one.report_data)["n"] == one.n
    assert spark.read.option("header", True).csv(cpath).count() == rep.count()


def test_scan_table_uses_given_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a")], "id long, s string").write.parquet(path)
    df = sinks.scan_table(spark, path, spark.createDataFrame([], "id long, s string").schema)
    assert df.schema.simpleString() == "struct<id:bigint,s:string>" and df.count() == 1
