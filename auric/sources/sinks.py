"""Sinks and physical layout and the typed scan
(S-01). Writers are the only functions in the library that run jobs."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import TABLES

# S-03: per-tenant payment method row (the seeded UPI method).
UPI_METHOD_ROW = {
    "code": ("UPI", T.StringType()),
    "name": ("UPI Payments", T.StringType()),
    "gateway_provider": ("razorpay", T.StringType()),
    "is_enabled": (True, T.BooleanType()),
    "fee_percentage": (Decimal("0.50"), T.DecimalType(5, 2)),
    "fee_fixed": (Decimal("0.00"), T.DecimalType(10, 2)),
}


# --------------------------------------------------------------------- S-01
def scan_table(spark: SparkSession, path: str, table: str | T.StructType) -> DataFrame:
    """Typed scan of a stored table, by its name in :data:`schemas.TABLES` or
    by a schema: never inferred; filters and column pruning reach the parquet
    reader."""
    schema = TABLES[table].schema if isinstance(table, str) else table
    return spark.read.schema(schema).parquet(path)


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with the columns and types of a stored table, in order. Columns
    it lacks are NULL; a text that is no value of its column's type is NULL
    rather than the end of the job (``try_cast``)."""
    return df.select(*[
        (F.col(f.name) if df.schema[f.name].dataType == f.dataType else F.col(f.name).try_cast(f.dataType)).alias(f.name)
        if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in TABLES[table].schema])


def scan_jdbc(spark: SparkSession, url: str, table: str, schema_ddl: str | None = None,
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              num_partitions: int = 64, properties: dict | None = None) -> DataFrame:
    """S-01 against the live database: a JDBC read split into ``num_partitions``
    range queries on ``partition_column`` (e.g. a numeric surrogate key), so
    the table is read in parallel rather than through one connection.
    ``schema_ddl`` pins column types (``customSchema``). Not exercised in the
    tests (no database may be started in this environment)."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if partition_column is not None:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
             .option("upperBound", upper).option("numPartitions", num_partitions))
    if schema_ddl:
        r = r.option("customSchema", schema_ddl)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    return r.load()


# --------------------------------------------------------------------- S-03
def insert_from_query(source: DataFrame, const_cols: dict) -> DataFrame:
    """``INSERT … SELECT tenant_id, <constants> FROM tenants WHERE …``: the rows
    to insert, one per source row."""
    return source.select("tenant_id", *[F.lit(v).cast(t).alias(c) for c, (v, t) in const_cols.items()])


def _by_range(df: DataFrame, n: int | None, *cols) -> DataFrame:
    return df.repartitionByRange(*cols) if n is None else df.repartitionByRange(n, *cols)


# --------------------------------------------------------------------- S-04
def append_ledger(orders: DataFrame, path: str, batch_id: int | str, files: int | None = None) -> None:
    """Add a batch of new transactions, all pending, as folders
    ``batch_id=…/tenant_id=…``. A repeated batch replaces its own folder, so a
    retry leaves the same rows. Rows go to tasks (``files``, or the session's
    shuffle partitions) by range of (tenant, time): a task writes a file per
    tenant it holds, about files + tenants in all, and a dominant tenant is
    spread over several."""
    (_by_range(orders.withColumn("status", F.lit("pending")), files, "tenant_id", "created_at")
     .write.mode("overwrite").option("partitionOverwriteMode", "static")
     .partitionBy("tenant_id").parquet(f"{path.rstrip('/')}/batch_id={batch_id}"))


# --------------------------------------------------------------------- S-05
def tenant_layout(df: DataFrame, path: str, sort_cols=("created_at",), month_col: str | None = None,
                  files: int | None = None, max_records: int = 5_000_000) -> None:
    """One directory per tenant (the reference's per-tenant tables, done as
    partitions): a tenant filter on read becomes partition pruning, and rows
    sorted by time within files give tight min/max statistics.

    With ``month_col`` (e.g. ``"created_at"``) the layout is tenant × month,
    the time partitioning the platform claims for its transactions. A filter
    on ``month`` then prunes whole months as well.

    Rows go to tasks (``files``, or the session's shuffle partitions) by range
    of (tenant, month, sort columns), so a dominant tenant is cut into several
    files instead of being one task, and small tenants share a task."""
    parts = ["tenant_id"]
    if month_col is not None:
        df = df.withColumn("month", F.date_format(F.col(month_col), "yyyy-MM"))
        parts.append("month")
    (_by_range(df, files, *parts, *sort_cols).sortWithinPartitions(*parts, *sort_cols)
     .write.mode("overwrite").option("partitionOverwriteMode", "static")
     .option("maxRecordsPerFile", max_records).partitionBy(*parts).parquet(path))


# --------------------------------------------------------------------- S-06
def report_export(report: DataFrame, path: str, fmt: str = "json", period_col: str | None = None) -> None:
    """Write a compiled report per tenant (and period): JSON lines or CSV. The
    folder then holds this report only, whatever the session's overwrite mode."""
    parts = ["tenant_id"] + ([period_col] if period_col else [])
    w = report.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*parts)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        raise ValueError(fmt)


# --------------------------------------------------------------- A-09 store
def write_by_day(table: DataFrame, path: str, day_col: str = "metric_date") -> None:
    """Store a table by day with dynamic partition overwrite: days that are computed
    again replace their own folders, the others stay."""
    (table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(day_col).parquet(path))


def write_daily_metrics(metrics: DataFrame, path: str) -> None:
    """Persist A-09 by day with dynamic partition overwrite. Recomputing a
    window of days (for example the last few, after late trades) replaces only
    those day partitions, and the table keeps one row per (tenant, day)."""
    write_by_day(metrics, path)
