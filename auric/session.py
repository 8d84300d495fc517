"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC so NTZ/instant conversions are stable,
# AQE (partition coalescing + skew-join splitting) for runtime re-planning.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.maxMetadataStringLength": "1000",  # plans show whole filters
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def cluster_conf(total_cores: int, target_partition_mb: int = 256) -> dict:
    """SQL settings for a large cluster (e.g. 1000 executors reading ~100 TB).

    Start from about four shuffle partitions per core and let AQE coalesce them
    to ~``target_partition_mb`` each. Split scans at the same size, split
    skewed join partitions, broadcast only what the optimizer proves small
    (dimensions and tenant tables), and keep the Arrow batches of the two
    folds small enough to stay cache-resident. All are session-settable, see
    :func:`apply_conf`."""
    mb = f"{target_partition_mb}m"
    return {
        "spark.sql.shuffle.partitions": str(4 * total_cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": mb,
        "spark.sql.files.maxPartitionBytes": mb,
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": mb,
        "spark.sql.autoBroadcastJoinThreshold": "64m",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
    }


def apply_conf(spark: SparkSession, conf: dict) -> SparkSession:
    for k, v in conf.items():
        spark.conf.set(k, v)
    return spark


def get_spark(app: str = "auric", cores: str | int = "*", shuffle_partitions: int = 8,
              extra: dict | None = None) -> SparkSession:
    """Local session for tests and benchmarks. On a cluster the session is
    provided by the platform and only ``BASE_CONF`` needs to be applied."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and streaming checkpoints.

    The cluster names it in ``spark.checkpoint.dir`` (a static setting, read
    from the session, never changed at runtime). Only a local master may leave
    it unset (tests): then a temporary folder is created and registered."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(d)
        return d
    existing = getattr(spark.sparkContext, "_auric_ckpt", None)
    if existing:
        return existing
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set; on a cluster it must name a shared folder")
    d = tempfile.mkdtemp(prefix="auric-ckpt-")
    spark.sparkContext.setCheckpointDir(d)
    spark.sparkContext._auric_ckpt = d
    return d


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per context, as ``--py-files``
    would, so that Python functions can be unpickled there."""
    sc = spark.sparkContext
    if getattr(sc, "_auric_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="auric-pkg-"), "auric.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("auric", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._auric_shipped = True
