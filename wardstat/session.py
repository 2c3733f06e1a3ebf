"""Session helpers: a local session for tests/bench and the shared
checkpoint folder used to cut lineage.

On a cluster the caller owns the session; the library only reads
``spark.checkpoint.dir`` from it.  A folder is set here only when the
session has none (local tests), never over a cluster setting.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every session used by this library should carry.  AQE re-plans
# joins at runtime (broadcast when a shuffled side turns out small, splits
# skewed partitions) and coalesces small shuffle partitions.
RECOMMENDED_CONF: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "wardstat", extra: dict | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
    )
    for k, v in {**RECOMMENDED_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder (``spark.checkpoint.dir``).

    A scratch folder is created only for a local-mode session that has
    none (tests); a cluster session without a shared checkpoint folder is
    an error, since a machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not current:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if current:
            sc.setCheckpointDir(current)
    if not current:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...)")
        current = tempfile.mkdtemp(prefix="wardstat-ckpt-")
        sc.setCheckpointDir(current)
    return current
