"""Session helpers.

The library never creates its own cluster settings beyond what a job needs:
UTC session time zone, AQE on, and a checkpoint folder that must be the
shared one the cluster names in ``spark.checkpoint.dir``.  Only when nothing
is configured *and* Spark runs in local mode (tests, laptop) do we fall back
to a fresh scratch folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "pagelake") -> SparkSession:
    """Create (or reuse) a session with the settings every job here assumes."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the per-session settings the operators rely on (idempotent)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, setting it from ``spark.checkpoint.dir``.

    On a cluster the folder must be shared storage named by the cluster; we
    never invent a machine-local one there.  In local mode with nothing set
    (unit tests) a fresh scratch folder is used.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            configured = None
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    scratch = tempfile.mkdtemp(prefix="pagelake-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.

    It survives lost executors, is computed once, and later reads prune
    columns and know its size.
    """
    path = shared_dir(df.sparkSession, f"cut/{uuid.uuid4().hex}")
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the sub-folders that jobs of this library wrote under the shared folder.

    Call it when no result is needed any more: frames that read them fail then.
    """
    base = ensure_checkpoint_dir(spark).rstrip("/")
    jvm = spark.sparkContext._jvm
    for name in ("cut", "tables", "llm"):
        path = jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
