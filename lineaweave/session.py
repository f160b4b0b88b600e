"""Session helpers: a configured local session for tests/bench and the
lineage-cutting primitive used by every iterative operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "lineaweave") -> SparkSession:
    """Session for tests and the bench. On a cluster, callers pass their own
    session; nothing in the library depends on these settings except UTC."""
    master = master or os.environ.get("LINEAWEAVE_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LINEAWEAVE_DRIVER_MEM", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only a local-mode session without one
    (tests, bench) gets a fresh scratch folder; a cluster session without the
    setting is an error, because a machine-local folder does not survive the
    loss of an executor."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir() or conf
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder for iterative operators")
    path = tempfile.mkdtemp(prefix="lineaweave-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def materialize(df: DataFrame, tag: str = "step") -> DataFrame:
    """Cut the lineage of intermediate state: write ``df`` as parquet into
    the shared folder named by ``spark.checkpoint.dir`` and read it back.

    Plans no longer grow per hop, and a lost executor never replays the
    work before the cut, because the files outlive it. The re-read relation
    also carries its real file size. A checkpointed RDD would only carry
    the optimizer's pre-execution estimate, which explodes through joins.
    With the real size, the planner's own ``autoBroadcastJoinThreshold``
    check broadcasts a small frontier and shuffles a large one."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/lw-{tag}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
