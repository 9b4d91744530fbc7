"""SparkSession construction and cluster-aware helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(
    master: str | None = None,
    app_name: str = "shoptide",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the settings every job here assumes.

    * UTC session time zone, so event time is unambiguous.
    * AQE on: runtime partition coalescing, skew-join splitting and
      size-checked broadcast conversion.
    * Spark UI off (no HTTP server).

    Master, shuffle partitions and memory are the cluster's own settings unless
    they are given here.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = (
        b
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may lack the setting (all its tasks share one machine);
    it then gets a folder of its own. On a cluster a missing setting is an
    error, as executors could not read each other's local files.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="shoptide-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def materialize(df, name: str):
    """Write ``df`` as a parquet table under the shared checkpoint folder and read it back.

    Used where one derived table feeds several branches of a plan (Spark would
    otherwise recompute it per branch, since pruned branches do not share an
    exchange). Cutting lineage here also bounds recomputation when an executor
    is lost. The folder comes from ``spark.checkpoint.dir`` (see
    :func:`checkpoint_dir`); a fresh sub-folder per call keeps runs independent.
    """
    import uuid

    spark = df.sparkSession
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/shoptide/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # known schema: no footer-inference job
