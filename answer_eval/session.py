"""Session helpers: the three settings the operators rely on, and a checkpoint dir.

The library never creates global state other than through these helpers.  On a
cluster the checkpoint directory must be a shared folder named by the cluster in
``spark.checkpoint.dir``; only a local-mode session without one (tests, the
local bench) gets a fresh scratch folder.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings the operators depend on for exact semantics:
#   - UTC so TIMESTAMP_NTZ -> TIMESTAMP casts (elapsed times) do not shift;
#   - LAST_WIN so duplicate tag names keep the last body (parse_tags);
#   - duplicate JSON keys parse (last wins) instead of turning the request to NULL.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Scale-oriented defaults, applied only when the user has not set them.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # transformWithState keeps its state there
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def _ship_package() -> None:
    """Serialise this package's Python functions (pandas UDFs, state functions,
    answerers) by value, so executors need not have the package installed."""
    try:
        from pyspark import cloudpickle
        import answer_eval
        cloudpickle.register_pickle_by_value(answer_eval)
    except (ImportError, AttributeError, ValueError):  # older cloudpickle or already registered
        pass


def configure(spark: SparkSession) -> SparkSession:
    """Apply the required settings to an existing session (idempotent)."""
    _ship_package()
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    for key, value in DEFAULT_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory, setting one only where none is set.

    Order: an already active checkpoint dir; else ``spark.checkpoint.dir`` from the
    configuration; else, in local mode only, a fresh scratch folder.  A cluster
    session without a shared checkpoint folder is an error, never a local path.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS) before running operators that checkpoint"
        )
    scratch = tempfile.mkdtemp(prefix="answer-eval-ckpt-")
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir() or scratch


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if its few splits would leave some idle (its rows are then shuffled once)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def get_session(master: str | None = None, app_name: str = "answer_eval",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the required settings; UI stays off."""
    builder = (SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    driver_mem = os.environ.get("ANSWER_EVAL_DRIVER_MEMORY")
    if driver_mem:
        builder = builder.config("spark.driver.memory", driver_mem)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
