"""Spark session and shared-folder helpers.

On a cluster the session comes from the launcher; ``get_session`` only fills in
settings that are unset, so cluster-wide values (shuffle partitions, the
checkpoint folder, memory) always win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on.  They are defaults only: a value already set on
# the cluster is left alone.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app_name: str = "folio",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = (builder.master(master)
                   .config("spark.driver.host", "127.0.0.1")
                   .config("spark.driver.bindAddress", "127.0.0.1")
                   .config("spark.ui.enabled", "false")
                   .config("spark.ui.showConsoleProgress", "false")
                   .config("spark.driver.memory", "16g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> None:
    for key, value in _DEFAULTS.items():
        if spark.conf.get(key, None) in (None, ""):
            spark.conf.set(key, value)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when nothing is configured and the master is local (tests) a
    scratch folder is created and registered; on a cluster an unset folder is
    an error, never a machine-local fallback.
    """
    conf_dir = spark.sparkContext.getCheckpointDir()
    if conf_dir:
        return conf_dir
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not spark.sparkContext.master.startswith("local"):
            # a machine-local folder is not visible to other executors
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS or an "
                               "object store) for checkpoints, streams and store batches")
        conf_dir = tempfile.mkdtemp(prefix="folio-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(conf_dir)
    return spark.sparkContext.getCheckpointDir() or conf_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A path for a materialised intermediate table inside the shared folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def write_shared(df, name: str):
    """Write ``df`` once as parquet in the shared folder and read it back: later
    reads see the same rows, read only the columns they need, and a lost
    executor replays nothing of the plan above."""
    import uuid
    path = shared_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def drop_shared(df) -> None:
    """Delete the files of a written table that nothing reads any more."""
    target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_path)
    target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
