"""SparkSession settings the operators assume, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session should carry.  AQE re-plans joins at run time from the
# real sizes of materialised shuffle stages, so small derived tables (bucket
# totals, per-model statistics) are broadcast only when they really are small,
# and skewed shuffle partitions are split.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def get_spark(master: str | None = None, app: str = "tabeval", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Create (or return) a session with the settings above.

    ``master`` is only set when given: on a cluster the launcher decides.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session without
    the setting, as in tests, gets a folder of its own; elsewhere that is an error,
    because each executor would write to its own disk.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="tabeval-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table inside the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), name)


def materialize(df, name: str = "table"):
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    For an intermediate result that several later steps read: the input behind it
    is scanned once, the lineage is cut, the copy survives lost executors, and the
    optimizer sees its real size (AQE broadcasts it only if it is small).
    """
    import uuid
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


SMALL_ROWS = 200_000   # rows of a side that may be broadcast


def small_side(df, limit: int = SMALL_ROWS):
    """``df`` marked for broadcast when it is counted to have at most ``limit`` rows;
    otherwise unmarked, so the join shuffles.  For sides that are cheap to count."""
    from pyspark.sql import functions as F
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
