"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every job wants: AQE re-plans partition counts and splits skewed
# join partitions at run time; the UI stays off (no listening server).
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    # co-partitioned joins may share a prefix of their keys (doc_id): data
    # hash-partitioned on doc_id once is joined on (doc_id, sid) in place
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def get_spark(master: str | None = None, app: str = "factlake",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults above.

    ``master`` is only set when given, so ``spark-submit`` decides on a
    cluster.  ``spark.checkpoint.dir`` is read from the session; a scratch
    folder is set only when the cluster did not name one (tests, laptops).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be a shared file system path set by the
    deployment; without it this raises, as executors cannot read each other's
    folders.  Only a local master (tests, laptops) gets a fresh scratch folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="factlake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared folder (never ``localCheckpoint``):
    the result survives the loss of the executors that computed it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def free_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of ended jobs when the driver's JVM has
    collected their plans; a small driver may not do that for the whole run."""
    spark.sparkContext._jvm.System.gc()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
