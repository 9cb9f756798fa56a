"""SparkSession construction with settings that matter at scale."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings applied to every session we build.  AQE re-plans joins and
# coalesces small shuffle partitions at run time, and splits skewed join
# partitions; the session time zone is pinned so timestamp casts agree with
# the SQL oracle.
BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Windows/sorts over big groups spill instead of failing.
    "spark.sql.windowExec.buffer.spill.threshold": "131072",
    # A window or aggregate on (doc_id, block) must really be partitioned on
    # both keys; otherwise an upstream doc_id partitioning is reused and one
    # large document lands in one task again.
    "spark.sql.requireAllClusterKeysForDistribution": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "linden", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``.  Only a local
    master may leave it unset (tests); it then gets a fresh scratch folder.
    On a cluster a missing setting is an error, because executors would write
    to their own disks."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or \
        spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if not current:
            sc.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="linden-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate
    tables (lineage cuts that must survive executor loss)."""
    return "/".join([ensure_checkpoint_dir(spark).rstrip("/"), *_STEPS, name])


_STEPS: list[str] = []  # folders of the steps that run, the innermost last


@contextmanager
def step_tables(spark: SparkSession, name: str):
    """Tables that ``materialize`` writes inside are deleted at the end, when
    nothing may read them any more; what the step returns is written with
    ``keep`` and stays beside its folder."""
    _STEPS.append(f"{name}-{uuid.uuid4().hex[:12]}")
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join([ensure_checkpoint_dir(spark).rstrip("/"), *_STEPS]))
    try:
        yield
    finally:
        _STEPS.pop()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_once(df, path: str) -> None:
    """Write ``df`` as Parquet.  The shuffle files of the write go when it ends:
    nothing else refers to its plan, yet else they would stay on the executors'
    disks until the driver's garbage collection finds that out."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = conf.get(key)
    conf.set(key, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        conf.set(key, old)


def release_shuffles(spark: SparkSession) -> None:
    """Collect garbage on the driver, upon which Spark removes the shuffle
    files of plans that nothing refers to any more: those of a job whose result
    is written would else stay on the executors' disks until the next full
    collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df, name: str, keep: int = 0):
    """Cut lineage by writing ``df`` once as parquet under the shared
    checkpoint folder and reading it back.  Every later branch of the plan
    scans the written table instead of recomputing its inputs, and a lost
    executor re-reads files rather than replaying the whole lineage.  The
    table outlives the innermost ``keep`` of the ``step_tables`` around it."""
    spark = df.sparkSession
    outer = _STEPS[:max(len(_STEPS) - keep, 0)]
    path = "/".join([ensure_checkpoint_dir(spark).rstrip("/"), *outer, f"{name}-{uuid.uuid4().hex[:12]}"])
    write_once(df, path)
    return spark.read.parquet(path)
