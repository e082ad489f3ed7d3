"""Session settings shared by tests, bench and the driver entry points."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every query relies on: UTC wall clock (the fixture timestamps are
# zone-less), ANSI errors on (bad casts must use try_* on purpose), AQE for
# runtime join selection, partition coalescing and skew splitting.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "shopfloor", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings above.

    On a cluster pass ``master=None`` and let spark-submit decide; locally
    the shuffle partition count should match the cores, not the default 200.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k, v in conf.items():
        if not k.startswith("spark.ui") and not k.startswith("spark.driver"):
            try:
                spark.conf.set(k, v)
            except Exception:  # static conf of an already running session
                pass
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory.

    The location comes from ``spark.checkpoint.dir`` on the session (the
    folder every executor can reach).  Only a local session (``local[*]``,
    tests) may leave it unset and gets a scratch folder; any other master
    raises, because a machine-local folder would be a different one on every
    node.  The folder is deleted when the session's JVM ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir is not set (master {master}); "
                               "intermediate tables need a folder that every executor shares")
        base = tempfile.mkdtemp(prefix="shopfloor-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    name = "-".join(parts + (uuid.uuid4().hex[:12],)) if parts else uuid.uuid4().hex
    path = base.rstrip("/") + "/" + name
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return path


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``shopfloor`` importable in Python workers (state functions are
    pickled by reference to their module).  The package is zipped once per
    SparkContext and added with ``addPyFile``; Spark copies it to every
    executor, so no worker reads the driver's disk."""
    import shutil
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    base = shared_dir(spark, "pyfiles")
    # the zip is written by the driver; on a non-local shared folder it is
    # staged on the driver and Spark's file server hands it to executors
    stage = base[len("file://"):] if base.startswith("file://") else (
        base[len("file:"):] if base.startswith("file:") else base)
    if "://" in stage:
        stage = tempfile.mkdtemp(prefix="shopfloor-pyfiles-")
    archive = shutil.make_archive(os.path.join(stage, "shopfloor"), "zip", os.path.dirname(pkg_dir), "shopfloor")
    sc.addPyFile(archive)
    _SHIPPED.add(app)
