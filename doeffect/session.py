"""Session helpers: a local session for tests/bench and the checkpoint folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "doeffect") -> SparkSession:
    """A local session for tests and benchmarks (no UI, AQE on)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Plans here are built from many Column calls; capturing the Python
        # call site of each one costs several JVM round trips per call.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def _context(spark: SparkSession):
    try:
        return spark.sparkContext
    except Exception:  # Spark Connect: no driver-side context
        return None


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster configured, if any."""
    sc = _context(spark)
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured and sc is not None:
        sc.setCheckpointDir(configured)
    return configured or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session; a scratch folder only for local runs.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder: a
    machine-local one would not survive the loss of an executor.
    """
    found = checkpoint_dir(spark)
    if found:
        return found
    sc = _context(spark)
    master = sc.master if sc is not None else spark.conf.get("spark.master", "")
    if sc is None or not master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a shared folder for master {master!r}")
    scratch = tempfile.mkdtemp(prefix="doeffect-ckpt-")
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir() or scratch


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the checkpoint folder, for tables that a query
    writes and reads back; what is there is removed when the process ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    sc = _context(spark)
    if sc is not None:
        atexit.register(_remove, sc._jvm, sc._jsc.hadoopConfiguration(), path)
    return path


def _remove(jvm, hadoop_conf, path: str) -> None:
    try:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(hadoop_conf).delete(folder, True)
    except Exception:  # the JVM is gone already
        pass
