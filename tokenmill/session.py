"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def _default_driver_memory() -> str:
    """8 GB, but never more than 60 % of this machine's memory (local mode)."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
        return f"{max(1, min(8, int(total * 0.6 / 2 ** 30)))}g"
    except (ValueError, OSError, AttributeError):
        return "4g"


def build_session(master: str | None = None, app: str = "tokenmill",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A session configured for these jobs (AQE on, UI off, UTC)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.driver.memory": os.environ.get("TOKENMILL_DRIVER_MEMORY", _default_driver_memory()),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        # reliable checkpoints are deleted once their lineage is unreachable
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Arrow batches for the codec: bounded so one long document does not
        # blow a Python worker's memory.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_code(spark)
    return spark


_SHIPPED: set[str] = set()
_SHIP_LOCK = threading.Lock()


def ship_code(spark: SparkSession) -> None:
    """Make this package importable in every Python worker (once per app).

    Arrow UDFs and ``mapInPandas`` functions are pickled by module reference,
    so executors need the package: it is zipped on the driver and handed to
    ``addPyFile``, which distributes it with the application.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    with _SHIP_LOCK:
        if key in _SHIPPED:
            return
        pkg = os.path.dirname(os.path.abspath(__file__))
        root = os.path.dirname(pkg)
        zpath = os.path.join(tempfile.mkdtemp(prefix="tokenmill-code-"), "tokenmill.zip")
        with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
            for dirpath, _, files in os.walk(pkg):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(dirpath, f)
                        z.write(full, os.path.relpath(full, root))
        sc.addPyFile(zpath)
        _SHIPPED.add(key)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Read from the session. Only a local master, where driver and executors
    are one process, gets a private folder when it is unset; on a cluster
    that is an error, since executors could not reach the driver's disk.
    """
    base = spark.conf.get(_CKPT_KEY, None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"set {_CKPT_KEY} to a folder that all executors of this cluster share")
        base = tempfile.mkdtemp(prefix="tokenmill-ckpt-")
        spark.conf.set(_CKPT_KEY, base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder for a written table."""
    return f"{shared_dir(spark)}/tokenmill/{name}-{uuid.uuid4().hex[:12]}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table this package wrote (any Hadoop filesystem)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut_lineage(df, spark: SparkSession | None = None):
    """Reliable checkpoint (never a local one): survives executor loss."""
    spark = spark or df.sparkSession
    shared_dir(spark)
    return df.checkpoint(eager=True)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
