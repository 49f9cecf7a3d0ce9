"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_local_dirs: dict[str, str] = {}
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package, whatever their working folder, and hand
    them smaller batches than by default (a session's own setting stays).

    On a cluster the package has to be installed or passed with ``--py-files``; a path that an
    executor doesn't have is ignored there.
    """
    if spark.conf.get(_BATCH_ROWS) == "10000":  # Spark's own default holds many megabytes of long texts at once
        spark.conf.set(_BATCH_ROWS, "1000")
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder; any other master is an error, since
    a folder of one machine would be lost with that machine.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local_dirs:
        tmp = tempfile.TemporaryDirectory(prefix="vecpress-")
        atexit.register(tmp.cleanup)
        _local_dirs[sc.applicationId] = tmp.name
    return _local_dirs[sc.applicationId]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: the cluster's own cleaning of the folder is left
        pass


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    The files stay until ``discard`` or the end of the Python process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vecpress/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    _tables.append((weakref.ref(spark), path))
    return out


def discard(*stored: DataFrame | None) -> None:
    """Delete tables that ``materialize`` returned, once nothing that is still to run reads them."""
    for df in stored:
        path = getattr(df, "_stored_at", None)
        if path:
            _remove(df.sparkSession, path)
            _tables[:] = [t for t in _tables if t[1] != path]


_tables: list[tuple] = []


@atexit.register
def _drop_tables() -> None:
    for ref, path in _tables:
        spark = ref()
        if spark is not None:
            _remove(spark, path)
