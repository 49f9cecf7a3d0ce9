"""Incremental neighbour tables: each micro-batch of candidate pairs is merged into a stored table.

``merge_nn`` is associative and repeats don't count twice, so a batch that is run again after a
failure changes nothing. Versions of the table are written side by side; the newest whole one counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecpress.operators.knn import merge_nn


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def newest(spark: SparkSession, path: str) -> int | None:
    """Number of the newest version that was written to its end."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    found = []
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        done, _ = _fs(spark, f"{path}/{name}/_SUCCESS")
        if name.startswith("v") and name[1:].isdigit() and fs.exists(done):
            found.append(int(name[1:]))
    return max(found, default=None)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    v = newest(spark, path)
    return None if v is None else spark.read.parquet(f"{path}/v{v}")


def merge_batch(path: str, k: int):
    """A ``foreachBatch`` function for pairs ``vec_id, nbr_id, dist``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = newest(spark, path)
        table = batch.select("vec_id", "nbr_id", "dist")
        base = spark.read.parquet(f"{path}/v{old}") if old is not None else table.limit(0)
        merged = merge_nn(base, table, k)
        merged.write.mode("overwrite").parquet(f"{path}/v{(old or 0) + 1}")
        if old is not None and old > 1:
            p, fs = _fs(spark, f"{path}/v{old - 1}")
            fs.delete(p, True)

    return run


def stream_pairs(pairs: DataFrame, path: str, checkpoint: str, k: int, once: bool = True):
    """Start merging a stream of pairs into the table at ``path``."""
    w = pairs.writeStream.foreachBatch(merge_batch(path, k)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
