"""Folds and bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def sample_by_class(rows: DataFrame, label: str, per_class: int, seed: int = 1, size: Column | None = None, most: float = 0.0) -> tuple[DataFrame, list]:
    """About ``per_class`` rows of each class, drawn by a hash of doc_id, and the classes in order.

    Class sizes are counted over all rows. A class with fewer rows is taken whole. With a ``size`` of
    rows, fewer are drawn where ``per_class`` of them would hold more than a class's part of ``most``.
    """
    found = rows.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*"), F.avg(F.lit(0) if size is None else size)).collect()
    counts = {r[0]: r[1] for r in found}
    classes = sorted(counts)
    if not classes:
        return rows.limit(0), []
    if size is not None:
        wanted = {r[0]: min(per_class, most / len(classes) / max(1.0, r[2] or 0)) for r in found}
    else:
        wanted = dict.fromkeys(classes, per_class)
    share = F.lit(0)
    for c in classes:
        share = F.when(F.col(label) == F.lit(c), F.lit(int(min(1.0, wanted[c] / counts[c]) * 2**30))).otherwise(share)
    return rows.filter(F.col(label).isNotNull() & (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(2**30)) < share)), classes
