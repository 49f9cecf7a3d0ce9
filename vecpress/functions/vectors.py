"""Vector expressions from higher-order functions: no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def l2_sq(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance in double precision; vectors of different length give null."""
    a, b = _col(a), _col(b)
    diff = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(diff, F.lit(0.0), lambda s, x: s + x)


def code_hamming(a: Column | str, b: Column | str) -> Column:
    """Number of places at which two code arrays differ."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def sub_vector(v: Column | str, start: int, size: int) -> Column:
    """Dimensions start..start+size-1, counted from 0."""
    return F.slice(_col(v), start + 1, size)


def subspaces(df: DataFrame, parts: int, dim: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row per vector and part: ``key, part, sub``. The dimension must be a multiple of ``parts``."""
    if parts < 1 or dim % parts:
        raise ValueError(f"{dim} dimensions can't be split into {parts} equal parts")
    w = dim // parts
    pieces = F.array(*[sub_vector(vector, p * w, w) for p in range(parts)])
    return df.select(key, F.posexplode(pieces).alias("part", "sub"))


def safe_div(a: Column, b: Column, eps: float = 1e-5) -> Column:
    """a / b, or 0 where b is about 0."""
    return F.when(F.abs(b) > eps, a / b).otherwise(F.lit(0.0))


def safe_inf(a: Column, cap: float = 1e100) -> Column:
    """Infinite values replaced by a number that JSON can hold."""
    return F.when(a == float("inf"), F.lit(cap)).when(a == float("-inf"), F.lit(-cap)).otherwise(a)


def block_digit(block_id: Column | str, mask: int, blocks: int) -> Column:
    """The digit of a block id that belongs to one split dimension."""
    return F.floor(_col(block_id) / F.lit(mask)).cast("long") % blocks


def symbol_bits(alphabet: Column) -> Column:
    """Bits of a raw symbol: at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.log2(alphabet.cast("double")))).cast("int")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
