import math
import random

import pytest
from pyspark.sql import functions as F

from vecpress.functions import bits, vectors
from vecpress.operators import huffman


def test_bits_of_byte_strings():
    data = bytes.fromhex("123456789abcde")
    w = bits.BitWriter()
    w.write(data, 4)
    w.write(data[1:], 12)
    w.write(data[3:], 28)
    want = "000100110100010101111000100110101011110011010000"
    assert w.bits() + "0000" == want and bits.unpack_bits(w.getvalue()) == want
    r = bits.BitReader(w.getvalue())
    assert r.read(4) + r.read(12) + r.read(28) == want[:44]
    with pytest.raises(EOFError):
        r.read(5)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 300, 2**21, 2**28 - 1])
def test_varint(n):
    assert bits.decode_varint(b"x" + bits.encode_varint(n), 1) == (n, 1 + len(bits.encode_varint(n)))


def test_varint_limit():
    with pytest.raises(ValueError):
        bits.encode_varint(2**28)


def test_columns(spark):
    r = spark.range(1).select(
        vectors.l2_sq(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(4.0), F.lit(6.0))).alias("d"),
        vectors.code_hamming(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(1), F.lit(0), F.lit(0))).alias("h"),
        vectors.safe_div(F.lit(1.0), F.lit(1e-6)).alias("z"),
        vectors.safe_inf(F.lit(float("inf"))).alias("i"),
        vectors.block_digit(F.lit(23), 3, 4).alias("g"),
        vectors.symbol_bits(F.lit(6)).alias("b6"),
        vectors.symbol_bits(F.lit(1)).alias("b1"),
        bits.to_bits(F.lit(5), 8).alias("s"),
        bits.get_bit(F.lit(128), 0).alias("t"),
    ).first()
    assert tuple(r) == (25.0, 2, 0.0, 1e100, 3, 3, 1, "00000101", 1)


def test_split_must_be_even(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError):
        vectors.subspaces(df, 2, 3)
    assert vectors.subspaces(df, 3, 3).count() == 3


def cost(counts):
    codes = huffman.build_codes(enumerate(counts))
    return sum(counts[s] * len(c) for s, c in codes.items())


@pytest.mark.parametrize(("counts", "want"), [([0, 21, 13, 8, 5, 3, 2, 1, 1, 0], 132), ([1, 4, 3, 8, 3, 8], 65), ([0, 7], 7), ([], 0), ([0, 0], 0)])
def test_known_costs(spark, counts, want):
    assert cost(counts) == want
    df = spark.createDataFrame([(counts,)], "c array<long>")
    assert df.select(huffman.huffman_cost(F.col("c"))).first()[0] == want


def test_single_symbol_has_one_bit():
    assert huffman.build_codes([(9, 5)]) == {9: "0"}


@pytest.mark.parametrize("seed", range(25))
def test_codes_are_prefix_free_and_near_entropy(seed):
    rnd = random.Random(seed)
    counts = [rnd.choice([0, 1, 2, 5, 100, 1000]) for _ in range(rnd.randint(2, 60))]
    codes = huffman.build_codes(enumerate(counts))
    assert set(codes) == {s for s, c in enumerate(counts) if c}
    if len(codes) > 1:
        assert math.isclose(sum(2.0 ** -len(c) for c in codes.values()), 1)
        ordered = sorted(codes.values())
        assert not any(b.startswith(a) for a, b in zip(ordered, ordered[1:]))
        n = sum(counts)
        entropy = -sum(c / n * math.log2(c / n) for c in counts if c)
        assert entropy - 1e-9 <= cost(counts) / n < entropy + 1


def test_fold_equals_heap(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.randint(0, 50) for _ in range(rnd.randint(0, 40))]) for i in range(40)]
    got = dict(spark.createDataFrame(rows, "i long, c array<long>").select("i", huffman.huffman_cost(F.col("c"))).collect())
    assert got == {i: cost(c) for i, c in rows}
