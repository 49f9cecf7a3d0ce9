"""Functions for use from SQL: ``register(spark)``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# pure SQL expressions: Catalyst inlines them
L2_SQ = "aggregate(zip_with(a, b, (x, y) -> (cast(x as double) - cast(y as double)) * (cast(x as double) - cast(y as double))), 0D, (s, x) -> s + x)"
CODE_HAMMING = "aggregate(zip_with(a, b, (x, y) -> cast(x <> y as int)), 0, (s, x) -> s + x)"
HUFFMAN_COST = (
    "case when size(filter(a, c -> c > 0)) = 0 then 0L when size(filter(a, c -> c > 0)) = 1 then array_max(a) else "
    "aggregate(sequence(2, size(filter(a, c -> c > 0))), named_struct('l', array_sort(filter(a, c -> c > 0)), 't', 0L), (s, i) -> "
    "named_struct('l', array_sort(concat(slice(s.l, 3, greatest(size(s.l) - 2, 0)), array(s.l[0] + s.l[1]))), 't', s.t + s.l[0] + s.l[1])).t end"
)


def register(spark: SparkSession) -> None:
    from vecpress.functions.bits import unpack_bits
    from vecpress.operators.codec import Decoder
    from vecpress.operators.huffman import NO_CTX, build_codes
    from vecpress.session import ship_package
    from vecpress.sources import vecs

    ship_package(spark)
    spark.sql(f"create or replace temporary function l2_sq(a array<float>, b array<float>) returns double return {L2_SQ}")
    spark.sql(f"create or replace temporary function code_hamming(a array<int>, b array<int>) returns int return {CODE_HAMMING}")
    spark.sql(f"create or replace temporary function huffman_cost(a array<bigint>) returns bigint return {HUFFMAN_COST}")

    @F.pandas_udf(T.MapType(T.IntegerType(), T.StringType()))
    def huffman_codes(counts: pd.Series) -> pd.Series:
        """Codes of symbols 0, 1, ... with these counts."""
        return counts.map(lambda c: build_codes(enumerate(int(x) for x in c)) if c is not None else None)

    @F.udtf(returnType="vec_id bigint, embedding array<double>")
    class vecs_scan:
        def eval(self, path: str):
            for i, row in enumerate(vecs.read_rows(path)):
                yield i, [float(x) for x in row]

    @F.udtf(returnType="place bigint, codes array<int>")
    class huffman_decode:
        """Vectors of a chunk's stream. ``books`` has for each part the codes of symbols by context:
        -1 alone for codes without context, else that of the vector before, the first vector raw."""

        def eval(self, data: bytes, n_bits: int, books: list):
            if data is None or n_bits is None or books is None:
                return
            by = {(part, ctx): codes for part, book in enumerate(books) for ctx, codes in book.items()}
            d, none = Decoder(unpack_bits(bytes(data), n_bits), by), [NO_CTX] * len(books)
            before = none if all(set(book) == {NO_CTX} for book in books) else None
            place = 0
            while d.at < n_bits:
                row = [d.raw() for _ in books] if before is None else d.row(before)
                before = none if before is none else row
                yield place, row
                place += 1

    spark.udf.register("huffman_codes", huffman_codes)
    spark.udtf.register("huffman_decode", huffman_decode)
    spark.udtf.register("vecs_scan", vecs_scan)
    vecs.register(spark)
