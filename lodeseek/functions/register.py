"""The vector and text functions for plain SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession

_SUM = "aggregate({0}, 0D, (s, x) -> s + x)"
DEFINITIONS = {
    "vec_dot(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE": _SUM.format("zip_with(a, b, (x, y) -> double(x) * double(y))"),
    "vec_l2sq(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE": _SUM.format("zip_with(a, b, (x, y) -> (double(x) - double(y)) * (double(x) - double(y)))"),
    "vec_norm(a ARRAY<FLOAT>) RETURNS DOUBLE": "sqrt(" + _SUM.format("transform(a, x -> double(x) * double(x))") + ")",
    "vec_quantize(a ARRAY<FLOAT>, r DOUBLE) RETURNS ARRAY<INT>": "transform(a, x -> CASE WHEN isnan(x) THEN 0 ELSE int(greatest(-127D, least(127D, round(double(x) * (127D / greatest(r, 1e-9D)))))) END)",
    "sig_hamming(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS INT": "aggregate(zip_with(a, b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)",
    "keyword_tokens(t STRING) RETURNS ARRAY<STRING>": "regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+', 0)",
}


def register(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions; returns their names."""
    for head, body in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in DEFINITIONS]
