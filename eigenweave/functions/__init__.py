"""SQL functions on vectors, registered by register()."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name: SQL body over its arguments. Built-in expressions, so Catalyst sees through them.
FUNCTIONS = {
    "vec_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "vec_norm": ("a ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"),
    "vec_sub": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "zip_with(a, b, (x, y) -> x - y)"),
    "vec_clip": ("a ARRAY<DOUBLE>, bound DOUBLE", "ARRAY<DOUBLE>", "transform(a, x -> x * least(1D, bound / (sqrt(aggregate(a, 0D, (s, y) -> s + y * y)) + 1e-10D)))"),
    "pca_project": ("x ARRAY<DOUBLE>, center ARRAY<DOUBLE>, loadings ARRAY<ARRAY<DOUBLE>>", "ARRAY<DOUBLE>", "transform(loadings, w -> aggregate(zip_with(zip_with(x, center, (a, m) -> a - m), w, (a, b) -> a * b), 0D, (s, v) -> s + v))"),
    "gaussian_noise_scale": ("sensitivity DOUBLE, epsilon DOUBLE, delta DOUBLE", "DOUBLE", "sensitivity * sqrt(2 * ln(1.25 / delta)) / epsilon"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions as temporary SQL functions of the session."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
