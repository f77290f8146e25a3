"""Cardinality estimate of a bit-register sketch as a column expression.

The estimator is the HyperLogLog harmonic mean with the published empirical
bias correction. The bias points for one precision (at most 201 pairs) are the
ones Spark ships for ``approx_count_distinct``; they are read once per precision
on the driver and become array literals, so estimating needs no join.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from bitloom.functions.hashing import check_p


def alpha(p: int) -> float:
    """Published HyperLogLog constant for 2^p registers."""
    # Fixed values.
    small = {4: 0.673, 5: 0.697, 6: 0.709}
    return small.get(p, 0.7213 / (1 + 1.079 / (1 << p)))


@lru_cache(maxsize=None)
def bias_points(p: int) -> tuple[tuple[float, float], ...]:
    """(raw estimate, bias) pairs for one precision, ascending."""
    check_p(p)
    spark = SparkSession.getActiveSession()
    if spark is None:
        from bitloom.session import build_session

        spark = build_session()
    published = spark._jvm.org.apache.spark.sql.catalyst.util.HyperLogLogPlusPlusHelper
    raw = published.RAW_ESTIMATE_DATA()[p - 4]
    bias = published.BIAS_DATA()[p - 4]
    return tuple(zip(map(float, raw), map(float, bias)))


def raw_estimate(pow_sum: Column, filled: Column, p: int) -> Column:
    """alpha * m^2 / sum(2^-rank); each of the m - filled empty registers adds 1."""
    m = float(1 << p)
    return F.lit(alpha(p) * m * m) / (pow_sum + (F.lit(m) - filled))


def _doubles(values) -> str:
    # One text literal keeps the plan small; repr round-trips a double.
    return f"cast(split('{','.join(map(repr, values))}', ',') AS array<double>)"


def _bias_sql(p: int) -> str:
    """Bias at the raw estimate ``r``: linear between points, first value below, 0 above."""
    points = bias_points(p)
    xs, ys = _doubles(x for x, _ in points), _doubles(y for _, y in points)
    return f"""get(transform(array(size(filter({xs}, x -> x < r))), i -> CASE
        WHEN i = 0 THEN {points[0][1]!r}D
        WHEN i = {len(points)} THEN 0.0D
        ELSE get({ys}, i - 1) + (r - get({xs}, i - 1)) / (get({xs}, i) - get({xs}, i - 1))
          * (get({ys}, i) - get({ys}, i - 1)) END), 0)"""


def cardinality(pow_sum: str, filled: str, p: int) -> Column:
    """Bias-corrected estimate, rounded half to even, from two columns' names."""
    m = float(1 << p)
    raw = f"{alpha(p) * m * m!r}D / (`{pow_sum}` + ({m!r}D - `{filled}`))"
    return F.expr(f"cast(bround(get(transform(array({raw}), r -> r - {_bias_sql(p)}), 0)) AS bigint)")
