"""Null-safe arithmetic. NULL stands for every missing or undefined number."""

from pyspark.sql import functions as F


def as_col(c):
    return F.col(c) if isinstance(c, str) else c


def finite(c):
    """NaN and infinities become NULL."""
    x = as_col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def with_finite(df, columns):
    """NaN and infinities of the named floating-point columns become NULL; other types and missing names stay as they are."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: finite(c) for c in columns if kinds.get(c) in ("double", "float")})


def ratio(a, b):
    """a / b, NULL on a zero divisor."""
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


def change(a, b):
    return ratio(a, b) - 1.0


def flag(condition):
    """1 where the condition holds, 0 where it fails or is unknown."""
    return F.when(condition, 1).otherwise(0)


def epoch_micros(df, name):
    """Microseconds since 1970 of a timestamp column; naive values count as wall time, whatever the session zone."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(name))
    return F.unix_micros(name)
