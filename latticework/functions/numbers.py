"""Arithmetic on matrix values as Column expressions: real columns, or struct<re, im> for complex values.

Division by zero gives signed infinities or NaN and domain errors give NaN, as in IEEE arithmetic, whatever the
session's ANSI setting is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SPARK_TYPES = {
    "int32": "int", "int64": "bigint", "float32": "float", "float64": "double",
    "complex64": "struct<re:float,im:float>", "complex128": "struct<re:double,im:double>",
}


def is_complex(dtype: str) -> bool:
    return dtype.startswith("complex")


def common_dtype(*dtypes: str) -> str:
    """The type that holds values of all these types; integers are promoted to float64 by a float."""
    return np.result_type(*(np.dtype(d) for d in dtypes)).name


def spark_type(dtype: str) -> str:
    if dtype not in SPARK_TYPES:
        raise TypeError(f"no matrix values of type {dtype}")
    return SPARK_TYPES[dtype]


def as_literal(x, dtype: str) -> Column:
    if is_complex(dtype):
        x = complex(x)
        return pair(F.lit(x.real), F.lit(x.imag)).cast(spark_type(dtype))
    return F.lit(x).cast(spark_type(dtype))


def pair(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def convert(x: Column, old: str, new: str) -> Column:
    if old == new:
        return x
    if is_complex(new) and not is_complex(old):
        return pair(x.cast("double"), F.lit(0.0)).cast(spark_type(new))
    if is_complex(old) and not is_complex(new):
        return x["re"].cast(spark_type(new))
    return x.cast(spark_type(new))


def add(x: Column, y: Column, dtype: str) -> Column:
    return pair(x["re"] + y["re"], x["im"] + y["im"]).cast(spark_type(dtype)) if is_complex(dtype) else x + y


def multiply(x: Column, y: Column, dtype: str) -> Column:
    if not is_complex(dtype):
        return x * y
    return pair(x["re"] * y["re"] - x["im"] * y["im"], x["re"] * y["im"] + x["im"] * y["re"]).cast(spark_type(dtype))


def negate(x: Column, dtype: str) -> Column:
    return pair(-x["re"], -x["im"]).cast(spark_type(dtype)) if is_complex(dtype) else -x


def conjugate(x: Column, dtype: str) -> Column:
    return pair(x["re"], -x["im"]).cast(spark_type(dtype)) if is_complex(dtype) else x


def zero(dtype: str) -> Column:
    return as_literal(0, dtype)


def total(x: Column, dtype: str) -> Column:
    """Aggregate: the sum in the type of the values."""
    if is_complex(dtype):
        return pair(F.sum(x["re"]), F.sum(x["im"])).cast(spark_type(dtype))
    return F.sum(x).cast(spark_type(dtype))


def is_zero(x: Column, dtype: str) -> Column:
    return (x["re"] == 0) & (x["im"] == 0) if is_complex(dtype) else x == 0


def divide(x: Column, y: Column) -> Column:
    """x / y of real columns with the IEEE results for y = 0."""
    x, y = x.cast("double"), y.cast("double")
    by_zero = F.when(F.isnan(x) | (x == 0), F.lit(float("nan"))).otherwise(F.signum(x) * F.lit(float("inf")))
    return F.when(y == 0, by_zero).otherwise(x / F.when(y != 0, y))


def _whole(f) -> Callable[[Column], Column]:
    """floor and ceil give BIGINT; matrices keep doubles, and values beyond BIGINT are whole already."""
    return lambda x: F.when(F.abs(x) < 2.0**52, f(F.when(F.abs(x) < 2.0**52, x)).cast("double")).otherwise(x)


def _domain(f, low: float) -> Callable[[Column], Column]:
    """NaN below the domain's bound, where Spark gives NULL; at the bound -inf."""
    return lambda x: F.when(x < low, F.lit(float("nan"))).when(x == low, F.lit(float("-inf"))).otherwise(f(F.when(x > low, x).when(F.isnan(x), x)))


#: Functions that keep zeros, by their NumPy names; each maps a double column.
UFUNCS: dict[str, Callable[[Column], Column]] = {
    "sin": F.sin, "tan": F.tan, "arcsin": F.asin, "arctan": F.atan, "sinh": F.sinh, "tanh": F.tanh,
    "arcsinh": F.asinh, "arctanh": F.atanh, "rint": F.rint, "sign": F.signum, "expm1": F.expm1,
    "log1p": _domain(F.log1p, -1.0), "deg2rad": F.radians, "rad2deg": F.degrees,
    "floor": _whole(F.floor), "ceil": _whole(F.ceil),
    "trunc": lambda x: F.when(x < 0, _whole(F.ceil)(x)).otherwise(_whole(F.floor)(x)), "sqrt": F.sqrt,
}
