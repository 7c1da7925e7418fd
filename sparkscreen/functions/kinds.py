"""Spark types from short names, without a running session."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {
    "string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "binary": T.BinaryType(), "array<string>": T.ArrayType(T.StringType()), "map<string,double>": T.MapType(T.StringType(), T.DoubleType()),
}


def kind(name: str) -> T.DataType:
    return _KINDS[name]


def struct(fields: str) -> T.StructType:
    """``name kind, name kind``."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (f.split() for f in fields.split(", "))])
