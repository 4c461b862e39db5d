"""Small parameter tables as part of the plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_sql(v) for v in value) + ")"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def setting_rows(schema: str, values: Sequence[Sequence]) -> Column:
    """The same settings as an array of structs, to explode onto every row of another table."""
    fields = T.StructType.fromDDL(schema).fields
    return F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, fields)]) for r in values])


def rows(spark: SparkSession, schema: str, values: Sequence[Sequence]) -> DataFrame:
    """A literal table; ``schema`` is DDL.  Meant for settings, not for data.

    A local relation has a known size, so Spark broadcasts it without a hint.
    """
    fields = T.StructType.fromDDL(schema).fields
    cols = ", ".join(f"CAST(col{i + 1} AS {f.dataType.simpleString()}) AS {f.name}" for i, f in enumerate(fields))
    body = ", ".join("(" + ", ".join(_sql(v) for v in r) + ")" for r in values)
    return spark.sql(f"SELECT {cols} FROM VALUES {body}")
