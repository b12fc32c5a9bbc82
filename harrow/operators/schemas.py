"""Drift of nested schemas, and additive upgrade on read."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def _differences(have: DataType, want: DataType, path: str) -> Iterator[tuple[str, str, str | None, str | None]]:
    if isinstance(have, StructType) and isinstance(want, StructType):
        own, expected = ({f.name: f.dataType for f in s.fields} for s in (have, want))
        for name in sorted(own.keys() | expected.keys()):
            at = f"{path}.{name}" if path else name
            if name not in expected:
                yield at, "added", own[name].simpleString(), None
            elif name not in own:
                yield at, "lost", None, expected[name].simpleString()
            else:
                yield from _differences(own[name], expected[name], at)
    elif isinstance(have, ArrayType) and isinstance(want, ArrayType):
        yield from _differences(have.elementType, want.elementType, f"{path}[]")
    elif isinstance(have, MapType) and isinstance(want, MapType):
        yield from _differences(have.keyType, want.keyType, f"{path}{{key}}")
        yield from _differences(have.valueType, want.valueType, f"{path}{{value}}")
    elif have != want:
        yield path, "retyped", have.simpleString(), want.simpleString()


def drift(spark: SparkSession, have: StructType, want: StructType) -> DataFrame:
    """path, change, have, want: fields at any depth that were added, lost or retyped against the wanted schema; whether they may be null is no matter."""
    return spark.createDataFrame(list(_differences(have, want, "")), "path string, change string, have string, want string")


def _upgraded(value: Column, have: DataType, want: DataType) -> Column:
    if isinstance(have, StructType) and isinstance(want, StructType):
        own = {f.name: f.dataType for f in have.fields}
        fields = [(_upgraded(value[f.name], own[f.name], f.dataType) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if not list(_differences(have, want, "")):
        return value
    if isinstance(have, ArrayType) and isinstance(want, ArrayType):
        return F.transform(value, lambda x: _upgraded(x, have.elementType, want.elementType))
    if isinstance(have, MapType) and isinstance(want, MapType) and have.keyType == want.keyType:
        return F.transform_values(value, lambda _, x: _upgraded(x, have.valueType, want.valueType))
    raise ValueError(f"{have.simpleString()} can't be read as {want.simpleString()}")


def upgraded(rows: DataFrame, want: StructType) -> DataFrame:
    """The rows in the wanted schema: lost fields are null at every depth, added ones go. A retyped field is an error, since that is no additive change."""
    own = {f.name: f.dataType for f in rows.schema.fields}
    return rows.select(*[(_upgraded(F.col(f"`{f.name}`"), own[f.name], f.dataType) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields])
