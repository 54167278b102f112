"""The entity envelope and schema conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame
import pyspark.sql.functions as F
import pyspark.sql.types as T

_STRINGS, _LONGS = T.ArrayType(T.StringType()), T.ArrayType(T.LongType())
ENVELOPE = T.StructType(
    [
        T.StructField(n, t)
        for n, t in (
            ("er_id", T.LongType()),
            ("er_uuid", T.StringType()),
            ("name", T.StringType()),
            ("description", T.StringType()),
            ("entity_type", T.StringType()),
            ("attributes", T.MapType(T.StringType(), T.StringType())),
            ("source_ids", _LONGS),
            ("source_uuids", _STRINGS),
            ("match_skip", T.BooleanType()),
            ("match_skip_reason", T.StringType()),
            ("match_skip_history", T.ArrayType(T.IntegerType())),
        )
    ]
)
DECISIONS = T.StructType([T.StructField(n, t, False) for n, t in (("entity_a_id", T.LongType()), ("entity_b_id", T.LongType()), ("is_match", T.BooleanType()), ("confidence", T.DoubleType()), ("reasoning", T.StringType()))])
BLOCK_COLUMNS = ("block_key", "block_key_type", "entities", "block_size")


def widen(kind: T.DataType) -> T.DataType:
    """INT to BIGINT and FLOAT to DOUBLE at any depth, nullability and field order as they were."""
    match kind:
        case T.IntegerType() | T.ShortType() | T.ByteType():
            return T.LongType()
        case T.FloatType():
            return T.DoubleType()
        case T.ArrayType():
            return T.ArrayType(widen(kind.elementType), kind.containsNull)
        case T.MapType():
            return T.MapType(widen(kind.keyType), widen(kind.valueType), kind.valueContainsNull)
        case T.StructType():
            return T.StructType([T.StructField(f.name, widen(f.dataType), f.nullable, f.metadata) for f in kind.fields])
    return kind


def widen_ints(df: DataFrame) -> DataFrame:
    return df.to(widen(df.schema))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order: cast, NULL where the table lacks one; others are dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def require_columns(df: DataFrame, columns: tuple[str, ...] = BLOCK_COLUMNS) -> DataFrame:
    """The table itself; raises if a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def decisions(df: DataFrame) -> DataFrame:
    """Match decisions in their schema; a confidence outside 0..1, or a NULL, fails the job that reads it."""
    ok = F.col("confidence").between(0.0, 1.0) & F.col("entity_a_id").isNotNull() & F.col("entity_b_id").isNotNull() & F.col("is_match").isNotNull() & F.col("reasoning").isNotNull()
    checked = conform(df, DECISIONS).withColumn("is_match", F.when(F.assert_true(F.coalesce(ok, F.lit(False)), "bad match decision").isNull(), F.col("is_match")))
    return checked


_FROM_PYTHON = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), dict: T.MapType(T.StringType(), T.StringType())}


def spark_type(hint: object) -> tuple[T.DataType, bool]:
    """Spark type of a Python annotation and whether it is optional."""
    import types
    import typing

    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin in (typing.Union, types.UnionType) and types.NoneType in args:
        return spark_type([x for x in args if x is not types.NoneType][0])[0], True
    if origin is list:
        return T.ArrayType(spark_type(args[0])[0] if args else T.StringType()), False
    if origin is dict:
        return T.MapType(*[spark_type(a)[0] for a in args]), False
    return _FROM_PYTHON.get(hint, T.StringType()), False


def schema_of(record: type) -> T.StructType:
    """Spark schema of an annotated class; optional fields are nullable."""
    import typing

    return T.StructType([T.StructField(n, *spark_type(h)) for n, h in typing.get_type_hints(record).items()])


def python_type(kind: T.DataType) -> str:
    """How a matcher is told a column's type."""
    match kind:
        case T.ArrayType():
            return f"list[{python_type(kind.elementType)}]"
        case T.LongType() | T.IntegerType() | T.ShortType() | T.ByteType():
            return "int"
        case T.DoubleType() | T.FloatType():
            return "float"
        case T.BooleanType():
            return "bool"
    return "str"


def described(schema: T.StructType, types: dict[str, str] | None = None) -> list[dict[str, object]]:
    """Domain fields (the envelope's own are left out) with type, whether required, and field type."""
    own = {f.name for f in ENVELOPE.fields}
    return [{"field": f.name, "type": python_type(f.dataType) + (" | None" if f.nullable else ""), "required": not f.nullable, "description": (types or {}).get(f.name, "")} for f in schema.fields if f.name not in own]
