"""Extended JSON of any schema: documents whose ids, times and numbers may be wrapped in objects.

The asked schema is rewritten so that every leaf is read as its JSON text, and
an expression of the same shape unwraps the texts: ``{"$date": …}`` with an ISO
time, a number of milliseconds or ``{"$numberLong": …}``, ``{"$oid": …}``, and
``{"$numberInt" | "$numberLong" | "$numberDouble" | "$numberDecimal": …}``.
Plain values are taken as they are, and a value that does not fit its type is
null, so one file may mix all forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of the wrappers. Fixed values.
NUMBERS = ("$numberInt", "$numberLong", "$numberDouble", "$numberDecimal")
OTHERS = ("$oid", "$uuid", "$symbol")


def as_texts(kind: T.DataType) -> T.DataType:
    """The schema with every leaf as text."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, as_texts(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(as_texts(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(T.StringType(), as_texts(kind.valueType))
    return T.StringType()


def _inside(value: Column, *names: str) -> Column:
    return F.get_json_object(value, "$" + "".join(f"['{n}']" for n in names))


def _leaf(value: Column, kind: T.DataType) -> Column:
    wrapped = value.rlike(r'^\{\s*"\$')
    number = F.when(wrapped, F.coalesce(*[_inside(value, n) for n in NUMBERS])).otherwise(value)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        date = _inside(value, "$date")
        millis = F.coalesce(_inside(value, "$date", "$numberLong"), F.when(date.rlike(r"^-?[0-9]+$"), date))
        at = F.timestamp_millis(millis.try_cast("long"))
        return F.coalesce(F.when(wrapped, at), F.when(wrapped, date).otherwise(value).try_cast("timestamp")).try_cast(kind)
    if isinstance(kind, T.StringType):
        return F.when(wrapped, F.coalesce(*[_inside(value, n) for n in (*OTHERS, *NUMBERS, "$date")], value)).otherwise(value)
    return number.try_cast(kind)


def unwrapped(value: Column, kind: T.DataType) -> Column:
    """A column read by ``as_texts(kind)`` as a value of ``kind``."""
    if isinstance(kind, T.StructType):
        made = F.struct(*[unwrapped(value[f.name], f.dataType).alias(f.name) for f in kind])
        return F.when(value.isNotNull(), made)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: unwrapped(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: unwrapped(v, kind.valueType))
    return _leaf(value, kind)


def _schema(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def parse_ejson(payload: Column, schema: str | T.StructType) -> Column:
    """A document, as text, as a struct of the schema."""
    kind = _schema(schema)
    return unwrapped(F.from_json(payload, as_texts(kind)), kind)


def read_ejson(spark: SparkSession, path: str, schema: str | T.StructType, *, lines: bool = False) -> DataFrame:
    """Documents of files that hold one array (or one document) each, or one document per line under ``lines``, which lets
    a file be split among tasks."""
    kind = _schema(schema)
    raw = spark.read.schema(as_texts(kind)).option("multiLine", not lines).json(path)
    return raw.select(*[unwrapped(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in kind])
