"""Serdes as column expressions: decoding and encoding stay in the JVM wherever Spark has the codec."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Serde(Protocol):
    """Anything with these two; users bring their own."""

    def decode(self, raw: Column) -> Column: ...

    def encode(self, value: Column) -> Column: ...


class BytesSerde:
    """Bytes as they are."""

    def decode(self, raw: Column) -> Column:
        return raw.cast("binary")

    def encode(self, value: Column) -> Column:
        return value.cast("binary")


class JsonSerde:
    """JSON of a Spark type. Malformed input is an error, JSON null is null."""

    def __init__(self, schema: T.DataType | str):
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.nested = isinstance(self.schema, T.StructType | T.ArrayType | T.MapType)

    def decode(self, raw: Column) -> Column:
        text = raw.cast("string")
        if self.nested:
            return F.from_json(text, self.schema, {"mode": "FAILFAST"})
        wrapped = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), T.StructType([T.StructField("v", self.schema)]), {"mode": "FAILFAST"})
        return wrapped["v"]

    def encode(self, value: Column) -> Column:
        if self.nested:
            return F.when(value.isNull(), F.lit("null")).otherwise(F.to_json(value)).cast("binary")
        wrapped = F.to_json(F.struct(value.alias("v")))
        return F.when(value.isNull(), F.lit("null")).otherwise(F.regexp_extract(wrapped, r"(?s)^\{\"v\":(.*)\}$", 1)).cast("binary")


class ProtoSerde:
    """Messages of a compiled protobuf class, through its own parser in Arrow batches; needs the protobuf package on the executors.

    message is a class whose fields are decoded into a struct of the schema given, by name.
    """

    def __init__(self, message: type, schema: T.StructType | str):
        if not hasattr(message, "SerializeToString") or not hasattr(message, "ParseFromString"):
            raise TypeError("a protobuf message class is needed")
        self.message = message
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def decode(self, raw: Column) -> Column:
        message, names = self.message, self.schema.fieldNames()

        @F.pandas_udf(self.schema)
        def parse(raw: pd.Series) -> pd.DataFrame:
            found = [message.FromString(bytes(b)) for b in raw]
            return pd.DataFrame({n: [getattr(m, n) for m in found] for n in names})

        return parse(raw)

    def encode(self, value: Column) -> Column:
        message = self.message

        @F.pandas_udf(T.BinaryType())
        def put(value: pd.DataFrame) -> pd.Series:
            return pd.Series([message(**{k: v for k, v in row.items() if v is not None}).SerializeToString() for row in value.to_dict("records")])

        return put(value)
