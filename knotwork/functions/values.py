"""Value types, edge identifiers, and comparison rules.

A *class* of a Spark type decides how its values compare: integers compare as ``bigint``, any other
numeric mix as ``double``, all else only within its class, so that the string "2" never equals 2.
"""

from __future__ import annotations

import base64
import struct
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Value type names of the schema and what holds them.
TYPES: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "uint16": T.IntegerType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "string": T.StringType(),
    "uuid": T.BinaryType(),
    "bytes": T.BinaryType(),
    "float_vector": T.ArrayType(T.FloatType()),
}
MAX_RANK = 65_535

#: A value of any class as one struct: tag is v, e, i, f, b, s, x (bytes) or n (null).
ANY = T.StructType(
    [T.StructField("tag", T.StringType()), T.StructField("l", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("s", T.StringType())]
)


def class_of(kind: T.DataType) -> str:
    """int, float, bool, string, bytes, vector or any."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(kind, T.BinaryType):
        return "bytes"
    if isinstance(kind, T.ArrayType):
        return "vector"
    return "any"


def class_of_literal(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (bytes, bytearray, uuid.UUID)):
        return "bytes"
    return "other"


def literal(value: object) -> Column:
    if isinstance(value, uuid.UUID):
        return F.lit(bytearray(value.bytes))
    if isinstance(value, (bytes, bytearray)):
        return F.lit(bytearray(value))
    if isinstance(value, int) and not isinstance(value, bool):
        return F.lit(value).cast("bigint")
    return F.lit(value)


def type_of_literal(value: object) -> str:
    """The schema type a value is registered under when its key is first written."""
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int32" if -(1 << 31) <= value < 1 << 31 else "int64"
    if isinstance(value, float):
        return "float64"
    if isinstance(value, str):
        return "string"
    if isinstance(value, uuid.UUID):
        return "uuid"
    if isinstance(value, (bytes, bytearray)):
        return "bytes"
    if isinstance(value, (list, tuple)) and all(isinstance(x, (int, float)) for x in value):
        return "float_vector"
    raise TypeError(f"{value!r} is no property value")


def to_any(value: Column, kind: T.DataType) -> Column:
    """A scalar column as a tagged struct; null stays null."""
    none = {"l": F.lit(None).cast("bigint"), "d": F.lit(None).cast("double"), "s": F.lit(None).cast("string")}
    c = class_of(kind)
    if c == "any":
        return value
    tag, field, col = {
        "int": ("i", "l", value.cast("bigint")),
        "bool": ("b", "l", value.cast("int").cast("bigint")),
        "float": ("f", "d", value.cast("double")),
        "string": ("s", "s", value),
        "bytes": ("x", "s", F.hex(value)),
        "vector": ("s", "s", value.cast("string")),
    }[c]
    parts = none | {field: col}
    return F.when(value.isNotNull(), F.struct(F.lit(tag).alias("tag"), *[parts[k].alias(k) for k in ("l", "d", "s")]))


def edge_id(src: Column, label_id: Column, dst: Column, rank: Column) -> Column:
    """30 characters of URL-safe Base64 without padding over big-endian src i64, label i32, dst i64, rank u16."""
    raw = F.concat(F.lpad(F.hex(src), 16, "0"), F.lpad(F.hex(label_id.cast("bigint")), 8, "0"), F.lpad(F.hex(dst), 16, "0"), F.lpad(F.hex(rank.cast("bigint")), 4, "0"))
    return F.translate(F.rtrim(F.base64(F.unhex(raw)), F.lit("=")), "+/", "-_")


def encode_edge_id(src: int, label_id: int, dst: int, rank: int) -> str:
    return base64.urlsafe_b64encode(struct.pack(">qiqH", src, label_id, dst, rank)).decode().rstrip("=")


def decode_edge_id(text: str) -> tuple[int, int, int, int] | None:
    """(src, label id, dst, rank), or None if the text is no edge identifier."""
    if not isinstance(text, str) or len(text) != 30:
        return None
    try:
        return struct.unpack(">qiqH", base64.urlsafe_b64decode(text + "=="))
    except (ValueError, struct.error):
        return None
