"""Schemas of the engine's relations."""

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampType


def _struct(*fields):
    return StructType([StructField(name, kind, nullable) for name, kind, nullable in fields])


CHUNK = _struct(("path", StringType(), False), ("start_line", IntegerType(), False), ("end_line", IntegerType(), False), ("symbol", StringType(), False), ("content", StringType(), False))
STORED_CHUNK = StructType([*CHUNK.fields, StructField("search_text", StringType(), False), StructField("vector", ArrayType(FloatType(), False), False)])
NODE = _struct(
    ("id", StringType(), False), ("kind", StringType(), False), ("file_path", StringType(), False), ("start_line", IntegerType(), False), ("end_line", IntegerType(), False), ("name", StringType(), False), ("qualified_name", StringType(), False)
)
EDGE = _struct(("source", StringType(), False), ("target", StringType(), False), ("kind", StringType(), False))
FILE_STATE = _struct(("path", StringType(), False), ("sha256", StringType(), False))
LOOKUP = _struct(("path", StringType(), False), ("module", StringType(), False))
PATH = _struct(("path", StringType(), False))
FILE_EVENT = _struct(("ts", TimestampType(), False), ("seq", LongType(), False), ("event_type", StringType(), False), ("path", StringType(), False), ("dest_path", StringType(), True), ("is_directory", BooleanType(), False))
SKELETON_ROW = _struct(
    ("path", StringType(), False), ("ord", IntegerType(), False), ("depth", IntegerType(), False), ("kind", StringType(), False), ("qualified_name", StringType(), False),
    ("start_line", IntegerType(), False), ("end_line", IntegerType(), False), ("signature", StringType(), False), ("docstring", StringType(), True),
)
HIT = _struct(
    ("path", StringType(), False), ("start_line", IntegerType(), False), ("end_line", IntegerType(), False), ("symbol", StringType(), False), ("content", StringType(), False),
    ("score", DoubleType(), False), ("truncated", BooleanType(), False), ("relevance", StringType(), False), ("search_mode", StringType(), False),
)
NODE_KINDS = ("module", "class", "function")
EDGE_KINDS = ("imports", "defines", "calls", "inherits")
