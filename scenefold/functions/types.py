"""Return types of the vectorised UDFs, as objects so that modules load without a session."""

from pyspark.sql import types as T

LONG = T.LongType()
DOUBLE = T.DoubleType()
BINARY = T.BinaryType()
DOUBLES = T.ArrayType(T.DoubleType())


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SIM3 = struct(scale=DOUBLE, rotation=DOUBLES, translation=DOUBLES)
VECTOR = struct(nx=DOUBLE, ny=DOUBLE, nz=DOUBLE)
INVERSES = struct(kinv=DOUBLES, c2w=DOUBLES)
