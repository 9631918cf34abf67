"""Schemas shared by the operators.

``lineno``, ``seq`` and every count are bigint: one artifact may hold more than
2^31 lines. A fact's id is only unique inside its artifact, so the key is
``(family, artifact, id)`` everywhere.
"""

from pyspark.sql import types as T

ARTIFACTS = T.StructType([
    T.StructField("family", T.StringType()),
    T.StructField("artifact", T.StringType()),
    T.StructField("text", T.StringType()),
])

LINES = T.StructType([
    T.StructField("family", T.StringType()),
    T.StructField("artifact", T.StringType()),
    T.StructField("lineno", T.LongType()),
    T.StructField("line", T.StringType()),
])

FACTS = T.StructType([
    T.StructField("family", T.StringType()),
    T.StructField("artifact", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("excerpt", T.StringType()),
    T.StructField("data", T.MapType(T.StringType(), T.StringType())),
])

SUGGESTION = T.StructType([
    T.StructField("summary", T.StringType()),
    T.StructField("command", T.StringType()),
    T.StructField("applicability", T.StringType()),
])

CONDITION = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("field", T.StringType()),
    T.StructField("lo", T.DoubleType()),
    T.StructField("hi", T.DoubleType()),
    T.StructField("ok", T.BooleanType()),
])

SEGMENT = T.StructType([
    T.StructField("lit", T.StringType()),
    T.StructField("key", T.StringType()),
])

RULES = T.StructType([
    T.StructField("family", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("ord", T.IntegerType()),
    T.StructField("requires", T.ArrayType(T.StringType())),
    T.StructField("absent", T.ArrayType(T.StringType())),
    T.StructField("optional", T.ArrayType(T.StringType())),
    T.StructField("conditions", T.ArrayType(CONDITION)),
    T.StructField("segments", T.ArrayType(SEGMENT)),
    T.StructField("cause", T.StringType()),
    T.StructField("suggestions", T.ArrayType(SUGGESTION)),
    T.StructField("refs", T.ArrayType(T.StringType())),
])

PROPOSALS = T.StructType([
    T.StructField("family", T.StringType()),
    T.StructField("artifact", T.StringType()),
    T.StructField("proposal", T.LongType()),
    T.StructField("message", T.StringType()),
    T.StructField("root_cause", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("evidence", T.ArrayType(T.StringType())),
    T.StructField("suggestions", T.ArrayType(SUGGESTION)),
    T.StructField("insufficient_info", T.BooleanType()),
])

KEY = ["family", "artifact"]
