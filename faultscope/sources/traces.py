"""Profiling traces."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultscope.sources.artifacts import read_lines
from faultscope.sources.json_blocks import list_elements

# What may stand around the one event of a line: the opening of the list, or of the
# object that holds it, and what closes them.
_BEFORE = r'^\s*(?:\{\s*"traceEvents"\s*:\s*)?[\[,]?\s*'
_AFTER = r"(?:(?<=\})|^)\s*,?\s*(?:\]\s*\}?)?\s*$"


# Follows the document while it is parsed: the parser stops at the end of a value, so
# whatever else a text holds must push this away from its place.
_LAST = "faultscope: end of document"


def read_trace(artifacts: DataFrame) -> DataFrame:
    """``(artifact, idx, ev variant)``: a JSON list of events, or an object that
    holds one under ``traceEvents``. Anything else, also a text that goes on after its
    document, has no events and is no error. A document must fit a row;
    ``read_trace_documents`` reads files of any size."""
    both = F.try_parse_json(F.concat(F.lit("["), "text", F.lit(f',"{_LAST}"]')))
    alone = F.try_variant_get(both, "$[1]", "string") == _LAST
    doc = F.when(alone, F.try_variant_get(both, "$[0]", "variant"))
    events = F.coalesce(F.try_variant_get(doc, "$.traceEvents", "array<variant>"),
                        F.try_variant_get(doc, "$", "array<variant>"))
    return (artifacts.select("artifact", events.alias("events"))
            .select("artifact", F.posexplode("events").alias("idx", "ev"))
            .select("artifact", F.col("idx").cast("bigint").alias("idx"), "ev"))


def read_trace_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(artifact, idx, ev variant, unread)`` of trace files that hold one event per line.

    Files are read block by block, so a trace may be of any size; ``idx`` is the line
    number. A line that is no event is a row without ``ev`` whose text is ``unread``:
    nothing is passed over in silence. ``read_trace`` is for documents in any layout that
    fit a row.
    """
    body = F.regexp_replace(F.regexp_replace("line", _BEFORE, ""), _AFTER, "")
    lines = read_lines(spark, paths, "trace").select("artifact", F.col("lineno").alias("idx"), "line", body.alias("body")).where("body <> ''")
    event = F.try_parse_json("body")
    return lines.select("artifact", "idx", F.when(F.schema_of_variant(event).startswith("OBJECT"), event).alias("ev"), "line").select(
        "artifact", "idx", "ev", F.when(F.col("ev").isNull(), F.col("line")).alias("unread"))


def read_trace_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(artifact, idx, ev variant)``, the rows of ``read_trace`` from files of any size and
    layout: one line, pretty-printed, the list inside an object. Many tasks read one file."""
    return list_elements(spark, paths, "traceEvents").select("artifact", "idx", F.parse_json("text").alias("ev"))


def _text(path: str) -> Column:
    return F.try_variant_get("ev", path, "string")


def type_events(trace: DataFrame) -> DataFrame:
    """``(artifact, idx, cat, name, dur, dur_text, op, provider)``: the fields that
    matter, typed. A duration that is no number (boolean, text, missing) is null;
    a fraction is cut. Empty or missing arguments stay null."""
    kind = F.schema_of_variant(F.try_variant_get("ev", "$.dur", "variant"))
    number = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get("ev", "$.dur", "double"))
    return trace.select(
        "artifact", "idx", _text("$.cat").alias("cat"), _text("$.name").alias("name"),
        number.try_cast("bigint").alias("dur"), F.when(number.isNotNull(), _text("$.dur")).alias("dur_text"),
        # The sign is judged before the fraction is cut: -0.5 is negative.
        (number >= 0).alias("dur_ok"),
        F.nullif(_text("$.args.op_name"), F.lit("")).alias("op"),
        F.nullif(_text("$.args.provider"), F.lit("")).alias("provider"))
