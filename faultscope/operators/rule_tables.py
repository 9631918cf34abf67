"""Rule tables from outside: hand-edited data made safe."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultscope.functions.numbers import finite_number
from faultscope.functions.text import strip_unicode
from faultscope.schema import CONDITION, SUGGESTION

_STRINGS = "array<string>"


def _get(path: str, kind: str = "variant", of: str | Column = "rule") -> Column:
    return F.try_variant_get(of, f"$.{path}", kind)


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _names(path: str) -> Column:
    """A bare string is one name, never its characters; other types are no names."""
    value = _get(path)
    return F.array_distinct(F.when(_is(value, "STRING"), F.array(value.cast("string")))
                            .when(_is(value, "ARRAY"), F.coalesce(F.try_variant_get(value, "$", _STRINGS), F.array().cast(_STRINGS)))
                            .otherwise(F.array().cast(_STRINGS)))


def _list(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _condition(c: Column) -> Column:
    """A condition that cannot be read is kept as one that is never met."""
    def bound(name: str) -> tuple[Column, Column]:
        text = F.try_variant_get(c, f"$.{name}", "string")
        number = F.when(text.isin("true", "false"), text.try_cast("boolean").cast("double")).otherwise(finite_number(text))
        return number, text.isNull() | number.isNotNull()
    (lo, lo_ok), (hi, hi_ok) = bound("min"), bound("max")
    kind, field = F.try_variant_get(c, "$.kind", "string"), F.try_variant_get(c, "$.field", "string")
    ok = kind.isNotNull() & field.isNotNull() & lo_ok & hi_ok
    return F.struct(kind.alias("kind"), field.alias("field"), lo.alias("lo"), hi.alias("hi"),
                    F.coalesce(_is(c, "OBJECT") & ok, F.lit(False)).alias("ok"))


def _conditions() -> Column:
    value = _get("conditions")
    missing = value.isNull() | _is(value, "VOID")
    one_or_more = F.coalesce(_list(value), F.when(~missing, F.array(value)))
    return F.coalesce(F.transform(one_or_more, _condition), F.array().cast(f"array<{CONDITION.simpleString()}>"))


def _suggestions() -> Column:
    def text(s: Column, name: str, default: str) -> Column:
        return F.coalesce(F.try_variant_get(s, f"$.{name}", "string"), F.lit(default)).alias(name)
    usable = F.filter(_list(_get("suggestions")), lambda s: _is(s, "OBJECT"))
    return F.coalesce(F.transform(usable, lambda s: F.struct(
        text(s, "summary", ""), text(s, "command", ""), text(s, "applicability", "maybe-incorrect"))),
        F.array().cast(f"array<{SUGGESTION.simpleString()}>"))


def message_segments(message: Column) -> Column:
    """A message cut at its placeholders, so that braces inside a value are never taken
    for one. A message with an open brace stays one literal."""
    rest = F.regexp_replace(message, r"\{\{|\}\}|\{\w+\}", "")

    def piece(t: Column) -> Column:
        key = F.regexp_extract(t, r"^\{(\w+)\}$", 1)
        return F.struct(F.when(key == "", F.replace(F.replace(t, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))).alias("lit"),
                        F.nullif(key, F.lit("")).alias("key"))
    return F.when(rest.rlike(r"[{}]"), F.array(F.struct(message.alias("lit"), F.lit(None).cast("string").alias("key")))).otherwise(
        F.transform(F.regexp_extract_all(message, F.lit(r"\{\{|\}\}|\{\w+\}|[^{}]+"), F.lit(0)), piece))


def normalize_rules(raw: DataFrame) -> DataFrame:
    """The rules schema from ``(family, ord, rule variant)``.

    Entries that are no object, and family names that could be a path, drop out one
    by one. Everything else fails closed: a rule that cannot be read stays silent
    and the others go on.
    """
    family = F.col("family")
    usable = family.rlike(r"^[A-Za-z0-9_.-]+$") & ~family.isin(".", "..")

    def text(path: str, default: str) -> Column:
        return F.coalesce(_get(path, "string"), F.lit(default))
    return raw.where(usable & _is(F.col("rule"), "OBJECT")).select(
        "family", text("id", "").alias("id"), text("severity", "error").alias("severity"), F.col("ord").cast("int").alias("ord"),
        _names("requires").alias("requires"), _names("absent").alias("absent"), _names("optional").alias("optional"),
        _conditions().alias("conditions"), message_segments(text("message", "")).alias("segments"),
        strip_unicode(text("cause", "")).alias("cause"), _suggestions().alias("suggestions"), _names("refs").alias("refs"))
