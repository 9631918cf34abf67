"""Pieces of Spark SQL text.

Signatures, sentences and secret shapes are data. Turned into one SQL expression
they cost one call to the JVM when a plan is built, where the same tree made
function by function costs thousands.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def char(code: int) -> str:
    return f"'\\u{code:04x}'"


def regex(pattern: str) -> str:
    """A pattern as a raw literal, which cannot hold a quote itself."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def let_sql(value: Column, name: str, body: str) -> Column:
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return F.element_at(F.call_function("transform", F.array(value), F.expr(f"{name} -> {body}")), 1)


def within_let(value: str, name: str, body: str) -> str:
    """The same inside a SQL text."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"
