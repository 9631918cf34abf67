"""Lines to raw facts: the first matching signature of the line's family."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultscope.families import FAMILIES
from faultscope.families.base import Family
from faultscope.functions.numbers import div
from faultscope.functions.sql import literal, within_let
from faultscope.functions.text import strip_unicode
from faultscope.operators.ordered import SLICE


def observe(families: list[Family]) -> Column:
    """array<struct<ordinal, kind, data>> of the first signature that matches ``line``,
    null when none does. The line is evaluated once, whatever it is made of."""
    branches = []
    for f in families:
        first = " ".join(f"when {s.matches('t')} then {s.observations('t')}" for s in f.signatures)
        branches.append(f"when family = {literal(f.name)} then case {first} end")
    return F.expr(within_let("line", "t", f"case {' '.join(branches)} end"))


def match_signatures(lines: DataFrame, families: list[Family] | None = None, slice_lines: int = SLICE) -> DataFrame:
    """Raw facts ``(family, artifact, slice, lineno, ordinal, kind, excerpt, data)``.

    A narrow step: one pass over the lines, no shuffle, no Python. The generator
    yields nothing for a line without a match, so every line is looked at once and
    a payload is taken out only of lines that matched.
    """
    families = families or list(FAMILIES.values())
    lineno = F.col("lineno").cast("bigint")
    return (lines.where(F.col("family").isin([f.name for f in families]))
            .select("family", "artifact", lineno.alias("lineno"), "line", F.inline(observe(families)))
            .select("family", "artifact", div(F.col("lineno") - 1, slice_lines).alias("slice"), "lineno", "ordinal", "kind",
                    strip_unicode(F.col("line")).alias("excerpt"), "data"))
