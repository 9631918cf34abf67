"""Families from a table: signatures as rows instead of code.

A row is one JSON object: ``family``, ``ord``, ``kind``, ``template`` (see ``base.line``), ``fields``
(``key``, ``place`` and how to take it, ``as``) and, once per kind, ``summary``. A row with
``context`` (``key``, ``opens``, ``takes``, ``required``) gives the family its block context.
Templates have typed places only, each bounded, so no table can bring a pattern of its own
or SQL; rows that break a rule are reported by ``family_lint`` and refused by ``compile_families``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultscope.families.base import _PLACE, Context, Family, Field, line, LISTED
from faultscope.functions.numbers import whole_number_sql
from faultscope.functions.sql import literal

SIGNATURE = T.StructType([
    T.StructField("family", T.StringType()), T.StructField("ord", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("template", T.StringType()),
    T.StructField("fields", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("as", T.StringType()), T.StructField("trim", T.StringType())]))),
    T.StructField("summary", T.StringType()),
    T.StructField("context", T.StructType([T.StructField("key", T.StringType()), T.StructField("opens", T.ArrayType(T.StringType())),
                                           T.StructField("takes", T.ArrayType(T.StringType())), T.StructField("required", T.BooleanType())])),
])

#: Places without a value, and those with two.
_ROOM, _TWO = ("blank", "gap", "eq", "end"), ("bits",)


def _names(place: int) -> str:
    return LISTED.replace("{1}", "{%d}" % place)


#: How the text of a place becomes a payload value.
_TAKEN = {
    "text": lambda n: n, "trimmed": None, "count": lambda n: whole_number_sql("{%d}" % n), "names": lambda n: f"to_json({_names(n)})",
    "size": lambda n: f"size({_names(n)})", "first": lambda n: f"try_element_at({_names(n)}, 1)",
}
#: A probe shorter than this would let almost every line through to the pattern.
LEAST_PROBE = 4


def read_signatures(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Signature rows from JSON lines; lines that are no such object drop out one by one."""
    return spark.read.schema(SIGNATURE).option("mode", "DROPMALFORMED").json(paths)


def places_of(template: str) -> list[str]:
    """The values of a template in order, by the names of their places."""
    return [p for name in _PLACE.split(template)[1::2] for p in [name] * (0 if name in _ROOM else 2 if name in _TWO else 1)]


def _problems(row: dict) -> list[str]:
    template, out = row["template"] or "", []
    pieces = _PLACE.split(template)
    if not row["family"] or not row["kind"]:
        out.append("no family or kind")
    if max(map(len, pieces[::2])) < LEAST_PROBE:
        out.append("no literal to look for")
    if any("<" in text and ">" in text[text.index("<"):] for text in pieces[::2]):
        out.append("unknown place")
    if any(p in ("rest", "end") for p in pieces[1:-2:2]) or (len(pieces) > 1 and pieces[-2] in ("rest", "end") and pieces[-1]):
        out.append("text behind the end of the line")
    for field in row["fields"] or []:
        if not field["key"] or not 1 <= (field["place"] or 0) <= len(places_of(template)):
            out.append("field without a place")
        if (field["as"] or "text") not in _TAKEN:
            out.append("unknown kind of value")
    return out


def family_lint(rows: list[dict]) -> list[tuple[str, int, str]]:
    """``(family, ord, problem)`` of signature rows. A signature is out of reach when the template of
    an earlier one of its family is part of its own: whatever it would match, the earlier does."""
    out = [(r["family"], r["ord"], p) for r in rows for p in _problems(r)]
    by_family: dict = {}
    for r in sorted(rows, key=lambda r: (r["family"] or "", r["ord"] or 0)):
        earlier = by_family.setdefault(r["family"], [])
        if any(e and e in (r["template"] or "") for e in earlier):
            out.append((r["family"], r["ord"], "out of reach"))
        earlier.append(r["template"])
        if (r["kind"] not in {k["kind"] for k in rows if k["family"] == r["family"] and k["summary"]}):
            out.append((r["family"], r["ord"], "no sentence"))
    if len({(r["family"], r["ord"]) for r in rows}) < len(rows):
        out.append(("", 0, "two rows with one place"))
    return out


def _field(field: dict) -> Field:
    n, taken = field["place"], field["as"] or "text"
    if taken == "trimmed":
        return Field(field["key"], f"btrim({{{n}}}, {literal(field['trim'] or ' ')})")
    value = _TAKEN[taken](n)
    return Field(field["key"], value)


def compile_families(signatures: DataFrame) -> dict[str, Family]:
    """Families of the plan from a signature table; raises ``ValueError`` with what the lint found.

    Signatures become branches of the matching expression, so they pass the driver as the
    built-in ones do; the facts they find never do.
    """
    rows = [r.asDict(recursive=True) for r in signatures.orderBy("family", "ord").toLocalIterator()]
    if problems := family_lint(rows):
        raise ValueError("; ".join(f"{f} {o}: {p}" for f, o, p in problems[:20]))
    out = {}
    for name in dict.fromkeys(r["family"] for r in rows):
        mine = [r for r in rows if r["family"] == name]
        context = next((r["context"] for r in mine if r["context"] and r["context"]["key"]), None)
        out[name] = Family(name, tuple(line(r["kind"], r["template"], *map(_field, r["fields"] or [])) for r in mine), {r["kind"]: r["summary"] for r in mine if r["summary"]},
                           context and Context(context["key"], tuple(context["opens"] or ()), None if context["takes"] is None else tuple(context["takes"]), bool(context["required"])))
    return out


def family_named(families: dict[str, Family], name: str) -> Family:
    """A family by its name; an unknown name is an error that says which there are."""
    if name not in families:
        raise ValueError(f"unknown family {name!r}; there are: {', '.join(sorted(families))}")
    return families[name]
