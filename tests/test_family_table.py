"""Families from a table: lint, compiler, and the same facts as in code."""

import json

import pytest

from faultscope.families.table import compile_families, family_lint, family_named, places_of, read_signatures
from faultscope.operators.signatures import match_signatures
from faultscope.workload.signatures import TABLE


def signature(**more):
    return {"family": "f", "ord": 1, "kind": "k", "template": "value is <int>", "fields": [{"key": "n", "place": 1, "as": "count", "trim": None}], "summary": "{n}", "context": None, **more}


@pytest.mark.parametrize("change, problem", [
    ({}, None), ({"template": "<int>"}, "no literal to look for"), ({"template": "is <integer>", "fields": []}, "unknown place"),
    ({"template": "value <rest> and <int>"}, "text behind the end of the line"), ({"fields": [{"key": "n", "place": 2, "as": None}]}, "field without a place"),
    ({"fields": [{"key": "n", "place": 1, "as": "sql"}]}, "unknown kind of value"), ({"summary": None}, "no sentence"), ({"kind": None, "fields": []}, "no family or kind")])
def test_lint(change, problem):
    found = [p for _, _, p in family_lint([signature(**change)])]
    assert (problem in found) if problem else found == []


def test_signatures_out_of_reach_are_found():
    rows = [signature(), signature(ord=2, template="the value is <int> of <int>"), signature(ord=3, template="value was <int>")]
    assert family_lint(rows) == [("f", 2, "out of reach")]
    assert family_lint([signature(), signature()])[-1] == ("", 0, "two rows with one place")
    assert places_of("a <gap><bits> <int><end>") == ["bits", "bits", "int"]


def test_a_table_compiles_to_a_family(spark, tmp_path):
    rows = [signature(), signature(ord=2, kind="list", template="names: [<list>]", summary="s", fields=[{"key": "a", "place": 1, "as": "names"}, {"key": "n", "place": 1, "as": "size"}, {"key": "x", "place": 1, "as": "first"}]),
            signature(ord=3, kind="trim", template="word of <last>", summary="t", fields=[{"key": "w", "place": 1, "as": "trimmed", "trim": "().'"}])]
    (tmp_path / "t.json").write_text("\n".join(map(json.dumps, rows)) + "\n[1]\n{no\n")
    families = compile_families(read_signatures(spark, str(tmp_path)))
    lines = spark.createDataFrame([("f", "a", n, t) for n, t in enumerate(["the value is 0042!", "names: ['p', \"it's, q\"]", "word of ('x.y')", "nothing"], 1)], "family string, artifact string, lineno long, line string")
    got = {r.lineno: (r.kind, r.data) for r in match_signatures(lines, [family_named(families, "f")]).collect()}
    assert got == {1: ("k", {"n": "42"}), 2: ("list", {"a": '["p","it\'s, q"]', "n": "2", "x": "p"}), 3: ("trim", {"w": "x.y"})}
    with pytest.raises(ValueError, match="there are: f"):
        family_named(families, "g")
    from pyspark.sql import functions as F
    bad = read_signatures(spark, str(tmp_path)).withColumn("template", F.lit("<int>"))
    with pytest.raises(ValueError, match="literal"):
        compile_families(bad)


def test_the_rows_of_the_query_pass_the_lint():
    full = [{**signature(), "context": None, **r, "fields": [{"trim": None, **f} for f in r["fields"]]} for r in TABLE]
    assert family_lint(full) == []
