"""Rules that are read from files stay a table."""

import json

from pyspark.sql import functions as F

from faultscope.operators.rules import artifact_profile, cited_facts, diagnose, gather_evidence, match_rules
from faultscope.schema import FACTS
from faultscope.sources.rulebook import Rulebook


def test_rules_from_files_are_no_literal_of_the_plan(spark, tmp_path):
    rules = spark.range(20_000).select(F.to_json(F.struct(
        F.lit("fam").alias("family"), F.col("id").cast("int").alias("ord"), F.concat(F.lit("ED"), "id").alias("id"),
        F.array(F.concat(F.lit("kind"), F.col("id") % 200)).alias("requires"))).alias("value"))
    rules.write.text(f"{tmp_path}/rules")
    table = Rulebook.read(spark, f"{tmp_path}/rules").table(spark)
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "Range" not in plan and "from_json" not in plan and len(plan) < 10_000
    assert (table.count(), table.select("id").distinct().count()) == (20_000, 20_000)
    facts = spark.createDataFrame([("fam", "a", n, f"f{n}", k, "s", "a:1", "e", {"n": "1"}) for n, k in ((1, "kind7"), (2, "kind199"), (3, "other"))], FACTS)
    book = Rulebook.read(spark, f"{tmp_path}/rules")
    fired = match_rules(artifact_profile(facts, book), book)
    assert {r.ord % 200 for r in fired.collect()} == {7, 199} and fired.count() == 200
    assert {r.facts for r in fired.collect()} == {3}


def test_builtin_rules_fire_alike_in_both_forms(spark, tmp_path):
    """The same rules as masks of the plan and as a table of names."""
    masks = Rulebook.builtin()
    names = Rulebook.of(masks.table(spark))
    kinds = [("polygraphy", k) for k in ("output_mismatch", "required_tolerance", "mismatched_outputs", "all_outputs_matched")]
    kinds += [("onnxruntime", k) for k in ("split_execution", "cpu_fallback_ops", "silent_cpu_only")] + [("ort_profile", k) for k in ("op_cost", "profile_summary", "session_phase")]
    rows = []
    for a in range(64):
        for n, (family, kind) in enumerate(kinds):
            if a >> n % 6 & 1:
                data = {"count": str(a % 5), "share_pct": str(a), "ms": str(3 * a), "output": "t"} if a % 7 else {}
                rows.append((family, f"a{a}", n + 1, f"f{n + 1}", kind, "s", f"a{a}:1", "e", data))
    facts = spark.createDataFrame(rows, FACTS)

    def run(book):
        fired = match_rules(artifact_profile(facts, book), book)
        evidence = gather_evidence(cited_facts(facts, fired, book))
        found = diagnose(facts, book, fired, evidence)
        return (sorted(json.dumps(r.asDict(), sort_keys=True) for r in fired.collect()),
                sorted(json.dumps(r.asDict(), sort_keys=True) for r in evidence.collect()),
                sorted((r.family, r.artifact, r.rank, r.code, r.message, r.cited) for r in found.collect()))

    assert run(masks) == run(names) and run(names)[0]
