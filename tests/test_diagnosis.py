"""Whole artifacts: codes, verdicts, facts, and the same result however the work is sliced."""

import pytest
from pyspark.sql import functions as F

from faultscope.operators.facts import number_facts, resolve_facts
from faultscope.operators.report import evidence_shown, facts_listing
from faultscope.operators.signatures import match_signatures
from faultscope.operators.verdicts import summary_counts
from faultscope.plans.diagnosis import all_facts, run_diagnosis
from faultscope.sources.artifacts import explode_lines
from faultscope.sources.rulebook import Rulebook
from faultscope.sources.traces import read_trace, type_events
from faultscope.workload.registry import flat_map
from tests.artifacts import EXPECTED, TEXTS, TRACES


def artifacts_of(spark):
    rows = [(f, n, t) for f, d in TEXTS.items() for n, t in d.items()]
    return spark.createDataFrame(rows, "family string, artifact string, text string")


def traces_of(spark):
    return spark.createDataFrame([("ort_profile", n, t) for n, t in TRACES.items()], "family string, artifact string, text string")


def run(spark, slice_rows, prefer_met=False):
    logs, traces = artifacts_of(spark), traces_of(spark)
    facts = all_facts(explode_lines(logs), type_events(read_trace(traces)), slice_rows)
    return run_diagnosis(logs.unionByName(traces), facts, slice_rows=slice_rows, prefer_met=prefer_met)


@pytest.fixture(scope="module")
def whole(spark):
    return run(spark, 65_536)


def codes_of(result):
    out = {}
    for row in result.diagnoses.orderBy("artifact", "rank").collect():
        out.setdefault(row.artifact, []).append(row.code)
    return out


def facts_of(result):
    return sorted(tuple(r) for r in result.facts.select("family", "artifact", "id", "kind", "source", "summary", "excerpt", flat_map("data")).collect())


def test_codes_and_verdicts(whole):
    codes = codes_of(whole)
    verdicts = {r.artifact: r.exit_code for r in whole.verdicts.collect()}
    assert {a: (codes.get(a, []), verdicts[a]) for a in EXPECTED} == EXPECTED


@pytest.mark.parametrize("slice_rows", [1, 2, 3])
def test_slices_change_nothing(spark, whole, slice_rows):
    sliced = run(spark, slice_rows)
    assert facts_of(sliced) == facts_of(whole)
    assert codes_of(sliced) == codes_of(whole)
    key = ["artifact", "code", "position", "id"]
    assert sorted(map(tuple, sliced.evidence.select(*key).collect())) == sorted(map(tuple, whole.evidence.select(*key).collect()))
    assert (sorted(map(tuple, sliced.diagnoses.select("artifact", "code", "message").collect()))
            == sorted(map(tuple, whole.diagnoses.select("artifact", "code", "message").collect())))


def test_message_shows_first_fact_or_the_one_that_met(spark, whole):
    def message(result):
        return result.diagnoses.where("artifact = 'split.json' and code = 'ED0504'").first().message
    assert "0.457 ms" in message(whole)
    assert "131.75 ms" in message(run(spark, 65_536, prefer_met=True))


def test_trace_facts(whole):
    rows = {(r.kind, r.source): r.data for r in whole.facts.where("artifact = 'split.json'").collect()}
    top = rows[("op_cost", "split.json:op:1029384756102938475_CoreML_1029384756102938475_0")]
    assert (top["op"], top["us"], top["share_pct"], top["calls"], top["distinct_nodes"]) == ("CoreML compiled subgraph #0", "6050", "74.14", "5", "1")
    split = rows[("provider_time_split", "split.json:summary")]
    assert (split["cpu_us"], split["cpu_share_pct"], split["provider_count"]) == ("100", "1.23", "2")
    assert rows[("slowest_node", "split.json:events[3]")]["us"] == "1210"
    assert rows[("profile_summary", "split.json:summary")]["iterations"] == "5"


def test_context_runs_on_and_never_ahead(spark):
    text = ("[I] Minimum Required Tolerance: elemwise error | [abs=1] OR [rel=2]\n"
            "[I] Comparing Output: 'a' (dtype=float32, shape=())\n[I] x\n[I] PASSED | Runtime: 1s\n"
            "[I] Comparing Output: 'b' (dtype=float32, shape=(1))\n[E] FAILED | Output: 'own' | Difference exceeds tolerance (rel=1, abs=1)\n"
            "[E] NaN Detected | yes\n")
    lines = explode_lines(spark.createDataFrame([("polygraphy", "c.log", text)], "family string, artifact string, text string"))
    for size in (1, 2, 100):
        facts = number_facts(resolve_facts(match_signatures(lines, slice_lines=size)))
        got = [(r.id, r.kind, r.data.get("output"), r.data.get("shape")) for r in facts.orderBy("seq").collect()]
        assert got == [("f1", "required_tolerance", None, None), ("f2", "compared_output", "a", ""), ("f3", "run_verdict", "a", None),
                       ("f4", "compared_output", "b", "1"), ("f5", "output_mismatch", "own", None), ("f6", "nan_detected", "b", None)]


def test_listing_and_counts_state_clean_artifacts(spark, whole):
    clean = spark.createDataFrame([("tensorrt", "clean.log")], "family string, artifact string")
    row = facts_listing(whole.facts, clean).where("seq is null").collect()
    assert [(r.artifact, r.facts, r.kind) for r in row] == [("clean.log", 0, None)]
    counts = summary_counts(clean, whole.diagnoses, whole.facts).first()
    assert (counts.errors, counts.warnings, counts.infos, counts.other, counts.facts) == (0, 0, 0, 0, 0)
    odd = whole.diagnoses.where("artifact = 'alloc.log'").withColumn("severity", F.lit("fatal"))
    assert summary_counts(odd.select("family", "artifact"), odd, whole.facts).first().other == 1


def test_shown_evidence_is_capped_and_says_so(whole):
    rows = evidence_shown(whole.evidence, whole.facts).where("artifact = 'oom.log'").orderBy("shown").collect()
    assert [(r.shown, r.id) for r in rows] == [(1, "f5"), (2, "f1"), (3, "f2"), (4, "f3")]
    assert {r.hidden for r in rows} == {1}


def test_plan_is_jvm_side_and_broadcasts_rules(whole):
    plan = whole.diagnoses._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BroadcastHashJoin" in plan


def test_builtin_rules_are_clean(spark):
    from faultscope.operators.audit import rule_lint
    table = Rulebook.builtin().table(spark)
    assert table.count() == 25
    assert rule_lint(table).collect() == []
