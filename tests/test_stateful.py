"""Lines that arrive in batches against the same lines at once."""

import datetime

import pytest
from pyspark.sql import functions as F

from faultscope.plans.diagnosis import line_facts, run_diagnosis
from faultscope.streaming.stateful import LINES, Session, _taken, diagnose_lines_stream, streamed
from faultscope.families import FAMILIES

TEXT = {
    ("onnxruntime", "s.log"): [
        "[V] VerifyEachNodeIsAssignedToAnEp]   Early (e_0)", "[V] Node(s) placed on [CPUExecutionProvider]. Number of nodes: 2", "[V] VerifyEachNodeIsAssignedToAnEp]   Conv (c_0)",
        "[V] VerifyEachNodeIsAssignedToAnEp]   Conv (c_1)", "nothing", "[V] Node(s) placed on [AccelExecutionProvider]. Number of nodes: 9", "[V] VerifyEachNodeIsAssignedToAnEp]   Add (a_0)",
        "Specified provider 'CUDAExecutionProvider' is not in available provider names.Available providers: 'CPUExecutionProvider'", "SESSION_PROVIDERS: CPUExecutionProvider",
        "[V] Node(s) placed on [CPUExecutionProvider]. Number of nodes: 5", "[V] VerifyEachNodeIsAssignedToAnEp]   Mul (m_0)"],
    ("polygraphy", "p.log"): ["[E] FAILED | Mismatched outputs: ['a', 'b']", "[I] Comparing Output: 'a' (dtype=f, shape=(1))", "[I] Minimum Required Tolerance: max error | [abs=1] OR [rel=2]"],
    ("raspberrypi", "clean.log"): ["nothing", "to see"],
    ("raspberrypi", "hot.log"): ["throttled=0x50005", "temp=80.1'C"],
}
LATER = ("tensorrt", "later.log")


def lines():
    out, start = [], datetime.datetime(2024, 1, 1)
    for (family, artifact), texts in TEXT.items():
        out += [(family, artifact, n, t, start + datetime.timedelta(seconds=n), False) for n, t in enumerate(texts, 1)]
    return out


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    """Three batches, shuffled inside, one line behind its turn, one artifact ended by a row, the
    others by the time that a later artifact brings; then a line after the end."""
    folder, every = tmp_path_factory.mktemp("stream"), lines()
    first = [r for r in every if r[2] <= 3][::-1]
    second = [r for r in every if r[2] > 3][::-1] + [("onnxruntime", "s.log", 2, every[1][3], every[1][4], False)]
    day = datetime.datetime(2024, 1, 2)
    end = [("raspberrypi", "hot.log", 2, None, day, True), (*LATER, 1, "[I] TensorRT version: 10.1", day, False)]
    after = [("raspberrypi", "hot.log", 3, "temp=1.0'C", day, False), (*LATER, 2, "[I] step", day, False)]
    for k, rows in enumerate([first, second, end, after, [(*LATER, 3, "x", day + datetime.timedelta(days=1), False)]]):
        spark.createDataFrame(rows, LINES).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    diagnose_lines_stream(stream, f"{folder}/out", f"{folder}/state", availableNow=True).awaitTermination()
    return {name: streamed(spark, f"{folder}/out", name) for name in ("facts", "late", "verdicts")}


def test_facts_and_verdicts_equal_those_of_the_whole(spark, results):
    frame = spark.createDataFrame(lines(), LINES).select("family", "artifact", "lineno", "line")
    run = run_diagnosis(frame.select("family", "artifact"), line_facts(frame))
    columns = ["family", "artifact", "seq", "id", "kind", "summary", "source", "excerpt"]
    def plain(df):
        df = df.where(F.col("artifact") != LATER[1])
        return sorted((*[r[c] for c in columns], str(sorted(r["data"].items()))) for r in df.collect())
    assert plain(results["facts"]) == plain(run.facts) and run.facts.where("kind = 'cpu_fallback_ops'").count() == 1
    got = {(r.artifact, r.exit_code) for r in results["verdicts"].collect() if r.artifact != LATER[1]}
    assert got == {(r.artifact, r.exit_code) for r in run.verdicts.collect()} and len(got) == 4


def test_late_lines_are_kept_apart(results):
    assert sorted((r.artifact, r.lineno, r.kind) for r in results["late"].collect()) == [("hot.log", 3, "soc_temperature"), ("s.log", 2, "node_placement")]


def test_headings_and_overview_of_one_fact():
    context = FAMILIES["onnxruntime"].context
    assert _taken(context, None, "node_on_provider", {"op": "A"}) == (None, None)
    assert _taken(context, "P", "node_on_provider", {"op": "A"}) == ("P", {"op": "A", "provider": "P"})
    assert _taken(None, None, "x", {"a": "b"}) == (None, {"a": "b"})
    state = {}
    Session.see(state, "node_placement", {"provider": "CPUExecutionProvider", "count": "x"}, 1, "e")
    assert list(Session.derived(state, [])) == []
