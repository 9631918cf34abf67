"""Report documents written in parts by many tasks."""

import json

from pyspark.sql import functions as F

from faultscope.operators import report
from faultscope.operators.rules import artifact_profile, cited_facts, diagnose, gather_evidence, match_rules
from faultscope.schema import FACTS
from faultscope.sources.report_files import document_pieces, read_documents, write_documents
from faultscope.sources.rulebook import Rulebook


def strict(text):
    def no(value):
        raise ValueError(value)
    return json.loads(text, parse_constant=no, object_pairs_hook=lambda pairs: dict(pairs) if len(dict(pairs)) == len(pairs) else no(pairs))


def reports(spark, rows, artifacts, folder, masked=True, tasks=None):
    facts = spark.createDataFrame(rows, FACTS)
    book = Rulebook.builtin()
    fired = match_rules(artifact_profile(facts, book), book)
    cited = cited_facts(facts, fired, book)
    evidence = gather_evidence(cited)
    found = diagnose(facts, book, fired, evidence, cited=cited)
    shown = report.redact_facts(facts) if masked else facts
    names = spark.createDataFrame(artifacts, "family string, artifact string")
    if tasks:
        spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return write_documents(report.report_fragments(names, shown, found, evidence), str(folder)), evidence
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_a_hot_artifact_is_written_by_several_tasks(spark, tmp_path):
    odd = ['say "no"\\', "line\nbreak ", "token=glpat-abcdefghijklmnopqrst", "é你\x07", "</script>"]
    rows = [("onnxruntime", "hot.log", n, f"f{n}", "silent_cpu_only" if n % 3 else "node_on_provider", f"s {odd[n % 5]}", f"hot.log:{n}", odd[n % 5], {"requested": odd[n % 5], "count": str(n)})
            for n in range(1, 1500)]
    rows += [("onnxruntime", "one.log", 1, "f1", "session_failed", "s", "one.log:1", "e", {"error": "x"})]
    artifacts = [("onnxruntime", "hot.log"), ("onnxruntime", "one.log"), ("raspberrypi", "clean.log")]
    manifest, evidence = reports(spark, rows, artifacts, tmp_path / "r", tasks=7)
    parts = [r.asDict() for r in manifest.collect()]
    hot = [p for p in parts if p["artifact"] == "hot.log"]
    assert len({p["path"] for p in hot}) >= 4 and max(p["length"] for p in hot) < sum(p["length"] for p in hot) / 2
    docs = {r.artifact: strict(r.document) for r in read_documents(manifest).collect()}
    assert set(docs) == {"hot.log", "one.log", "clean.log"}
    assert strict(b"".join(document_pieces(hot, piece=100))) == docs["hot.log"]
    doc = docs["hot.log"]
    assert list(doc) == ["schemaVersion", "tool", "backend", "artifact", "redacted", "secretsDetected", "diagnostics", "facts"]
    assert [f["id"] for f in doc["facts"]] == [f"f{n}" for n in range(1, 1500)] and doc["secretsDetected"] == ["assigned-secret", "gitlab-token"]
    assert doc["facts"][0]["data"]["count"] == 1 and "glpat" not in json.dumps(doc)
    want = [r.id for r in evidence.where("artifact = 'hot.log' and code = 'ED0302'").orderBy("position").collect()]
    assert [d["evidence"] for d in doc["diagnostics"] if d["code"] == "ED0302"] == [want] and len(want) > 900
    assert docs["clean.log"]["facts"] == docs["clean.log"]["diagnostics"] == []
    assert docs["one.log"]["facts"][0]["data"] == {"error": "x"}


def test_reports_without_masking(spark, tmp_path):
    rows = [("raspberrypi", "a.log", 1, "f1", "throttle_active", "s", "a.log:1", "token=glpat-abcdefghijklmnopqrst", {"conditions": "x"})]
    manifest, _ = reports(spark, rows, [("raspberrypi", "a.log")], tmp_path / "r", masked=False)
    doc = strict(read_documents(manifest).first().document)
    assert not doc["redacted"] and "glpat" in doc["facts"][0]["excerpt"] and [d["code"] for d in doc["diagnostics"]] == ["ED0401"]
    assert read_documents(manifest.where("false")).count() == 0
