"""Headline queries at one scale; prints one JSON line.

Each query runs once to warm up (class loading, code generation) and then
``BENCH_RUNS`` times; the best time counts. Every run builds its plan anew and
writes all rows to a sink that drops them, so nothing is cached or pruned away.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "x1_match_signatures", "x11_carry_context", "s2_explode_lines", "g1_redact_documents", "g1_redact_pages", "g9_oneline", "g11_cause_lines",
    "x14_decode_bitfield", "trace_facts", "trace_diagnose", "c1_compare_vectors", "q10_false_positives",
    "r3_match_rules", "r4_gather_evidence", "a13_verdicts", "r7_diagnose", "l5_merge_synthesized", "s7_report_json",
]


def _ceilings(spark: SparkSession) -> dict[str, float]:
    """
    scaling entries are times over times for four times the input (ceiling 9)."""
    from pyspark.sql import functions as F

    from faultscope.functions.secrets import sanitize
    from faultscope.operators.rules import artifact_profile, match_rules
    from faultscope.operators.signatures import match_signatures
    from faultscope.sources.rulebook import Rulebook

    def best(make) -> float:
        times = []
        for _ in range(3):
            start = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        return min(times[1:])

    def line(n: int):
        return spark.range(1).select(F.lit("tensorrt").alias("family"), F.lit("a").alias("artifact"), F.lit(1).cast("bigint").alias("lineno"),
                                     F.repeat(F.lit("token=sk- 0xAKIA"), n // 16).alias("line"))

    def masked(n: int):
        return line(n).select(sanitize(F.col("line")))

    facts = spark.range(1, 20_001).select(
        F.lit("onnxruntime").alias("family"), F.lit("hot").alias("artifact"), F.col("id").alias("seq"), F.lit("node_on_provider").alias("kind"),
        F.create_map(F.lit("provider"), F.lit("CPUExecutionProvider")).alias("data"))
    book = Rulebook.builtin()
    mask = {n: best(lambda n=n: masked(n)) for n in (50_000, 200_000)}
    match = {n: best(lambda n=n: match_signatures(line(n))) for n in (20_000, 80_000, 200_000)}
    return {k: round(v, 3) for k, v in {
        "rules_20000_facts": best(lambda: match_rules(artifact_profile(facts, book), book)), "mask_200000_chars": mask[200_000],
        "mask_4x": mask[200_000] / mask[50_000], "match_200000_chars": match[200_000], "match_4x": match[80_000] / match[20_000]}.items()}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName("faultscope-bench")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
               .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")))
    with tempfile.TemporaryDirectory(prefix="faultscope-bench-") as scratch:
        spark = builder.config("spark.checkpoint.dir", scratch).getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
        from faultscope.workload import QUERIES

        def run(name: str) -> float:
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - start

        seconds = {}
        for name in names:
            run(name)
            seconds[name] = round(min(run(name) for _ in range(runs)), 3)
        ceilings = _ceilings(spark)
        spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus), "ceilings": ceilings}))


if __name__ == "__main__":
    main()
