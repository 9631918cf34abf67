"""Each signature: a line that matches and one that only comes near."""

import time

import pytest
from pyspark.sql import functions as F

from faultscope.families import FAMILIES
from faultscope.functions.secrets import redact
from faultscope.functions.text import visible
from faultscope.operators.signatures import match_signatures
from faultscope.sources.artifacts import explode_lines

CASES = [
    ("tensorrt", "unsupported_op", "No importer registered for op: [com.microsoft.Attention]. Attempting to import as plugin.", {"op": "com.microsoft.Attention"}, "No importer registered for op: Foo."),
    ("tensorrt", "unsupported_op", "No importer registered for op: grid_sampler Attempting to import as plugin", {"op": "grid_sampler"}, "No importer registered for op:"),
    ("tensorrt", "plugin_not_found", "getPluginCreator could not find plugin Foo version 1", {"plugin": "Foo", "ver": "1"}, "getPluginCreator could not find plugin: Foo"),
    ("tensorrt", "parse_error_node", 'While parsing node number 7 [Clip -> "out"]:', {"idx": "7", "op": "Clip", "output": "out"}, "While parsing node number x [Clip]"),
    ("tensorrt", "parse_error_node", "In node -1 (importModel): INVALID_GRAPH: bad", {"idx": "-1", "func": "importModel", "code": "INVALID_GRAPH"}, "In node 3 with name: a"),
    ("tensorrt", "no_implementation", "Error Code 10: x (Could not find any implementation for node /a/b.)", {"node": "/a/b"}, "Could not find any implementation"),
    ("tensorrt", "trt_error_code", "Error Code 4: Internal Error (bad)", {"code": "4", "detail": "Internal Error (bad)"}, "Error Code x: y"),
    ("tensorrt", "tactic_skipped", "Skipping tactic 0x0f due to oom", {"tactic": "0x0f", "reason": "oom"}, "Skipping tactic now"),
    ("tensorrt", "run_verdict", "&&&& PASSED TensorRT.trtexec", {"verdict": "PASSED"}, "PASSED TensorRT.trtexec"),
    ("tensorrt", "trt_version", "TensorRT version: 10.7.0", {"version": "10.7.0"}, "TensorRT version: unknown"),
    ("polygraphy", "output_mismatch", 'FAILED | Output: "o" | Difference exceeds tolerance (rel=1e-05, abs=1e-05)', {"output": "o", "rtol": "1e-05", "atol": "1e-05"}, "Difference exceeds tolerance"),
    ("polygraphy", "output_match", "PASSED | Output: `o` | Difference is within tolerance (rel=1, abs=2)", {"output": "o", "rtol": "1", "atol": "2"}, "FAILED | Difference is within tolerance"),
    ("polygraphy", "shape_mismatch", "FAILED | Output: `o` | Will not compare outputs of different shapes.", {"output": "o"}, "Will not compare outputs of different shapes"),
    ("polygraphy", "shape_detail", "Note: Output shapes are (1, 2) and ().", {"shape0": "1, 2", "shape1": ""}, "Note: Output shapes are 1 and 2"),
    ("polygraphy", "mismatched_outputs", "FAILED | Mismatched outputs: ['a', \"b/c.0\"]", {"outputs": '["a","b/c.0"]', "count": "2", "first_output": "a"}, "PASSED | Mismatched outputs: ['a']"),
    ("polygraphy", "all_outputs_matched", "PASSED | All outputs matched | Outputs: []", {"outputs": "[]", "count": "0"}, "PASSED | All outputs matched"),
    ("polygraphy", "nan_detected", "NaN Detected | here", {"detail": "here"}, "NaN Detected"),
    ("polygraphy", "inf_detected", "Inf Detected | here", {"detail": "here"}, "Inf Detected"),
    ("polygraphy", "validation_failed", "FAILED | Errors detected in output: o", {"output": "o"}, "Errors detected in output: o"),
    ("polygraphy", "divergence_metrics", "Average Metrics | o: max_absdiff=1.5 (n=1), mean_reldiff=2", {"output": "o", "metrics": "max_absdiff=1.5 (n=1), mean_reldiff=2", "max_absdiff": "1.5", "mean_reldiff": "2"}, "Average Metrics | o"),
    ("polygraphy", "required_tolerance", "Minimum Required Tolerance: max error | [abs=1] OR [rel=2] (x)", {"stat": "max", "req_abs": "1", "req_rel": "2"}, "Minimum Required Tolerance: max"),
    ("polygraphy", "tolerance_setting", "Tolerance: [abs=1, rel=2] | Checking elemwise error", {"used_abs": "1", "used_rel": "2", "stat": "elemwise"}, "Tolerance: [abs=1]"),
    ("polygraphy", "compared_output", "Comparing Output: 'o' (dtype=float32, shape=(1)) with", {"output": "o", "dtype": "float32", "shape": "1"}, "Comparing Output: 'o'"),
    ("polygraphy", "accuracy_summary", "Accuracy Summary | a vs. b | Passed: 1/2 iterations | Pass Rate: 50.0%", {"runner0": "a", "runner1": "b", "passed": "1", "total": "2", "rate": "50.0"}, "Accuracy Summary | a"),
    ("polygraphy", "run_verdict", "FAILED | Runtime: 1.3s | Command", {"verdict": "FAILED", "runtime": "1.3s"}, "RUNNING | Runtime: 1s"),
    ("onnxruntime", "all_nodes_one_provider", "All nodes placed on [CPUExecutionProvider]. Number of nodes: 024", {"provider": "CPUExecutionProvider", "count": "24"}, "All nodes placed on CPU"),
    ("onnxruntime", "node_placement", "Node(s) placed on [X]. Number of nodes: 2", {"provider": "X", "count": "2"}, "Node(s) placed on []. Number of nodes: 2"),
    ("onnxruntime", "provider_capability", "X::GetCapability, number of partitions supported by x: 2 number of nodes in the graph: 5 number of nodes supported by x: 3", {"provider": "X", "short_name": "x", "partitions": "2", "graph_nodes": "5", "supported": "3", "unsupported": "2"}, "X::GetCapability, number of partitions supported by x: 2"),
    ("onnxruntime", "provider_unavailable", "Specified provider 'C' is not in available provider names. Available providers: 'A,  B'", {"requested": "C", "available": '["A","B"]'}, "Specified provider 'C' is not in available provider names."),
    ("onnxruntime", "session_providers", "SESSION_PROVIDERS: A , B,", {"providers": '["A","B"]'}, "SESSION_PROVIDERS:"),
    ("onnxruntime", "session_failed", "SESSION_FAILED: Load model from x failed", {"error": "Load model from x failed"}, "SESSION_FAILED:"),
    ("onnxruntime", "memcpy_nodes_added", "3 Memcpy nodes are added to the graph g for CUDAExecutionProvider. It", {"count": "3", "graph": "g", "provider": "CUDAExecutionProvider"}, "Memcpy nodes are added to the graph g"),
    ("onnxruntime", "memcpy_transformer", "GraphTransformer MemcpyTransformer modified: 0 with", {"modified": "0"}, "GraphTransformer MemcpyTransformer modified: no"),
    ("onnxruntime", "load_failed", "Load model from x failed", {}, "Load model from x"),
    ("onnxruntime", "protobuf_error", "Protobuf parsing failed", {}, "Protobuf parsing"),
    ("onnxruntime", "node_on_provider", "VerifyEachNodeIsAssignedToAnEp]   a_1234567890 (a_0) ", {"op": "a_1234567890", "node": "a_0"}, "VerifyEachNodeIsAssignedToAnEp]  123456_x_123456_0 (n)"),
    ("raspberrypi", "soc_temperature", "temp=84.20'C", {"celsius": "84.2"}, "temp=hot"),
    ("raspberrypi", "arm_clock", "frequency(48)=1500345000", {"clock_id": "48", "hertz": "1500345000", "mhz": "1500"}, "frequency()=1"),
    ("raspberrypi", "oom_kill", "Out of memory: Killed process 12 (a b) x", {"pid": "12", "process": "a b"}, "Out of memory: Killed process"),
    ("raspberrypi", "oom_invoked", "py invoked oom-killer: gfp_mask=0x1(A|B), order=-1, x", {"invoker": "py", "gfp_mask": "0x1(A|B)", "order": "-1"}, "py invoked oom-killer"),
    ("raspberrypi", "oom_memory_summary", "x 12 pages RAM", {"pages": "12"}, "pages RAM"),
    ("raspberrypi", "allocation_failed", "std::bad_alloc", {}, "bad alloc"),
]


def matched(spark, rows):
    lines = spark.createDataFrame([(f, str(i), 1, t) for i, (f, t) in enumerate(rows)], "family string, artifact string, lineno bigint, line string")
    out = {}
    for r in match_signatures(lines).collect():
        out.setdefault(int(r.artifact), []).append((r.kind, r.data))
    return out


def test_matching_lines(spark):
    got = matched(spark, [(c[0], "[I] " + c[2]) for c in CASES])
    for i, (family, kind, line, data, _) in enumerate(CASES):
        assert got[i] == [(kind, data)], (family, line)


def test_near_misses(spark):
    assert matched(spark, [(c[0], c[4]) for c in CASES]) == {}


def test_every_signature_has_a_case():
    cased = {(c[0], c[1]) for c in CASES} | {("raspberrypi", "throttled_bitfield")}
    assert cased == {(f.name, s.kind) for f in FAMILIES.values() for s in f.signatures}


def test_throttle_readings(spark):
    lines = ["throttled=0x50005", "throttled = 256", "throttled=0x0", "gfp_mask=0x140dca", "throttled=0x", "throttled=0x" + "F" * 33,
             "throttled=0xF" + "0" * 30 + "1", "throttled=12345678901234567890123456789012"]
    got = matched(spark, [("raspberrypi", t) for t in lines])
    assert [k for k, _ in got[0]] == ["throttled_bitfield", "throttle_active", "throttle_occurred"]
    assert got[0][1][1] == {"conditions": "undervoltage detected, currently throttled", "condition_keys": '["undervoltage","throttled"]', "count": "2", "hex": "0x50005"}
    assert got[1][0][1] == {"dec": "256", "hex": "0x100", "raw": "256", "live": "[]", "sticky": "[]", "unknown_bits": "[8]", "healthy": "false"}
    assert [k for k, _ in got[2]] == ["throttled_bitfield", "throttle_clear"]
    assert 3 not in got and 4 not in got and 5 not in got
    assert got[6][0][1]["unknown_bits"] == "[124,125,126,127]" and got[6][0][1]["live"] == '["undervoltage"]'
    number = int(lines[7].split("=")[1])
    assert got[7][0][1]["hex"] == f"0x{number:X}" and got[7][0][1]["raw"] == str(number)
    bits = [b for b in range(number.bit_length()) if number >> b & 1 and b not in (0, 1, 2, 3, 16, 17, 18, 19)]
    assert got[7][0][1]["unknown_bits"] == "[" + ",".join(map(str, bits)) + "]"


HOSTILE = {
    "empty": "", "blank": "   \n\t\n  ", "newlines": "\n\n\n\n", "crlf": "one\r\ntwo\r\n", "cr": "one\rtwo", "nul": "a\x00b", "ansi": "\x1b[31mred\x1b[0m",
    "unicode": "日本語 ✓ émoji 🔥", "rtl": "abc‮def", "binary": "".join(chr(i % 256) for i in range(2000)), "json": '{"not": "a log"}',
    "brackets": "[" * 500 + "]" * 500, "short lines": "x\n" * 20000, "long line": "y" * 100_000, "word": "a" * 60_000, "digits": "9" * 60_000,
    "blanks": " " * 60_000, "hex": "f" * 60_000, "punctuation": "./-_" * 15_000, "quotes": "'" * 30_000, "equals": "=" * 30_000,
    "dots": "Could not find any implementation for node " + "." * 100_000 + "x", "keys": "token" * 20_000, "colons": "a:" * 50_000 + "//",
}


def test_hostile_texts_are_no_facts_and_take_no_time(spark):
    rows = [(f, name, text) for f in FAMILIES for name, text in HOSTILE.items()]
    lines = explode_lines(spark.createDataFrame(rows, "family string, artifact string, text string"))
    start = time.monotonic()
    found = {(r.family, r.artifact) for r in match_signatures(lines).collect()}
    assert found == {("tensorrt", "dots")}
    lines.select(F.sum(F.length(visible(redact(F.col("line"))["text"])))).collect()
    assert time.monotonic() - start < 60


@pytest.mark.parametrize("text,expected", [
    ("", []), ("a\n", ["a"]), ("a\n\n", ["a", ""]), ("a\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i j k", list("abcdefghijk")), ("\n", [""])])
def test_lines(spark, text, expected):
    df = spark.createDataFrame([("f", "a", text)], "family string, artifact string, text string")
    assert [(r.lineno, r.line) for r in explode_lines(df).collect()] == list(enumerate(expected, start=1))


@pytest.mark.parametrize("family, piece", [("polygraphy", "FAILED | Mismatched outputs: ["), ("polygraphy", "FAILED | Mismatched outputs: ['"), ("polygraphy", "PASSED | All outputs matched | Outputs: ['a', "),
                                           ("tensorrt", "No importer registered for op: "), ("onnxruntime", "Load model "), ("raspberrypi", "a invoked oom-killer: gfp_mask=0,")])
def test_lines_that_never_end_take_linear_time(spark, family, piece):
    def seconds(n):
        row = [(family, "a", 1, piece * (n // len(piece)))]
        start = time.perf_counter()
        match_signatures(spark.createDataFrame(row, "family string, artifact string, lineno long, line string")).collect()
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(200_000) < 5
