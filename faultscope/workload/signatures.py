"""Every signature of every family on lines made from ``events``, with its whole payload.

``#`` stands for the number of an event, in the line and in what must come of it.
"""

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.families.table import compile_families, family_named, read_signatures
from faultscope.functions.sql import literal
from faultscope.operators.facts import number_facts, resolve_facts
from faultscope.operators.rules import artifact_profile, match_rules
from faultscope.operators.signatures import match_signatures
from faultscope.plans.diagnosis import line_facts
from faultscope.sources.rulebook import Rulebook
from faultscope.staging import new_path, stage
from faultscope.workload.registry import flat_map, query
from faultscope.workload.views import BASE, duck, table, v_log, with_lines

# family, line, [(kind, payload in key order)]
SAMPLES = [
    ("tensorrt", "[W] No importer registered for op: [ns.Op#]. Attempting to import as plugin.", [("unsupported_op", "op=ns.Op#")]),
    ("tensorrt", "[E] 3: getPluginCreator could not find plugin: Grid# version: 1", [("plugin_not_found", "plugin=Grid#;ver=1")]),
    ("tensorrt", '[E] While parsing node number # [Conv -> "out_#"]:', [("parse_error_node", "idx=#;op=Conv;output=out_#")]),
    ("tensorrt", "[E] In node # with name: n/# and operator: Resize (checkInput): UNSUPPORTED_NODE: no", [("parse_error_node", "code=UNSUPPORTED_NODE;func=checkInput;idx=#;name=n/#;op=Resize")]),
    ("tensorrt", "[E] In node -1 (importModel): INVALID_GRAPH: #", [("parse_error_node", "code=INVALID_GRAPH;func=importModel;idx=-1")]),
    ("tensorrt", "[E] Error Code 10: Internal Error (Could not find any implementation for node {ForeignNode#}.)", [("no_implementation", "node={ForeignNode#}")]),
    ("tensorrt", "[E] [TRT] Error Code #: Serialization (bad tag)", [("trt_error_code", "code=#;detail=Serialization (bad tag)")]),
    ("tensorrt", "[W] Skipping tactic 0x000000000000# due to Myelin error: no scope", [("tactic_skipped", "reason=Myelin error: no scope;tactic=0x000000000000#")]),
    ("tensorrt", "&&&& FAILED TensorRT.trtexec [v#] # trtexec", [("run_verdict", "verdict=FAILED")]),
    ("tensorrt", "[I] TensorRT version: 10.#.1", [("trt_version", "version=10.#.1")]),
    ("polygraphy", "[E] FAILED | Output: 'o#' | Difference exceeds tolerance (rel=1e-05, abs=0.#)", [("output_mismatch", "atol=0.#;output=o#;rtol=1e-05")]),
    ("polygraphy", "[I] PASSED | Output: 'o#' | Difference is within tolerance (rel=1e-05, abs=0.#)", [("output_match", "atol=0.#;output=o#;rtol=1e-05")]),
    ("polygraphy", "[E] FAILED | Output: `o#` | Will not compare outputs of different shapes.", [("shape_mismatch", "output=o#")]),
    ("polygraphy", "[E] Note: Output shapes are (1, #) and (#, 1).", [("shape_detail", "shape0=1, #;shape1=#, 1")]),
    ("polygraphy", "[E] FAILED | Mismatched outputs: ['a#', 'b[#]']", [("mismatched_outputs", 'count=2;first_output=a#;outputs=["a#","b[#]"]')]),
    ("polygraphy", "[I] PASSED | All outputs matched | Outputs: ['a#']", [("all_outputs_matched", 'count=1;first_output=a#;outputs=["a#"]')]),
    ("polygraphy", "[E] NaN Detected | One or more NaNs in o#", [("nan_detected", "detail=One or more NaNs in o#")]),
    ("polygraphy", "[E] Inf Detected | One or more non-finite values in o#", [("inf_detected", "detail=One or more non-finite values in o#")]),
    ("polygraphy", "[E] FAILED | Errors detected in output: o#", [("validation_failed", "output=o#")]),
    ("polygraphy", "[I] Average Metrics | o#: max_absdiff=0.#, mean_reldiff=#e-9", [("divergence_metrics", "max_absdiff=0.#;mean_reldiff=#e-9;metrics=max_absdiff=0.#, mean_reldiff=#e-9;output=o#")]),
    ("polygraphy", "[I] Minimum Required Tolerance: max error | [abs=#.5] OR [rel=inf]", [("required_tolerance", "req_abs=#.5;req_rel=inf;stat=max")]),
    ("polygraphy", "[I] Tolerance: [abs=#e-05, rel=0.#] | Checking elemwise error", [("tolerance_setting", "stat=elemwise;used_abs=#e-05;used_rel=0.#")]),
    ("polygraphy", "[I] Comparing Output: 'o#' (dtype=float32, shape=(1, #)) with 'p' (dtype=float32, shape=(1, #))", [("compared_output", "dtype=float32;output=o#;shape=1, #")]),
    ("polygraphy", "[I] Accuracy Summary | r-# vs. s-# | Passed: #/# iterations | Pass Rate: #.0%", [("accuracy_summary", "passed=#;rate=#.0;runner0=r-#;runner1=s-#;total=#")]),
    ("polygraphy", "[I] PASSED | Runtime: #.5s | Command: polygraphy run", [("run_verdict", "runtime=#.5s;verdict=PASSED")]),
    ("onnxruntime", "[I] All nodes placed on [CPUExecutionProvider]. Number of nodes: 00#", [("all_nodes_one_provider", "count=#;provider=CPUExecutionProvider")]),
    ("onnxruntime", "[V] Node(s) placed on [AccelExecutionProvider]. Number of nodes: #", [("node_placement", "count=#;provider=AccelExecutionProvider")]),
    ("onnxruntime", "CoreMLExecutionProvider::GetCapability, number of partitions supported by CoreML: # number of nodes in the graph: 9# number of nodes supported by CoreML: 9#",
     [("provider_capability", "graph_nodes=9#;partitions=#;provider=CoreMLExecutionProvider;short_name=CoreML;supported=9#;unsupported=0")]),
    ("onnxruntime", "Specified provider 'P#' is not in available provider names.Available providers: 'A#, CPUExecutionProvider'", [("provider_unavailable", 'available=["A#","CPUExecutionProvider"];requested=P#')]),
    ("onnxruntime", "SESSION_PROVIDERS: A#, CPUExecutionProvider", [("session_providers", 'providers=["A#","CPUExecutionProvider"]')]),
    ("onnxruntime", "SESSION_FAILED: no kernel for #", [("session_failed", "error=no kernel for #")]),
    ("onnxruntime", "[W] # Memcpy nodes are added to the graph main_# for CUDAExecutionProvider. It might be slow", [("memcpy_nodes_added", "count=#;graph=main_#;provider=CUDAExecutionProvider")]),
    ("onnxruntime", "[W] # Memcpy nodes are added to the graph  for CUDAExecutionProvider. It might be slow", [("memcpy_nodes_added", "count=#;graph=;provider=CUDAExecutionProvider")]),
    ("onnxruntime", "GraphTransformer MemcpyTransformer modified: # with status: OK", [("memcpy_transformer", "modified=#")]),
    ("onnxruntime", "Load model from m#.onnx failed: no such file", [("load_failed", "")]),
    ("onnxruntime", "Failed to load model with error #", [("load_failed", "")]),
    ("onnxruntime", "m#.onnx: Protobuf parsing failed.", [("protobuf_error", "")]),
    ("onnxruntime", "Error parsing message of m#", [("protobuf_error", "")]),
    ("onnxruntime", "[V] VerifyEachNodeIsAssignedToAnEp]   Conv# (c_#)", [("node_on_provider", "node=c_#;op=Conv#")]),
    ("raspberrypi", "throttled=0x0", [("throttled_bitfield", "healthy=true;hex=0x0;live=[];raw=0;sticky=[];unknown_bits=[]"), ("throttle_clear", "hex=0x0")]),
    ("raspberrypi", "temp=#.5'C", [("soc_temperature", "celsius=#.5")]),
    ("raspberrypi", "soc temp = #.25C", [("soc_temperature", "celsius=#.25")]),
    ("raspberrypi", "frequency(48)=#000000", [("arm_clock", "clock_id=48;hertz=#000000;mhz=#")]),
    ("raspberrypi", "Out of memory: Killed process # (worker-#) total-vm:1kB", [("oom_kill", "pid=#;process=worker-#")]),
    ("raspberrypi", "python# invoked oom-killer: gfp_mask=0x#(GFP_KERNEL), order=0, oom_score_adj=#", [("oom_invoked", "gfp_mask=0x#(GFP_KERNEL);invoker=python#;order=0")]),
    ("raspberrypi", "Mem-Info: #", [("oom_memory_summary", "")]),
    ("raspberrypi", "Total swap = #kB", [("oom_memory_summary", "total_swap=#")]),
    ("raspberrypi", "[1] # pages RAM", [("oom_memory_summary", "pages=#")]),
    ("raspberrypi", "Failed to allocate memory for requested buffer of size 1#", [("allocation_failed", None)]),
    ("raspberrypi", "terminate called after throwing std::bad_alloc #", [("allocation_failed", "")]),
    ("raspberrypi", "nothing to see in line #", []),
]
_N = len(SAMPLES)

_EXPECTED = ", ".join(f"({i}, {o}, {literal(kind)}, {'null' if payload is None else literal(payload)})"
                      for i, (_, _, facts) in enumerate(SAMPLES) for o, (kind, payload) in enumerate(facts)).replace("\\'", "''").replace('\\"', '"')
_FAMILY = "[" + ", ".join(f"'{f}'" for f, _, _ in SAMPLES) + "]"


def sample_lines(spark, sf_dir, number=None, together: int = 1) -> DataFrame:
    """``(family, artifact, lineno, line)``: an event's number picks the line and fills it, unless
    another ``number`` does; an artifact has four lines for each of ``together``."""
    base = spark.sql(BASE, events=table(spark, sf_dir, "events"))
    at = (F.col("k") + F.col("a") + F.col("lineno")) % _N + 1
    pick = lambda j: F.element_at(F.array(*[F.lit(x[j]) for x in SAMPLES]), at.cast("int"))
    number = F.col("k") + 1 if number is None else number
    return base.select(pick(0).alias("family"), F.concat(F.lit("log-"), F.floor(F.col("a") / together)).alias("artifact"), (F.col("a") % together * 4 + F.col("lineno")).alias("lineno"),
                       F.replace(pick(1), F.lit("#"), number.cast("string")).alias("line"))


@query("x2_every_signature", f"""
with b as ({duck(BASE)}), p as (select *, k + 1 as n, (k + a + lineno) % {_N} as i from b),
x(i, o, kind, payload) as (values {_EXPECTED})
select ({_FAMILY})[p.i + 1] as family, a, lineno, x.kind,
  case when x.payload is null then concat('bytes=1', n, ';mib=', round(cast(concat('1', n) as double) / 1048576, 1)) else replace(x.payload, '#', cast(n as varchar)) end as payload
from p join x on p.i = x.i""")
def x2_every_signature(spark, sf_dir):
    """All signatures of all families, one line in {_N} each, and lines that say nothing."""
    raw = match_signatures(sample_lines(spark, sf_dir))
    return raw.select("family", F.substring("artifact", 5, 20).cast("bigint").alias("a"), "lineno", "kind", flat_map("data").alias("payload"))


@query("r3_every_family", f"""
with b as ({duck(BASE)}), p as (select a // 4 as g, k % 3 + 1 as n, (k + a + lineno) % {_N} as i from b),
x(i, o, kind, payload) as (values {_EXPECTED}),
f as (select ({_FAMILY})[p.i + 1] as family, g, kind, n from p join x on p.i = x.i),
kinds as (select family, g, list(distinct kind) as kinds from f group by all),
r(family, code, req, absent) as (values ('tensorrt', 'ED0103', 'parse_error_node', []::varchar[]), ('tensorrt', 'ED0105', 'plugin_not_found', []), ('polygraphy', 'ED0203', 'nan_detected', []),
  ('polygraphy', 'ED0204', 'shape_mismatch', []), ('onnxruntime', 'ED0304', 'session_failed', []),
  ('onnxruntime', 'ED0305', 'all_nodes_one_provider', ['provider_unavailable', 'session_failed']))
select k.family, concat('log-', k.g) as artifact, r.code from kinds k join r on r.family = k.family
where list_contains(k.kinds, r.req) and not list_has_any(k.kinds, r.absent)
  and (r.code <> 'ED0305' or exists (select 1 from f where f.family = k.family and f.g = k.g and f.kind = 'provider_capability' and f.n <= 1))""")
def r3_every_family(spark, sf_dir):
    """The rules that the logs of the other queries never fire."""
    facts = stage(line_facts(sample_lines(spark, sf_dir, F.col("k") % 3 + 1, 4)), "facts")
    book = Rulebook.builtin()
    return match_rules(artifact_profile(facts, book), book).where(F.col("code").isin("ED0103", "ED0105", "ED0203", "ED0204", "ED0304", "ED0305")).select("family", "artifact", "code")


def _row(ord_: int, kind: str, template: str, summary: str, *fields: tuple, **more) -> dict:
    return {"family": "polygraphy", "ord": ord_, "kind": kind, "template": template, "summary": summary,
            "fields": [{"key": k, "place": n, "as": taken} for k, n, taken in fields], **more}


_NAMED = [("outputs", 1, "names"), ("count", 1, "size"), ("first_output", 1, "first")]

#: The comparison family as rows of a table.
TABLE = [
    _row(1, "output_mismatch", "FAILED | Output: <quoted> | Difference exceeds tolerance (rel=<value>, abs=<value>)", "'{output}' differs",
         ("output", 1, "text"), ("rtol", 2, "text"), ("atol", 3, "text"), context={"key": "output", "opens": ["compared_output"], "takes": None, "required": False}),
    _row(2, "mismatched_outputs", "FAILED | Mismatched outputs: [<list>]", "{count} differ", *_NAMED),
    _row(3, "all_outputs_matched", "PASSED | All outputs matched | Outputs: [<list>]", "All {count} agree", *_NAMED),
    _row(4, "required_tolerance", "Minimum Required Tolerance: <name> error | [abs=<value>] OR [rel=<value>]", "{req_abs} needed", ("stat", 1, "text"), ("req_abs", 2, "text"), ("req_rel", 3, "text")),
    _row(5, "compared_output", "Comparing Output: <quoted> (dtype=<value>, shape=(<dims>))", "'{output}' compared", ("output", 1, "text"), ("dtype", 2, "text"), ("shape", 3, "text")),
]


@query("x11_family_from_table", with_lines("""
select artifact, seq, kind, payload, case kind when 'output_mismatch' then concat('''t', k, ''' differs') when 'mismatched_outputs' then '2 differ'
  when 'all_outputs_matched' then 'All 1 agree' when 'required_tolerance' then concat('0.', k, ' needed') else concat('''t', k, ''' compared') end as summary
from n where family = 'polygraphy'"""))
def x11_family_from_table(spark, sf_dir):
    """A family read from JSON lines: its matching, headings, numbers and sentences."""
    folder = new_path(spark, "signatures")
    rows = spark.createDataFrame([(json.dumps(r),) for r in TABLE] + [("{broken",)], "value string")
    rows.write.text(folder)
    family = family_named(compile_families(read_signatures(spark, folder)), "polygraphy")
    raw = match_signatures(v_log(spark, sf_dir), [family])
    facts = resolve_facts(stage(raw, "raw-facts"), [family])
    return number_facts(facts, [family]).select("artifact", "seq", "kind", flat_map("data").alias("payload"), "summary")
