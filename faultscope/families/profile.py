"""ONNX Runtime profiling traces: sentences and rules (facts come from aggregates)."""

NAME = "ort_profile"

# What counts as a session phase, a notable share and a reliable run.
PHASES = ("model_loading_uri", "model_loading_array", "session_initialization")
NOTABLE_SHARE = 0.05
RELIABLE_ITERATIONS = 3
KERNEL_SUFFIX = "_kernel_time"

SUMMARIES = {
    "session_phase": "{phase} took {ms} ms",
    "profile_summary": "{unique_nodes} node(s) in about {iterations} iteration(s), {total_node_ms} ms in all",
    "few_iterations": "Only about {iterations} iteration(s): warm-up is part of the timings",
    "op_cost": "{op}: {ms} ms, {share_pct}% of the measured node time",
    "provider_time_split": "Node time is divided among {provider_count} providers, {cpu_share_pct}% on the CPU",
    "slowest_node": "Slowest single node: '{node}' ({op}), {ms} ms",
}

_DOCS = "https://onnxruntime.ai/docs/performance/tune-performance/profiling-tools.html"

RULES = [
    {"id": "ED0501", "severity": "info", "requires": ["op_cost", "profile_summary"],
     "absent": ["few_iterations"],
     "conditions": [{"kind": "op_cost", "field": "share_pct", "min": 50}],
     "message": "'{op}' takes {share_pct}% of the measured node time ({ms} ms of {total_node_ms} ms)",
     "cause": "One operator type takes most of the kernel time. That is often as it should be; it "
              "shows where an optimization could matter at all. Session setup and time between "
              "kernels are not part of this figure.",
     "suggestions": [
         {"summary": "Weigh it against the latency that is allowed: a large share of little may be fine"},
         {"summary": "If the operator should be cheap, check whether it was fused as intended"}],
     "refs": [_DOCS]},
    {"id": "ED0502", "severity": "warning", "requires": ["few_iterations"],
     "optional": ["profile_summary", "session_phase"],
     "message": "only about {iterations} iteration(s) were profiled, so warm-up dominates the timings",
     "cause": "The first passes pay for allocation, thread start and cold caches. Shares computed "
              "from one or two of them mislead, so no cost is attributed.",
     "suggestions": [
         {"summary": "Profile again after several warm-up runs"},
         {"summary": "Leave the first iteration out and see whether the others agree"}],
     "refs": [_DOCS]},
    {"id": "ED0503", "severity": "warning", "requires": ["provider_time_split"],
     "absent": ["few_iterations"], "optional": ["op_cost", "profile_summary"],
     "conditions": [{"kind": "provider_time_split", "field": "cpu_share_pct", "min": 10}],
     "message": "{cpu_share_pct}% of the measured node time ran on the CPU beside an accelerator",
     "cause": "A split graph costs what its slow side takes. The trace shows kernel time only; the "
              "hand-overs at the borders come on top.",
     "suggestions": [
         {"summary": "See the placement log of the same run for the operators behind it"},
         {"summary": "Compare with a run on the CPU alone"}],
     "refs": [_DOCS]},
    {"id": "ED0504", "severity": "info", "requires": ["session_phase", "profile_summary"],
     "absent": ["few_iterations"],
     "conditions": [{"kind": "session_phase", "field": "ms", "min": 100}],
     "message": "setting the session up took {ms} ms, paid once and not per inference",
     "cause": "Loading and initialization happen once per process. Timing a whole script adds them "
              "to the inference.",
     "suggestions": [
         {"summary": "Time session creation apart, as cold-start cost"},
         {"summary": "Create the session once and reuse it"}],
     "refs": [_DOCS]},
]
