"""Comparison, audits, grounding and report documents."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.functions.vectors import compare_vectors
from faultscope.operators import audit, grounding, report
from faultscope.operators.compare import class_agreement, class_pairs, classify_hosts, output_classes, run_pair_invariance, with_representatives
from faultscope.operators.facts import number_facts, resolve_facts
from faultscope.operators.rules import artifact_profile, cited_facts, diagnose, gather_evidence, match_rules
from faultscope.operators.signatures import match_signatures
from faultscope.operators.traces import trace_facts
from faultscope.operators.verdicts import verdicts
from faultscope.schema import SUGGESTION
from faultscope.sources.artifacts import explode_lines, sidecar_labels
from faultscope.sources.report_files import read_documents, write_documents
from faultscope.staging import new_path, stage
from faultscope.workload.extraction import EXPECTED_DERIVED, derived_rules
from faultscope.workload.registry import flat_map, QUERIES, query, table
from faultscope.workload.relations import BOOK, _HOSTS, hosts
from faultscope.workload.views import ARTIFACTS, BASE, duck, log_facts, v_log, v_trace, with_facts, with_lines, with_rules


def _run(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts, evidence and diagnoses of ``V_LOG``; facts and evidence are stored tables."""
    facts = log_facts(spark, sf_dir)
    fired = stage(match_rules(artifact_profile(facts, BOOK), BOOK), "fired")
    cited = stage(cited_facts(facts, fired, BOOK), "cited")
    evidence = stage(gather_evidence(cited), "evidence")
    return facts, evidence, diagnose(facts, BOOK, fired, evidence, cited=cited)


def _every_fact(spark, sf_dir) -> DataFrame:
    """Facts of ``V_LOG`` and of the traces, both stored tables."""
    traces = stage(trace_facts(stage(v_trace(spark, sf_dir), "trace-events")), "facts")
    return log_facts(spark, sf_dir).unionByName(traces)


# --------------------------------------------------------------- C: comparison


@query("c1_compare_vectors", """
with e as (select vec_id // 2 as pair, vec_id % 2 as side, cast(embedding as double[]) as v from embeddings),
p as (select a.pair, a.v as a, b.v as b from e a join e b on a.pair = b.pair and a.side = 0 and b.side = 1)
select pair, list_max(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))) as max_abs_diff,
  round(list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(a, lambda x: x * x)))
    * sqrt(list_sum(list_transform(b, lambda x: x * x))) + 1e-12), 9) as cosine,
  list_bool_and(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]) <= 0.3 + 0.5 * abs(z[2]))) as allclose
from p""")
def c1_compare_vectors(spark, sf_dir):
    side = F.col("vec_id") % 2
    pairs = (table(spark, sf_dir, "embeddings").groupBy(F.expr("vec_id div 2").alias("pair"))
             .agg(F.max_by("embedding", F.when(side == 0, 1)).alias("a"), F.max_by("embedding", F.when(side == 1, 1)).alias("b"))
             .where("a is not null and b is not null"))
    return (pairs.select("pair", compare_vectors(F.col("a"), F.col("b"), atol=0.3, rtol=0.5).alias("c"))
            .select("pair", "c.max_abs_diff", F.round("c.cosine", 9).alias("cosine"), "c.allclose"))


@query("c2_classify_hosts", f"""
with h as ({_HOSTS}),
p as (select *, machine in ('x86_64', 'AMD64') as x86, machine in ('arm64', 'aarch64') as arm from h)
select host, x86 as is_x86, arm as is_arm, flags <> '' as flags_readable, case when flags <> '' then flags like '%avx2%' end as has_avx2,
  case when flags <> '' then flags like '%avx512%' end as has_avx512, case when flags <> '' then flags like '%vnni%' end as has_vnni,
  case when arm or not x86 then false when flags = '' then null else flags in ('avx2 fma', 'avx512f') end as saturation_possible,
  x86 and flags in ('avx2 fma', 'avx512f') as suitable from p""")
def c2_classify_hosts(spark, sf_dir):
    return classify_hosts(hosts(spark, sf_dir).select("host", "machine", "flags")).drop("machine", "flags", "reason")


@query("c3_baseline_pairs", f"""
with h as ({_HOSTS})
select concat('model-', r.s_nationkey) as model, r.s_suppkey % 2 = 0 as plain, count(*) as pairs, count(distinct b.host) as baselines
from h r join h b on r.s_nationkey = b.s_nationkey and r.s_suppkey % 2 = b.s_suppkey % 2 and r.s_suppkey % 3 = b.s_suppkey % 3 and r.host <> b.host
where b.machine in ('x86_64', 'AMD64') and b.flags in ('avx2 fma', 'avx512f') group by all""")
def c3_baseline_pairs(spark, sf_dir):
    """Both variants apart, the same inputs on both sides, suitable baselines only."""
    pairs = QUERIES["j7_cross_host_pairs"](spark, sf_dir)
    return pairs.groupBy("model", (F.col("variant") == "plain").alias("plain")).agg(
        F.count(F.lit(1)).alias("pairs"), F.countDistinct("baseline_host").alias("baselines"))


_OUTPUTS = f"""
with h as ({_HOSTS}),
o as (select distinct host, concat('model-', s_nationkey % 3) as model, concat('in-', s_suppkey % 2) as inputs, concat('out-', s_suppkey % 7) as output,
        machine in ('x86_64', 'AMD64') and flags in ('avx2 fma', 'avx512f') as suitable from h),
p as (select r.model, r.inputs, r.host, r.output, b.host as baseline_host, b.output as baseline_output
      from o r join o b on r.model = b.model and r.inputs = b.inputs and r.host <> b.host where b.suitable)"""


def _shared_outputs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Runs of few models on many hosts with seven different outputs, and the hosts' verdicts."""
    h = hosts(spark, sf_dir)
    runs = h.select("host", F.concat(F.lit("model-"), F.col("s_nationkey") % 3).alias("model"), F.lit("plain").alias("variant"),
                    F.concat(F.lit("in-"), F.col("s_suppkey") % 2).alias("inputs"), F.concat(F.lit("out-"), F.col("s_suppkey") % 7).alias("output"))
    return runs, classify_hosts(h.select("host", "machine", "flags"))


@query("c3_output_classes", _OUTPUTS + """
select model, inputs, count(*) as pairs, count(*) filter (output = baseline_output) as agree, count(*) filter (output <> baseline_output) as differ from p group by all""")
def c3_output_classes(spark, sf_dir):
    """Agreement of all pairs of hosts, counted from the sizes of classes of equal outputs."""
    runs, verdict = _shared_outputs(spark, sf_dir)
    return class_agreement(output_classes(runs, verdict)).where("pairs > 0").select("model", "inputs", "pairs", "agree", "differ")


@query("j7_class_pairs", _OUTPUTS + """
, least as (select model, inputs, output, min(host) as representative, min(host) filter (suitable) as baseline_representative from o group by all)
select p.model, p.inputs, p.output, p.baseline_output, count(*) as pairs, any_value(l.representative) as representative, any_value(b.baseline_representative) as baseline_representative
from p join least l on l.model = p.model and l.inputs = p.inputs and l.output = p.output
  join least b on b.model = p.model and b.inputs = p.inputs and b.output = p.baseline_output group by p.model, p.inputs, p.output, p.baseline_output""")
def j7_class_pairs(spark, sf_dir):
    """Outputs against outputs of suitable hosts, one row for all host pairs of two classes."""
    runs, verdict = _shared_outputs(spark, sf_dir)
    classes = stage(with_representatives(output_classes(runs, verdict), runs, verdict), "output-classes")
    return class_pairs(classes).drop("variant")


_PAIRS = "(select concat('log-', a, '.log') as l, concat('log-', a + 4, '.log') as r from (select distinct a from b) where a % 8 = 1)"


@query("c4_run_pair_invariance", with_facts(f"""
, p as (select pr.l, pr.r, f.kind, f.payload, row_number() over (partition by pr.l, f.kind order by f.seq) as place, 0 as side
        from {_PAIRS} pr join f on f.artifact = pr.l
  union all select pr.l, pr.r, f.kind, f.payload, row_number() over (partition by pr.l, f.kind order by f.seq), 1 from {_PAIRS} pr join f on f.artifact = pr.r),
m as (select l, r, kind, place, max(payload) filter (side = 0) as pa, max(payload) filter (side = 1) as pb from p group by all)
select l as "left", r as "right", kind, count(*) filter (pa is not distinct from pb) as same, count(*) filter (pa is distinct from pb) as differ,
  kind in ('output_mismatch', 'all_outputs_matched', 'mismatched_outputs') as verdict from m group by all"""))
def c4_run_pair_invariance(spark, sf_dir):
    """Comparison logs two by two."""
    facts = log_facts(spark, sf_dir)
    number = F.regexp_extract("artifact", r"(\d+)", 1).cast("bigint")
    pairs = (v_log(spark, sf_dir).select("artifact").distinct().where(number % 8 == 1)
             .select(F.col("artifact").alias("left"), F.concat(F.lit("log-"), number + 4, F.lit(".log")).alias("right")))
    return run_pair_invariance(facts, pairs, ["output_mismatch", "all_outputs_matched", "mismatched_outputs"])


# ------------------------------------------------------------------- Q: audits


@query("q1_audit_citations", with_lines("""
select family, artifact, concat('f', seq) as id, case when seq % 10 = 0 then 'no such line' else 'other text' end as problem
from n where seq % 10 = 0 or seq % 7 = 0 or lineno = 4"""))
def q1_audit_citations(spark, sf_dir):
    """Facts spoilt on purpose: a wrong line, a changed excerpt, a line that changed later."""
    facts = number_facts(resolve_facts(stage(match_signatures(v_log(spark, sf_dir)), "raw-facts")))
    spoilt = facts.withColumns({
        "source": F.when(F.col("seq") % 10 == 0, F.concat("artifact", F.lit(":99"))).otherwise(F.col("source")),
        "excerpt": F.when(F.col("seq") % 7 == 0, F.concat("excerpt", F.lit("!"))).otherwise(F.col("excerpt"))})
    lines = v_log(spark, sf_dir).withColumn("line", F.when(F.col("lineno") == 4, F.concat("line", F.lit(" later"))).otherwise(F.col("line")))
    return audit.audit_citations(spoilt, lines)


@query("q2_audit_evidence", with_rules("""
, t as (select family, artifact, a, code, max(position) as n from ev group by all)
select family, artifact, code, concat('f', seq) as id, 'cited twice' as problem from ev where position = 1 and a % 3 = 0
union all select family, artifact, code, 'f9999', 'dangling' from t where a % 5 = 0
union all select family, artifact, 'ED0000', null, 'no evidence' from t where code = 'ED0101' """))
def q2_audit_evidence(spark, sf_dir):
    """Evidence spoilt on purpose in every way."""
    facts, evidence, found = _run(spark, sf_dir)
    number = F.regexp_extract("artifact", r"(\d+)", 1).cast("bigint")
    first = evidence.where("position = 1")
    spoilt = evidence.unionByName(first.where(number % 3 == 0)).unionByName(first.where(number % 5 == 0).withColumn("id", F.lit("f9999")))
    bare = found.where("code = 'ED0101'").withColumn("code", F.lit("ED0000"))
    return audit.audit_evidence(found.unionByName(bare), spoilt, facts)


@query("q3_audit_messages", with_rules("""
select family, artifact, code, cast(rank as int) as rank, unnest(list_filter([
  case when code = 'ED0103' or rank = 1 and a % 3 = 0 then 'open placeholder' end, case when rank = 1 and a % 5 = 0 then 'printed list' end,
  case when code = 'ED0404' then 'unknown severity' end,
  case when lag(case when code = 'ED0404' then 9 else srank end) over (partition by a order by rank) > case when code = 'ED0404' then 9 else srank end then 'wrong order' end],
  lambda x: x is not null)) as problem from fired"""))
def q3_audit_messages(spark, sf_dir):
    _, _, found = _run(spark, sf_dir)
    number = F.regexp_extract("artifact", r"(\d+)", 1).cast("bigint")
    spoilt = found.withColumns({
        "message": F.concat("message", F.when((F.col("rank") == 1) & (number % 3 == 0), " {op}").otherwise(""),
                            F.when((F.col("rank") == 1) & (number % 5 == 0), " ['a']").otherwise("")),
        "severity": F.when(F.col("code") == "ED0404", "fatal").otherwise(F.col("severity"))})
    return audit.audit_messages(spoilt)


@query("q4_signature_coverage", f"""
with b as ({duck(BASE)}), g as (select a % 4 as fam, e, count(*) as n from b group by all),
hit(family, signature, fam, e) as (values ('tensorrt', 0, 0, 'view'), ('tensorrt', 5, 0, 'error'), ('tensorrt', 6, 0, 'error'), ('tensorrt', 7, 0, 'click'),
  ('tensorrt', 9, 0, 'signup'), ('polygraphy', 0, 1, 'error'), ('polygraphy', 4, 1, 'purchase'), ('polygraphy', 5, 1, 'view'), ('polygraphy', 10, 1, 'click'),
  ('polygraphy', 12, 1, 'signup'), ('onnxruntime', 1, 2, 'signup'), ('onnxruntime', 3, 2, 'view'), ('onnxruntime', 4, 2, 'purchase'), ('onnxruntime', 13, 2, 'click'),
  ('raspberrypi', 0, 3, 'signup'), ('raspberrypi', 1, 3, 'click'), ('raspberrypi', 4, 3, 'error'), ('raspberrypi', 9, 3, 'view')),
seen as (select distinct family, signature from hit join g on g.fam = hit.fam and g.e = hit.e),
every as (select 'tensorrt' as family, unnest(range(0, 10)) as signature union all select 'polygraphy', unnest(range(0, 15))
  union all select 'onnxruntime', unnest(range(0, 14)) union all select 'raspberrypi', unnest(range(0, 11)))
select every.family, every.signature, case when seen.family is null then 'no line' else 'stale' end as problem
from every left join seen on every.family = seen.family and every.signature = seen.signature
where (seen.family is null and not (every.family = 'tensorrt' and every.signature = 8)) or (every.family = 'raspberrypi' and every.signature = 1 and seen.family is not null)""")
def q4_signature_coverage(spark, sf_dir):
    """Two signatures are awaited, one of them wrongly."""
    awaiting = [("tensorrt", 8), ("raspberrypi", 1)]
    return audit.signature_coverage(v_log(spark, sf_dir), awaiting).drop("kind")


@query("q5_rule_lint", f"""
with {EXPECTED_DERIVED},
checks as (select *, list_filter([case when length(code) <> 6 then 'code format' end,
    case when list_has_any(requires, absent) then 'requires and forbids' end, case when c in (2, 3) then 'condition without bound' end,
    case when c = 4 or (c in (1, 3) and not list_contains(requires, 'kind_a')) then 'condition on foreign kind' end, case when s = 3 then 'no command to apply' end,
    case when s in (1, 2) then 'no suggestion' end, case when r <> 0 then 'no reference' end], lambda x: x is not null) as problems from w)
select family, code, unnest(problems) as problem from checks
union all select min(family), code, 'duplicate code' from w group by code having count(*) > 1
union all select min(family), left(code, 4), 'prefix shared by families' from w where length(code) = 6 group by left(code, 4) having count(distinct family) > 1""")
def q5_rule_lint(spark, sf_dir):
    rules = derived_rules(spark, sf_dir)
    return audit.rule_lint(rules)


@query("q6_rule_payload_coverage", with_facts("""
, keys as (select distinct family, kind, string_split(unnest(string_split(payload, ';')), '=')[1] as key from f where payload not like '%detail%'),
uses(family, code, use, name, kinds) as (values
  ('tensorrt', 'ED0101', 'placeholder', 'op', ['unsupported_op']), ('tensorrt', 'ED0102', 'placeholder', 'node', ['no_implementation']),
  ('tensorrt', 'ED0103', 'placeholder', 'idx', ['parse_error_node']), ('tensorrt', 'ED0105', 'placeholder', 'plugin', ['plugin_not_found']),
  ('polygraphy', 'ED0201', 'placeholder', 'output', ['output_mismatch', 'required_tolerance', 'divergence_metrics', 'tolerance_setting']),
  ('polygraphy', 'ED0202', 'placeholder', 'count', ['mismatched_outputs', 'required_tolerance']), ('polygraphy', 'ED0202', 'placeholder', 'first_output', ['mismatched_outputs', 'required_tolerance']),
  ('polygraphy', 'ED0202', 'condition', 'count', ['mismatched_outputs']), ('polygraphy', 'ED0204', 'placeholder', 'output', ['shape_mismatch', 'shape_detail']),
  ('onnxruntime', 'ED0301', 'placeholder', 'cpu_node_groups', ['split_execution', 'cpu_fallback_ops', 'provider_capability']),
  ('onnxruntime', 'ED0302', 'placeholder', 'requested', ['silent_cpu_only', 'provider_unavailable']), ('onnxruntime', 'ED0303', 'placeholder', 'count', ['cpu_fallback_ops']),
  ('onnxruntime', 'ED0303', 'placeholder', 'first_op', ['cpu_fallback_ops']), ('onnxruntime', 'ED0303', 'condition', 'count', ['cpu_fallback_ops']),
  ('onnxruntime', 'ED0305', 'condition', 'partitions', ['provider_capability']), ('raspberrypi', 'ED0401', 'placeholder', 'conditions', ['throttle_active']),
  ('raspberrypi', 'ED0402', 'placeholder', 'conditions', ['throttle_occurred']), ('raspberrypi', 'ED0403', 'placeholder', 'process', ['oom_kill']),
  ('raspberrypi', 'ED0405', 'placeholder', 'bits', ['throttle_unknown_bits']))
select family, code, use, name from uses where not exists (
  select 1 from keys where keys.family = uses.family and list_contains(uses.kinds, keys.kind) and keys.key = uses.name)"""))
def q6_rule_payload_coverage(spark, sf_dir):
    """Rules of all families over the facts of logs and traces."""
    return audit.rule_payload_coverage(BOOK.table(spark), _every_fact(spark, sf_dir))


@query("q7_rule_activity", with_rules("""
, codes(family, name) as (values ('tensorrt', 'ED0101'), ('tensorrt', 'ED0102'), ('tensorrt', 'ED0103'), ('tensorrt', 'ED0104'), ('tensorrt', 'ED0105'),
  ('polygraphy', 'ED0201'), ('polygraphy', 'ED0202'), ('polygraphy', 'ED0203'), ('polygraphy', 'ED0204'), ('polygraphy', 'ED0205'),
  ('onnxruntime', 'ED0301'), ('onnxruntime', 'ED0302'), ('onnxruntime', 'ED0303'), ('onnxruntime', 'ED0304'), ('onnxruntime', 'ED0305'),
  ('raspberrypi', 'ED0401'), ('raspberrypi', 'ED0402'), ('raspberrypi', 'ED0403'), ('raspberrypi', 'ED0404'), ('raspberrypi', 'ED0405'), ('raspberrypi', 'ED0406')),
asked(family, name) as (values ('tensorrt', 'parse_error_node'), ('tensorrt', 'plugin_not_found'), ('polygraphy', 'divergence_metrics'), ('polygraphy', 'tolerance_setting'),
  ('polygraphy', 'shape_mismatch'), ('polygraphy', 'shape_detail'), ('polygraphy', 'nan_detected'), ('polygraphy', 'inf_detected'), ('polygraphy', 'validation_failed'),
  ('onnxruntime', 'provider_capability'), ('onnxruntime', 'all_nodes_one_provider'), ('onnxruntime', 'session_failed'), ('raspberrypi', 'arm_clock'),
  ('raspberrypi', 'oom_invoked'), ('raspberrypi', 'oom_memory_summary'),
  ('tensorrt', 'unsupported_op'), ('tensorrt', 'no_implementation'), ('tensorrt', 'tactic_skipped'), ('polygraphy', 'output_mismatch'), ('polygraphy', 'all_outputs_matched'),
  ('polygraphy', 'required_tolerance'), ('polygraphy', 'mismatched_outputs'), ('onnxruntime', 'split_execution'), ('onnxruntime', 'cpu_fallback_ops'),
  ('onnxruntime', 'silent_cpu_only'), ('onnxruntime', 'provider_unavailable'), ('onnxruntime', 'session_providers'), ('raspberrypi', 'throttle_active'),
  ('raspberrypi', 'throttle_occurred'), ('raspberrypi', 'soc_temperature'), ('raspberrypi', 'oom_kill'), ('raspberrypi', 'allocation_failed'),
  ('raspberrypi', 'throttle_unknown_bits'), ('raspberrypi', 'throttle_clear'))
select family, name, 'rule never fires' as problem from codes where not exists (select 1 from fired where fired.code = codes.name)
union all select family, name, 'kind never observed' from asked where not exists (select 1 from f where f.family = asked.family and f.kind = asked.name)"""))
def q7_rule_activity(spark, sf_dir):
    """Rules of all families over the facts of logs and traces."""
    facts = _every_fact(spark, sf_dir)
    return audit.rule_activity(BOOK.table(spark), facts, match_rules(artifact_profile(facts, BOOK), BOOK))


@query("q8_corpus_hygiene", """
select concat('doc-', doc_id) as artifact, 'no label' as problem from documents where doc_id not in (select doc_id from labels)
union all select concat('doc-', doc_id), unnest(list_filter([case when quality = 0 then 'lacks root cause' end, case when toxic = 1 then 'lacks outcome' end], lambda x: x is not null)) from labels
union all select concat('doc-', doc_id), 'machine path' from documents where doc_id % 7 = 0 or text like '%/home/%' or text like '%/Users/%'""")
def q8_corpus_hygiene(spark, sf_dir):
    """Documents with sidecars made from ``labels``; some hold a machine path."""
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), "doc_id").alias("artifact"), F.concat("text", F.when(F.col("doc_id") % 7 == 0, " /home/ci/x").otherwise("")).alias("text"))
    sidecars = table(spark, sf_dir, "labels").select(F.lit("sidecar").alias("family"), F.concat(F.lit("doc-"), "doc_id").alias("artifact"), F.concat(
        F.lit("- command: run\n- outcome: "), F.when(F.col("toxic") == 1, "").otherwise("failed"),
        F.lit("\n- root cause (human-verified): "), F.when(F.col("quality") == 0, "").otherwise("known"), F.lit("\n")).alias("text"))
    return audit.corpus_hygiene(docs, sidecar_labels(sidecars))


@query("q9_determinism", with_facts("""
select family, artifact, 'f' || seq as id, 'only in the first run' as problem from f where kind = 'oom_kill'
union all select family, artifact, 'f' || (seq + 1000), 'only in the second run' from f where kind = 'oom_kill'"""))
def q9_determinism(spark, sf_dir):
    """Two runs with different slices, one of them spoilt on purpose: nothing else may differ."""
    first = log_facts(spark, sf_dir)
    raw = stage(match_signatures(v_log(spark, sf_dir).repartition(3), slice_lines=2), "raw-facts")
    from faultscope.operators.derive import derive_facts
    resolved = resolve_facts(raw)
    second = number_facts(resolved).unionByName(derive_facts(resolved))
    spoilt = second.withColumn("id", F.when(F.col("kind") == "oom_kill", F.concat(F.lit("f"), F.col("seq") + 1000)).otherwise(F.col("id")))
    return audit.determinism(first, spoilt)


@query("q10_false_positives", """
select concat('doc-', doc_id) as artifact, 0 as facts, count(*) as secrets
from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where regexp_matches(line, 'token = "[0-9a-f]{40}"') group by doc_id""")
def q10_false_positives(spark, sf_dir):
    """Prose read as each family by turns: no fact may come of it. Secrets that really
    are in the documents are counted."""
    docs = table(spark, sf_dir, "documents")
    family = F.element_at(F.array(*[F.lit(f) for f in ("tensorrt", "polygraphy", "onnxruntime", "raspberrypi")]), (F.col("doc_id") % 4 + 1).cast("int"))
    lines = explode_lines(docs.select(family.alias("family"), F.concat(F.lit("doc-"), "doc_id").alias("artifact"), "text"))
    return audit.false_positive_audit(lines, match_signatures(lines)).select("artifact", "facts", "secrets")


@query("q10_false_positives_turns", """
select family, concat('turn-', conv_id, '-', turn) as artifact, case family when 'raspberrypi' then 2 else 0 end as facts, 1 as secrets
from conversations, (values ('tensorrt'), ('polygraphy'), ('onnxruntime'), ('raspberrypi')) families(family) where conv_id % 7 = 0""")
def q10_false_positives_turns(spark, sf_dir):
    """Turns read as every family. One conversation of seven ends each turn with a host
    reading and a password; the others hold neither facts nor secrets."""
    planted = F.when(F.col("conv_id") % 7 == 0, F.lit("\nthrottled=0x0\npassword=hunter22x")).otherwise("")
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.concat("text", planted))
    lines = explode_lines(turns.select(F.explode(F.array(*[F.lit(f) for f in ("tensorrt", "polygraphy", "onnxruntime", "raspberrypi")])).alias("family"),
                                       F.concat_ws("-", F.lit("turn"), "conv_id", "turn").alias("artifact"), "text"))
    return audit.false_positive_audit(lines, match_signatures(lines)).select("family", "artifact", "facts", "secrets")


# ---------------------------------------------------------------- L: grounding


def proposals(spark, sf_dir) -> DataFrame:
    """One proposal per log, sound or not by its number."""
    a = F.col("a")
    ids = F.when(a % 3 == 0, F.array(F.lit("f1"))).when(a % 3 == 1, F.array(F.lit("f1"), F.lit("f99"))).otherwise(F.array().cast("array<string>"))
    suggestion = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.struct(
        F.when(i == 2, " ").otherwise(F.concat(F.lit("try "), i)).alias("summary"), F.lit("").alias("command"), F.lit("machine-applicable").alias("applicability")))
    base = v_log(spark, sf_dir).select("family", "artifact").distinct().withColumn("a", F.regexp_extract("artifact", r"(\d+)", 1).cast("bigint"))
    return base.select(
        "family", "artifact", F.lit(1).cast("bigint").alias("proposal"), F.when(a % 7 == 0, "  ").otherwise("may be related").alias("message"),
        F.lit("seen once").alias("root_cause"), F.when(a % 2 == 0, "error").when(a % 11 == 0, "fatal").otherwise("info").alias("severity"),
        F.when(a % 9 == 0, F.array(F.lit("f1"), F.lit("f1"))).otherwise(ids).alias("evidence"),
        suggestion.cast(f"array<{SUGGESTION.simpleString()}>").alias("suggestions"), (a % 13 == 0).alias("insufficient_info"))


_GROUNDED = """
, sound as (select g.family, g.artifact, g.a, case when g.a % 2 = 0 then 'error' when g.a % 11 = 0 then 'warning' else 'info' end as severity
  from """ + ARTIFACTS + """ g join f on f.a = g.a and f.seq = 1
  where (g.a % 3 = 0) and g.a % 7 <> 0 and g.a % 13 <> 0 and not exists (select 1 from ev where ev.a = g.a and ev.seq = 1))"""


@query("l1_unmatched_facts", with_rules("select f.family, f.artifact, count(*) as open from f where not exists (select 1 from ev where ev.a = f.a and ev.seq = f.seq) group by all"))
def l1_unmatched_facts(spark, sf_dir):
    facts = log_facts(spark, sf_dir)
    evidence = gather_evidence(cited_facts(facts, match_rules(artifact_profile(facts, BOOK), BOOK), BOOK))
    return grounding.unmatched_facts(facts, evidence).groupBy("family", "artifact").agg(F.count(F.lit(1)).alias("open"))


def _grounded(spark, sf_dir, facts, evidence) -> DataFrame:
    return grounding.ground(proposals(spark, sf_dir), grounding.unmatched_facts(facts, evidence))


@query("l2_ground", with_rules(_GROUNDED + " select family, artifact from sound"))
def l2_ground(spark, sf_dir):
    facts, evidence, _ = _run(spark, sf_dir)
    return _grounded(spark, sf_dir, facts, evidence).select("family", "artifact")


@query("l3_label_synthesized", with_rules(_GROUNDED + """
select family, artifact, 'ED9001' as code, severity, 'f1' as evidence, 'try 1,try 3,try 4' as suggestions, 'maybe-incorrect' as applicability,
  'medium' as confidence, 'llm' as origin from sound"""))
def l3_label_synthesized(spark, sf_dir):
    facts, evidence, _ = _run(spark, sf_dir)
    labelled = grounding.label_synthesized(_grounded(spark, sf_dir, facts, evidence))
    return labelled.select("family", "artifact", "code", "severity", F.array_join("shown", ",").alias("evidence"),
                           F.array_join("suggestions.summary", ",").alias("suggestions"),
                           F.array_join(F.array_distinct("suggestions.applicability"), ",").alias("applicability"), "confidence", "origin")


@query("l4_masked_payload", with_rules("""
, u as (select f.*, row_number() over (partition by f.a order by f.seq) as n from f where
          not exists (select 1 from ev where ev.a = f.a and ev.seq = f.seq))
select family, artifact, seq, concat('- id: f', seq, chr(10), '  kind: ', kind, chr(10), '  observed: what was seen', chr(10),
  '  source: ', artifact, ':', lineno, chr(10), '  log line: user [REDACTED:gitlab-token]') as text, payload as data, 'gitlab-token' as secrets from u"""))
def l4_masked_payload(spark, sf_dir):
    """The text block of every fact of all families, a token in every line. The payload
    inside the block is read back by a JSON parser."""
    facts, evidence, _ = _run(spark, sf_dir)
    open_facts = grounding.unmatched_facts(facts, evidence).withColumns({
        "excerpt": F.lit("user glpat-abcdefghijklmnop"), "summary": F.lit("what was seen")})
    payload = grounding.masked_payload(open_facts)
    parts = F.split("text", "\n  data: ")
    return payload.select("family", "artifact", "seq", parts[0].alias("text"), flat_map(F.from_json(F.coalesce(F.get(parts, F.lit(1)), F.lit("{}")), "map<string,string>")).alias("data"),
                          F.array_join("secrets", ",").alias("secrets"))


@query("l5_merge_synthesized", with_rules(_GROUNDED + f"""
, every as (select family, artifact, a, code, severity, 'rules' as origin from fired union all select family, artifact, a, 'ED9001', severity, 'llm' from sound)
select g.family, g.artifact, count(every.code) as findings, cast(case when bool_or(every.origin = 'rules' and every.severity = 'error') then 2
  when bool_or(every.origin = 'llm' or every.severity = 'warning') then 3 else 0 end as int) as exit_code
from {ARTIFACTS} g left join every on every.a = g.a group by g.family, g.artifact"""))
def l5_merge_synthesized(spark, sf_dir):
    """J8 as well: proposals can move a verdict from 0 to 3 and never to 2."""
    facts, evidence, found = _run(spark, sf_dir)
    merged = grounding.merge_synthesized(found, grounding.label_synthesized(_grounded(spark, sf_dir, facts, evidence)))
    counts = merged.groupBy("family", "artifact").agg(F.count(F.lit(1)).alias("findings"))
    return (verdicts(v_log(spark, sf_dir), merged).join(counts, ["family", "artifact"], "left").fillna(0, ["findings"])
            .select("family", "artifact", "findings", "exit_code"))


@query("j8_union_diagnoses", with_rules(_GROUNDED + """
, last as (select a, max(rank) as n from fired group by a)
select family, artifact, code, cast(rank as int) as rank, 'rules' as origin from fired
union all select sound.family, sound.artifact, 'ED9001', cast(coalesce(last.n, 0) + 1 as int), 'llm' from sound left join last on last.a = sound.a"""))
def j8_union_diagnoses(spark, sf_dir):
    facts, evidence, found = _run(spark, sf_dir)
    merged = grounding.merge_synthesized(found, grounding.label_synthesized(_grounded(spark, sf_dir, facts, evidence)))
    return merged.select("family", "artifact", "code", "rank", "origin")


_REPORTS = with_rules(f"""
, t as (select a, count(*) as facts from f group by a), cc as (select a, count(*) as cited from ev group by a),
dx as (select a, count(*) as n, array_to_string(list(code order by rank), ',') as codes from fired group by a)
select g.family, g.artifact, coalesce(dx.n, 0) as diagnostics, coalesce(dx.codes, '') as codes, coalesce(cc.cited, 0) as cited, coalesce(t.facts, 0) as facts
from {ARTIFACTS} g left join t on t.a = g.a left join cc on cc.a = g.a left join dx on dx.a = g.a""")


@query("s7_report_json", _REPORTS)
def s7_report_json(spark, sf_dir):
    """The lines, read back by a JSON parser: header, diagnostics by rank, citations, facts."""
    facts, evidence, found = _run(spark, sf_dir)
    lines = report.report_json(v_log(spark, sf_dir), stage(report.redact_facts(facts), "masked"), found, evidence)
    schema = "backend string, artifact string, facts bigint, code string, fact string, id string, data map<string, variant>"
    doc = lines.withColumn("d", F.from_json("json", schema, {"mode": "FAILFAST"}))

    def in_section(number: int, field: str):
        return F.count_if((F.col("section") == number) & F.col(f"d.{field}").isNotNull())

    codes = F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == 1, F.struct("at", "d.code")))), lambda x: x["code"])
    return doc.groupBy("family", "artifact").agg(
        in_section(1, "code").alias("diagnostics"), F.array_join(codes, ",").alias("codes"),
        in_section(2, "fact").alias("cited"), in_section(3, "id").alias("facts"))


@query("s7_report_documents", _REPORTS)
def s7_report_documents(spark, sf_dir):
    """One JSON document per artifact, written by many tasks, read back by a JSON parser."""
    facts, evidence, found = _run(spark, sf_dir)
    masked = stage(report.redact_facts(facts), "masked")
    fragments = report.report_fragments(v_log(spark, sf_dir), masked, stage(found, "diagnoses"), evidence)
    manifest = write_documents(fragments, new_path(spark, "reports"))
    schema = """backend string, artifact string, schemaVersion int, redacted boolean, secretsDetected array<string>,
        diagnostics array<struct<code string, evidence array<string>>>, facts array<struct<id string, kind string, data map<string, variant>>>"""
    doc = read_documents(manifest).withColumn("d", F.from_json("document", schema, {"mode": "FAILFAST"}))
    return doc.where("d.schemaVersion = 1 and d.redacted").select(
        F.col("d.backend").alias("family"), F.col("d.artifact").alias("artifact"), F.size("d.diagnostics").alias("diagnostics"),
        F.array_join("d.diagnostics.code", ",").alias("codes"), F.size(F.flatten("d.diagnostics.evidence")).alias("cited"), F.size("d.facts").alias("facts"))
