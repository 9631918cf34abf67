"""Joins, aggregates, traces and rules over the logs and traces made from ``events``."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.families.profile import NAME as TRACE
from faultscope.families.profile import NOTABLE_SHARE
from faultscope.operators import report
from faultscope.operators.compare import baseline_pairs, classify_hosts
from faultscope.operators.derive import derive_facts, first_divergence
from faultscope.operators.grounding import unmatched_facts
from faultscope.operators.rules import (artifact_profile, asks, cited_facts, covers, diagnose, gather_evidence, match_rules, meets,
                                        rank_diagnoses, render_messages, resolve_placeholders, within)
from faultscope.operators.traces import (kernel_cube, kernel_events, profile_rollup, readable_op, rollup_facts,
                                         session_phases, trace_facts)
from faultscope.operators.verdicts import summary_counts, verdicts
from faultscope.sources.rulebook import Rulebook
from faultscope.staging import stage
from faultscope.workload.registry import flat_map, query, table
from faultscope.workload.views import (ARTIFACTS, BASE, MESSAGES, duck, log_facts, resolved_log, v_log, v_trace, with_facts,
                                       with_rules, with_trace)

BOOK = Rulebook.builtin()


def _fired(facts: DataFrame) -> DataFrame:
    return match_rules(artifact_profile(facts, BOOK), BOOK)


def _cited(facts: DataFrame) -> DataFrame:
    return cited_facts(facts, _fired(facts), BOOK)


def _evidence(facts: DataFrame) -> DataFrame:
    return gather_evidence(_cited(facts))


# -------------------------------------------------------------------- J: joins


@query("j1_rules_by_artifact", with_rules("select kinds.family, kinds.artifact, r.code from kinds join r on r.family = kinds.family and list_has_any(kinds.kinds, r.req)"))
def j1_rules_by_artifact(spark, sf_dir):
    """Every rule of the family against every artifact: the pairs that share a kind."""
    profile = artifact_profile(log_facts(spark, sf_dir, staged=False), BOOK)
    rules = BOOK.table(spark).select("family", F.col("id").alias("code"), "need")
    return profile.join(rules, "family").where(meets("kinds", "need")).select("family", "artifact", "code")


@query("j2_requires_all", with_rules("select kinds.family, kinds.artifact, r.code from kinds join r on r.family = kinds.family where list_has_all(kinds.kinds, r.req)"))
def j2_requires_all(spark, sf_dir):
    profile = artifact_profile(log_facts(spark, sf_dir, staged=False), BOOK)
    rules = BOOK.table(spark).select("family", F.col("id").alias("code"), "need")
    return (profile.join(rules, "family").where(asks("need") & covers("kinds", "need"))
            .select("family", "artifact", "code"))


@query("j3_absent_any", with_rules("""
select kinds.family, kinds.artifact, r.code from kinds join r on r.family = kinds.family
where list_has_all(kinds.kinds, r.req) and list_has_any(kinds.kinds, r.absent)"""))
def j3_absent_any(spark, sf_dir):
    """Rules that would fire but for a forbidden kind."""
    profile = artifact_profile(log_facts(spark, sf_dir, staged=False), BOOK)
    rules = BOOK.table(spark).select("family", F.col("id").alias("code"), "need", "bar")
    has = covers("kinds", "need")
    return (profile.join(rules, "family").where(asks("need") & has & meets("kinds", "bar"))
            .select("family", "artifact", "code"))


@query("j4_unmatched_facts", with_rules("select f.family, f.artifact, concat('f', f.seq) as id, f.kind from f where not exists (select 1 from ev where ev.a = f.a and ev.seq = f.seq)"))
def j4_unmatched_facts(spark, sf_dir):
    facts = log_facts(spark, sf_dir)
    return unmatched_facts(facts, _evidence(facts)).select("family", "artifact", "id", "kind")


@query("j5_evidence_lookup", with_rules("""
select ev.family, ev.artifact, ev.code, ev.position, concat('f', ev.seq) as id, ev.kind, f.artifact || ':' || f.lineno as source
from ev join f on f.a = ev.a and f.seq = ev.seq"""))
def j5_evidence_lookup(spark, sf_dir):
    facts = log_facts(spark, sf_dir)
    return report.evidence_lookup(_evidence(facts), facts).select("family", "artifact", "code", "position", "id", "kind", "source")


@query("j6_request_and_outcome", with_facts("""
select artifact, 'CUDAExecutionProvider' as requested, '["CPUExecutionProvider"]' as actual from d where kind = 'silent_cpu_only'"""))
def j6_request_and_outcome(spark, sf_dir):
    d = F.col("data")
    return (derive_facts(resolved_log(spark, sf_dir)).where("kind = 'silent_cpu_only'")
            .select("artifact", d["requested"].alias("requested"), d["actual"].alias("actual")))


_HOSTS = """
select s_suppkey, s_name as host, (['x86_64', 'AMD64', 'arm64', 'aarch64', 'riscv64'])[s_nationkey % 5 + 1] as machine,
  (['', 'sse4_2', 'avx2 fma', 'avx512f', 'avx512f avx512_vnni'])[s_suppkey % 5 + 1] as flags, s_nationkey from supplier"""


def hosts(spark, sf_dir) -> DataFrame:
    machines = F.array(*[F.lit(m) for m in ("x86_64", "AMD64", "arm64", "aarch64", "riscv64")])
    flags = F.array(*[F.lit(f) for f in ("", "sse4_2", "avx2 fma", "avx512f", "avx512f avx512_vnni")])
    text = F.element_at(flags, (F.col("s_suppkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_nationkey", F.col("s_name").alias("host"), F.element_at(machines, F.col("s_nationkey") % 5 + 1).alias("machine"),
        F.when(text != "", F.split(text, " ")).alias("flags"))


@query("j7_cross_host_pairs", f"""
with h as ({_HOSTS}),
o as (select host, machine, flags, concat('model-', s_nationkey) as model, case when s_suppkey % 2 = 0 then 'plain' else 'reduced' end as variant,
        concat('in-', s_suppkey % 3) as inputs, concat('out-', s_suppkey) as output from h)
select r.model, r.variant, r.inputs, r.host, b.host as baseline_host, r.output, b.output as baseline_output
from o r join o b on r.model = b.model and r.variant = b.variant and r.inputs = b.inputs and r.host <> b.host
where b.machine in ('x86_64', 'AMD64') and b.flags in ('avx2 fma', 'avx512f')""")
def j7_cross_host_pairs(spark, sf_dir):
    """C3 as well: only certainly suitable hosts give baselines, and never for themselves."""
    h = hosts(spark, sf_dir)
    outputs = h.select("host", F.concat(F.lit("model-"), "s_nationkey").alias("model"),
                       F.when(F.col("s_suppkey") % 2 == 0, "plain").otherwise("reduced").alias("variant"),
                       F.concat(F.lit("in-"), F.col("s_suppkey") % 3).alias("inputs"), F.concat(F.lit("out-"), "s_suppkey").alias("output"))
    return baseline_pairs(outputs, outputs, classify_hosts(h.select("host", "machine", "flags")))


_RANKED = with_rules("select family, artifact, code, severity, cast(rank as int) as rank from fired")


@query("j9_rank_diagnoses", _RANKED)
def j9_rank_diagnoses(spark, sf_dir):
    return rank_diagnoses(_fired(log_facts(spark, sf_dir))).select("family", "artifact", "code", "severity", "rank")


@query("j10_evidence_shown", with_rules("""
select ev.family, ev.artifact, ev.code, cast(ev.position as int) as shown, concat('f', ev.seq) as id, f.artifact || ':' || f.lineno as source,
  greatest(t.n - 4, 0) as hidden
from ev join f on f.a = ev.a and f.seq = ev.seq join (select a, code, count(*) as n from ev group by all) t on t.a = ev.a and t.code = ev.code
where ev.position <= 4"""))
def j10_evidence_shown(spark, sf_dir):
    facts = stage(log_facts(spark, sf_dir), "facts")
    return report.evidence_shown(stage(_evidence(facts), "evidence"), facts).drop("excerpt")


@query("j11_distinct_evidence", with_rules("select family, artifact, code, count(*) as cited, count(distinct seq) as ids from ev group by all"))
def j11_distinct_evidence(spark, sf_dir):
    """A kind in both lists of a rule counts once, so ids and citations are as many."""
    return _evidence(log_facts(spark, sf_dir)).groupBy("family", "artifact", "code").agg(
        F.count(F.lit(1)).alias("cited"), F.countDistinct("id").alias("ids"))


# -------------------------------------------------------------- A: aggregates


def _derived(kind: str):
    def run(spark, sf_dir):
        return (derive_facts(resolved_log(spark, sf_dir)).where(F.col("kind") == kind)
                .select("artifact", "seq", "source", flat_map("data").alias("payload")))
    return run


for _name, _kind in (("a1_split_execution", "split_execution"), ("a2_cpu_fallback_ops", "cpu_fallback_ops"), ("a3_silent_cpu_only", "silent_cpu_only")):
    query(_name, with_facts(f"select artifact, seq, artifact || ':' || lineno as source, payload from d where kind = '{_kind}'"))(_derived(_kind))


@query("a4_session_phases", with_trace("select artifact, idx, name as phase, dur as us, dur / 1000 as ms from s"))
def a4_session_phases(spark, sf_dir):
    return session_phases(v_trace(spark, sf_dir)).drop("dur_text")


@query("a5_kernel_events", with_trace("select artifact, idx, node, op, provider, dur from t where dur >= 0"))
def a5_kernel_events(spark, sf_dir):
    return kernel_events(v_trace(spark, sf_dir))


def _rollup(spark, sf_dir) -> DataFrame:
    return profile_rollup(kernel_cube(kernel_events(v_trace(spark, sf_dir))))


def _trace_kind(spark, sf_dir, kind: str) -> DataFrame:
    return rollup_facts(_rollup(spark, sf_dir)).where(F.col("kind") == kind)


def _numbers(*keys: str):
    return [F.col("data")[k].cast("bigint").alias(k) for k in keys]


@query("a6_profile_summary", with_trace("""
select artifact, total as total_node_us, nodes as unique_nodes, iterations, ops as op_types from total join iter using (artifact)"""))
def a6_profile_summary(spark, sf_dir):
    df = _trace_kind(spark, sf_dir, "profile_summary")
    return df.select("artifact", *_numbers("total_node_us", "unique_nodes", "iterations", "op_types"))


@query("a7_few_iterations", with_trace("select artifact, iterations from iter where iterations < 3"))
def a7_few_iterations(spark, sf_dir):
    df = _trace_kind(spark, sf_dir, "few_iterations")
    return df.select("artifact", *_numbers("iterations"))


@query("a8_op_cost", with_trace(f"""
select artifact, op, us, us / 1000 as ms, us / total as share, calls, cost.nodes as distinct_nodes, cost.first_idx
from cost join total using (artifact) where us / total >= {NOTABLE_SHARE}"""))
def a8_op_cost(spark, sf_dir):
    return (_rollup(spark, sf_dir).where((F.col("level") == "op") & (F.col("us") / F.nullif("total_us", F.lit(0)) >= NOTABLE_SHARE))
            .select("artifact", F.col("item").alias("op"), "us", (F.col("us") / 1000).alias("ms"), (F.col("us") / F.col("total_us")).alias("share"),
                    "calls", F.col("nodes").alias("distinct_nodes"), "first_idx"))


@query("a9_provider_time_split", with_trace("""
select artifact, providers as provider_count, cpu as cpu_us, concat('{"AccelExecutionProvider":', total - cpu, ',"CPUExecutionProvider":', cpu, '}') as providers
from total where providers > 1"""))
def a9_provider_time_split(spark, sf_dir):
    df = _trace_kind(spark, sf_dir, "provider_time_split")
    return df.select("artifact", *_numbers("provider_count", "cpu_us"), F.col("data")["providers"].alias("providers"))


@query("a10_slowest_node", with_trace("""
select artifact, idx, node, op, provider, dur as us from (
  select *, row_number() over (partition by artifact order by dur desc, idx) as r from t join total using (artifact) where total > 0) where r = 1"""))
def a10_slowest_node(spark, sf_dir):
    df = _trace_kind(spark, sf_dir, "slowest_node")
    d = F.col("data")
    return df.select("artifact", F.regexp_extract("anchor", r"\[(\d+)\]", 1).cast("bigint").alias("idx"), d["node"].alias("node"),
                     d["op"].alias("op"), d["provider"].alias("provider"), *_numbers("us"))


@query("a11_readable_op", f"""
with b as ({duck(BASE)})
select a, lineno, case k % 5 when 0 then concat('CoreML compiled subgraph #', k) when 1 then concat('Accel compiled subgraph #', k)
  when 2 then concat('a_', k + 1000000, '_b') when 3 then concat('123_', k) else e end as label from b""")
def a11_readable_op(spark, sf_dir):
    k = F.col("k")
    name = (F.when(k % 5 == 0, F.concat(F.lit("4823901_CoreML_4823901_"), k))
            .when(k % 5 == 1, F.concat(F.lit("AccelExecutionProvider_4823901_Accel_4823901_"), k, F.lit("_0")))
            .when(k % 5 == 2, F.concat(F.lit("a_"), k + 1000000, F.lit("_b"))).when(k % 5 == 3, F.concat(F.lit("123_"), k)).otherwise(F.col("e")))
    return spark.sql(BASE, events=table(spark, sf_dir, "events")).select("a", "lineno", readable_op(name).alias("label"))


@query("trace_facts", with_trace(f"""
, parts as (
  select artifact, 0 as o, 0 as us, 0 as first_idx, 'profile_summary' as kind, 'summary' as anchor from total
  union all select artifact, 1, 0, 0, 'few_iterations', 'summary' from iter where iterations < 3
  union all select artifact, 2, -us, cost.first_idx, 'op_cost', concat('op:', op) from cost join total using (artifact) where us / total >= {NOTABLE_SHARE}
  union all select artifact, 3, 0, 0, 'provider_time_split', 'summary' from total where providers > 1
  union all select artifact, 4, 0, 0, 'slowest_node', concat('events[', idx, ']') from (
    select *, row_number() over (partition by artifact order by dur desc, idx) as r from t join total using (artifact) where total > 0) where r = 1),
sn as (select artifact, count(*) as n from s group by artifact)
select artifact, seq, 'session_phase' as kind, concat(artifact, ':events[', idx, ']') as source from s
union all
select parts.artifact, coalesce(sn.n, 0) + row_number() over (partition by parts.artifact order by o, us, first_idx), kind, concat(parts.artifact, ':', anchor)
from parts left join sn using (artifact)"""))
def all_trace_facts(spark, sf_dir):
    """Numbers and citations of all facts of all traces."""
    return trace_facts(stage(v_trace(spark, sf_dir), "trace-events")).select("artifact", "seq", "kind", "source")


@query("trace_diagnose", with_trace("""
, k as (select artifact, total, cpu, providers, iterations, coalesce(m.top, 0) as top, coalesce(x.ms, 0) as ms from total join iter using (artifact)
  left join (select artifact, max(us) as top from cost group by artifact) m using (artifact)
  left join (select artifact, max(dur) / 1000 as ms from s group by artifact) x using (artifact))
select artifact, 'ED0501' as code, 'info' as severity from k where iterations >= 3 and round(top / total * 100, 2) >= 50
union all select artifact, 'ED0502', 'warning' from k where iterations < 3
union all select artifact, 'ED0503', 'warning' from k where iterations >= 3 and providers > 1 and round(cpu / total * 100, 2) >= 10
union all select artifact, 'ED0504', 'info' from k where iterations >= 3 and ms >= 100"""))
def trace_diagnose(spark, sf_dir):
    facts = stage(trace_facts(stage(v_trace(spark, sf_dir), "trace-events")), "facts")
    return _fired(facts).where(F.col("family") == TRACE).select("artifact", "code", "severity")


@query("a12_summary_counts", with_rules(f"""
select g.family, g.artifact, count(fired.code) filter (fired.severity = 'error') as errors, count(fired.code) filter (fired.severity = 'warning') as warnings,
  count(fired.code) filter (fired.severity = 'info') as infos, 0 as other, coalesce(any_value(t.n), 0) as facts
from {ARTIFACTS} g left join fired on fired.a = g.a left join (select a, count(*) as n from f group by a) t on t.a = g.a group by g.family, g.artifact"""))
def a12_summary_counts(spark, sf_dir):
    facts = log_facts(spark, sf_dir)
    return summary_counts(v_log(spark, sf_dir), _fired(facts), facts)


@query("a13_verdicts", with_rules(f"""
select g.family, g.artifact, cast(case when bool_or(fired.severity = 'error') then 2 when bool_or(fired.severity = 'warning') then 3 else 0 end as int) as exit_code
from {ARTIFACTS} g left join fired on fired.a = g.a group by g.family, g.artifact"""))
def a13_verdicts(spark, sf_dir):
    return verdicts(v_log(spark, sf_dir), _fired(log_facts(spark, sf_dir)).withColumn("origin", F.lit("rules")))


@query("a14_secret_kinds", with_facts("""
select family, artifact, array_to_string(list_sort(list_distinct(list_concat(
  case when bool_or(seq % 2 = 0) then ['gitlab-token'] else []::varchar[] end, case when bool_or(seq % 3 = 0) then ['assigned-secret'] else [] end))), ',') as secrets
from f where seq % 2 = 0 or seq % 3 = 0 group by all"""))
def a14_secret_kinds(spark, sf_dir):
    """Tokens planted into excerpts and payloads by fact number."""
    planted = log_facts(spark, sf_dir).withColumns({
        "excerpt": F.when(F.col("seq") % 2 == 0, "x glpat-abcdefghijklmnop").otherwise("clean"),
        "data": F.map_concat(F.create_map(F.lit("note"), F.when(F.col("seq") % 3 == 0, "api_key=abcdef").otherwise("ok")), F.col("data"))})
    return report.secret_kinds_of(report.redact_facts(planted)).select("family", "artifact", F.array_join("secrets", ",").alias("secrets"))


@query("a15_first_divergence", with_facts("""
select family, artifact, arg_min(concat('t', k), seq) filter (kind = 'mismatched_outputs') as first_listed,
  case when bool_or(kind = 'mismatched_outputs') then 2 end as listed,
  arg_min(concat('t', k), seq) filter (kind = 'output_mismatch') as first_mismatch, count(distinct k) filter (kind = 'output_mismatch') as diverged
from f where kind in ('mismatched_outputs', 'output_mismatch') group by all"""))
def a15_first_divergence(spark, sf_dir):
    return first_divergence(log_facts(spark, sf_dir))


# ------------------------------------------------------------------- R: rules


@query("r2_conditions_met", """
select event_id, case k % 7 when 0 then value between 10 and 50 when 4 then true else false end as met
from (select event_id, value, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events)""")
def r2_conditions_met(spark, sf_dir):
    """Bounds 10 to 50 on texts: numbers, nan, infinity, a type suffix, an exponent, nothing."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    text = (F.when(k % 7 == 0, F.col("value").cast("string")).when(k % 7 == 1, "nan").when(k % 7 == 2, "Infinity").when(k % 7 == 3, "15d")
            .when(k % 7 == 4, " 1.5e1 ").when(k % 7 == 5, ""))
    return table(spark, sf_dir, "events").select("event_id", within(text, 10.0, 50.0).alias("met"))


@query("r3_match_rules", with_rules("select family, artifact, code, severity from fired"))
def r3_match_rules(spark, sf_dir):
    return _fired(log_facts(spark, sf_dir)).select("family", "artifact", "code", "severity")


@query("r4_gather_evidence", with_rules("select family, artifact, code, position, concat('f', seq) as id, kind from ev"))
def r4_gather_evidence(spark, sf_dir):
    return _evidence(log_facts(spark, sf_dir)).drop("seq")


@query("r5_resolve_placeholders", with_rules("""
, p as (select * from ev where position = 1)
select family, artifact, code, key, value from (
  select family, artifact, code, unnest(case code when 'ED0101' then ['op'] when 'ED0102' then ['node'] when 'ED0201' then ['output']
      when 'ED0202' then ['count', 'first_output'] when 'ED0301' then ['cpu_node_groups'] when 'ED0302' then ['requested'] when 'ED0303' then ['count', 'first_op']
      when 'ED0401' then ['conditions'] when 'ED0402' then ['conditions'] when 'ED0403' then ['process'] when 'ED0405' then ['bits'] else [] end) as key,
    unnest(case code when 'ED0101' then [concat('ns.Op', k)] when 'ED0102' then [concat('/n', k)] when 'ED0201' then [concat('t', k)]
      when 'ED0202' then ['2', concat('t', k)] when 'ED0301' then [cast(cnt as varchar)] when 'ED0302' then ['CUDAExecutionProvider']
      when 'ED0303' then [cast(cnt as varchar), first_op]
      when 'ED0401' then [(['undervoltage detected', 'Arm frequency capped', 'currently throttled', 'soft temperature limit active'])[bit + 1]]
      when 'ED0402' then [(['undervoltage has occurred', 'Arm frequency capping has occurred', 'throttling has occurred', 'soft temperature limit has occurred'])[bit - 15]]
      when 'ED0403' then ['worker'] when 'ED0405' then [cast(bit as varchar)] else [] end) as value from p)"""))
def r5_resolve_placeholders(spark, sf_dir):
    return resolve_placeholders(_cited(log_facts(spark, sf_dir)))


@query("r6_render_messages", with_rules(f"select family, artifact, code, {MESSAGES} as message from ev where position = 1"))
def r6_render_messages(spark, sf_dir):
    facts = log_facts(spark, sf_dir)
    fired = stage(_fired(facts), "fired")
    return render_messages(fired, resolve_placeholders(cited_facts(facts, fired, BOOK)), BOOK)


@query("r7_diagnose", with_rules(f"""
select ev.family, ev.artifact, cast(fired.rank as int) as rank, ev.code, ev.severity, {MESSAGES.replace("case code", "case ev.code")} as message, t.n as cited, t.head as shown,
  'high' as confidence, false as insufficient_info, 'rules' as origin
from ev join fired on fired.a = ev.a and fired.code = ev.code
join (select a, code, count(*) as n, array_to_string(list(concat('f', seq) order by position) filter (position <= 4), ',') as head from ev group by all) t
  on t.a = ev.a and t.code = ev.code
where ev.position = 1"""))
def r7_diagnose(spark, sf_dir):
    facts = log_facts(spark, sf_dir)
    fired = stage(_fired(facts), "fired")
    cited = stage(cited_facts(facts, fired, BOOK), "cited")
    found = diagnose(facts, BOOK, fired, stage(gather_evidence(cited), "evidence"), cited=cited)
    return found.drop("root_cause", "suggestions", "proposal").withColumn("shown", F.array_join("shown", ","))
