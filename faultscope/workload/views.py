"""Vendor artifacts made from the ``events`` table.

``V_LOG`` is portable SQL: four log lines per artifact in four families. The
oracles never read those lines. They compute the expected facts straight from
the event type ``e`` and the number ``k``, so they check extraction without a
regular expression.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultscope.operators.derive import derive_facts
from faultscope.operators.facts import number_facts, resolve_facts
from faultscope.operators.signatures import match_signatures
from faultscope.staging import stage
from faultscope.workload.registry import table

BASE = """
  select cast(floor(event_id / 4) as bigint) as a, cast(event_id % 4 + 1 as bigint) as lineno,
         event_type as e, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k
  from {events}"""

V_LOG = f"""
with b as ({BASE})
select case a % 4 when 0 then 'tensorrt' when 1 then 'polygraphy' when 2 then 'onnxruntime' else 'raspberrypi' end as family,
  concat('log-', a, '.log') as artifact, lineno, e, k,
  case a % 4
    when 0 then case e
      when 'signup' then concat('[I] TensorRT version: 10.', k % 10, '.0')
      when 'error'  then concat('[E] [TRT] Error Code 10: Internal Error (Could not find any implementation for node /n', k, '.)')
      when 'click'  then concat('[W] [TRT] Skipping tactic ', k, ' due to insufficient memory')
      when 'view'   then concat('[I] [TRT] No importer registered for op: ns.Op', k, '. Attempting to import as plugin.')
      else concat('[I] step ', k) end
    when 1 then case e
      when 'signup' then concat('[I]     Comparing Output: ', chr(39), 't', k, chr(39), ' (dtype=float32, shape=(1, ', k, '))')
      when 'error'  then concat('[E]         FAILED | Output: ', chr(39), 't', k, chr(39), ' | Difference exceeds tolerance (rel=1e-05, abs=1e-05)')
      when 'click'  then concat('[I]             Minimum Required Tolerance: elemwise error | [abs=0.', k, '] OR [rel=1.', k, ']')
      when 'view'   then concat('[I]     PASSED | All outputs matched | Outputs: [', chr(39), 't', k, chr(39), ']')
      else concat('[E]     FAILED | Mismatched outputs: [', chr(39), 't', k, chr(39), ', ', chr(39), 'u', k, chr(39), ']') end
    when 2 then case e
      when 'signup' then concat('[V] VerifyEachNodeIsAssignedToAnEp]  Node(s) placed on [CoreMLExecutionProvider]. Number of nodes: ', k)
      when 'error'  then concat('[V] VerifyEachNodeIsAssignedToAnEp]  Node(s) placed on [CPUExecutionProvider]. Number of nodes: ', k)
      when 'click'  then concat('[V] VerifyEachNodeIsAssignedToAnEp]   Op', k, ' (Op', k, '_0)')
      when 'view'   then concat('Specified provider ', chr(39), 'CUDAExecutionProvider', chr(39), ' is not in available provider names.Available providers: ', chr(39), 'AzureExecutionProvider, CPUExecutionProvider', chr(39))
      else 'SESSION_PROVIDERS: CPUExecutionProvider' end
    else case e
      when 'signup' then concat('throttled=', cast(pow(2, k % 20) as bigint))
      when 'error'  then concat('oom-killer: Out of memory: Killed process ', k, ' (worker)')
      when 'click'  then concat('temp=', k, '.5', chr(39), 'C')
      when 'view'   then concat('Failed to allocate memory for requested buffer of size ', cast(k as bigint) * 1048576)
      else 'throttled=0x0' end
  end as line
from b"""

# One trace per user. ``idx`` is the event id: unique and in order is all it must be.
V_TRACE = """
select concat('trace-', u, '.json') as artifact, event_id as idx, e as op,
       concat(e, '_', k % (10 + 3 * (u % 20))) as node,
       case when (k + u) % (2 + u % 12) = 0 then 'CPUExecutionProvider' else 'AccelExecutionProvider' end as provider,
       cast(floor(value * 100) as bigint) * (case when e = 'error' then 1 + u % 8 else 1 end) as dur
from (select event_id, user_id as u, event_type as e, value,
             cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from {events}) t"""

V_SESSION = """
select concat('trace-', user_id, '.json') as artifact, event_id as idx,
       case cast(regexp_extract(props, '([0-9]+)', 1) as int) % 4 when 0 then 'session_initialization'
         when 1 then 'model_loading_uri' when 2 then 'model_loading_array' else 'session_run' end as name,
       cast(floor(value * 1000) as bigint) as dur
from {events} where event_type = 'signup'"""


def duck(sql: str) -> str:
    """A view's text for DuckDB."""
    return sql.replace("{events}", "events")


def v_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(family, artifact, lineno, line)``."""
    return spark.sql(V_LOG, events=table(spark, sf_dir, "events")).select("family", "artifact", "lineno", "line")


def v_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel and session events of all traces, typed."""
    events = table(spark, sf_dir, "events")
    kernels = spark.sql(V_TRACE, events=events).select(
        "artifact", "idx", F.lit("Node").alias("cat"), F.concat("node", F.lit("_kernel_time")).alias("name"), "dur", "op", "provider")
    session = spark.sql(V_SESSION, events=events).select(
        "artifact", "idx", F.lit("Session").alias("cat"), "name", "dur",
        F.lit(None).cast("string").alias("op"), F.lit(None).cast("string").alias("provider"))
    both = kernels.unionByName(session)
    return both.withColumns({"dur_text": F.col("dur").cast("string"), "dur_ok": F.col("dur") >= 0})


def resolved_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved line facts of ``V_LOG``; the raw facts are staged, so lines are read once."""
    return resolve_facts(stage(match_signatures(v_log(spark, sf_dir)), "raw-facts"))


def log_facts(spark: SparkSession, sf_dir: str, staged: bool = True) -> DataFrame:
    """All facts of ``V_LOG``, staged because rules read them several times. What reads them
    once, and few of their columns, takes them unstaged."""
    resolved = resolved_log(spark, sf_dir)
    facts = number_facts(resolved).unionByName(derive_facts(resolved))
    return stage(facts, "facts") if staged else facts


# ---------------------------------------------------------------- oracle texts

_FAMILY = "case a % 4 when 0 then 'tensorrt' when 1 then 'polygraphy' when 2 then 'onnxruntime' else 'raspberrypi' end"
_LIVE = "['undervoltage', 'freq_capped', 'throttled', 'soft_temp_limit']"
_LIVE_TEXT = "['undervoltage detected', 'Arm frequency capped', 'currently throttled', 'soft temperature limit active']"
_STICKY_TEXT = ("['undervoltage has occurred', 'Arm frequency capping has occurred', 'throttling has occurred', "
                "'soft temperature limit has occurred']")

# c: lines with the context the family carries. x: expected line facts, no regex.
EXPECTED_LINES = f"""
b as ({duck(BASE)}),
c as (
  select *, {_FAMILY} as family, concat('log-', a, '.log') as artifact, k % 20 as bit,
    last_value(case when a % 4 = 1 and e = 'signup' then concat('t', k)
                    when a % 4 = 2 and e = 'signup' then 'CoreMLExecutionProvider'
                    when a % 4 = 2 and e = 'error' then 'CPUExecutionProvider' end ignore nulls)
      over (partition by a order by lineno rows between unbounded preceding and current row) as ctx
  from b),
x as (
  select family, artifact, a, lineno, 0 as ord, e, k, bit, ctx,
    case a % 4
      when 0 then case e when 'signup' then 'trt_version' when 'error' then 'no_implementation' when 'click' then 'tactic_skipped'
                         when 'view' then 'unsupported_op' end
      when 1 then case e when 'signup' then 'compared_output' when 'error' then 'output_mismatch' when 'click' then 'required_tolerance'
                         when 'view' then 'all_outputs_matched' else 'mismatched_outputs' end
      when 2 then case e when 'signup' then 'node_placement' when 'error' then 'node_placement' when 'click' then
                         case when ctx is not null then 'node_on_provider' end
                         when 'view' then 'provider_unavailable' else 'session_providers' end
      else case e when 'signup' then 'throttled_bitfield' when 'error' then 'oom_kill' when 'click' then 'soc_temperature'
                  when 'view' then 'allocation_failed' else 'throttled_bitfield' end end as kind,
    case a % 4
      when 0 then case e when 'signup' then concat('version=10.', k % 10, '.0') when 'error' then concat('node=/n', k)
                         when 'click' then concat('reason=insufficient memory;tactic=', k) else concat('op=ns.Op', k) end
      when 1 then case e
        when 'signup' then concat('dtype=float32;output=t', k, ';shape=1, ', k)
        when 'error' then concat('atol=1e-05;output=t', k, ';rtol=1e-05')
        when 'click' then concat(coalesce('output=' || ctx || ';', ''), 'req_abs=0.', k, ';req_rel=1.', k, ';stat=elemwise')
        when 'view' then concat('count=1;first_output=t', k, coalesce(';output=' || ctx, ''), ';outputs=["t', k, '"]')
        else concat('count=2;first_output=t', k, coalesce(';output=' || ctx, ''), ';outputs=["t', k, '","u', k, '"]') end
      when 2 then case e
        when 'signup' then concat('count=', k, ';provider=CoreMLExecutionProvider')
        when 'error' then concat('count=', k, ';provider=CPUExecutionProvider')
        when 'click' then concat('node=Op', k, '_0;op=Op', k, ';provider=', ctx)
        when 'view' then 'available=["AzureExecutionProvider","CPUExecutionProvider"];requested=CUDAExecutionProvider'
        else 'providers=["CPUExecutionProvider"]' end
      else case e
        when 'signup' then concat('dec=', cast(pow(2, bit) as bigint), ';healthy=false;hex=0x', upper(to_hex(cast(pow(2, bit) as bigint))),
          ';live=', case when bit < 4 then concat('["', ({_LIVE})[bit + 1], '"]') else '[]' end,
          ';raw=', cast(pow(2, bit) as bigint),
          ';sticky=', case when bit > 15 then concat('["', ({_LIVE})[bit - 15], '_occurred"]') else '[]' end,
          ';unknown_bits=', case when bit between 4 and 15 then concat('[', bit, ']') else '[]' end)
        when 'error' then concat('pid=', k, ';process=worker')
        when 'click' then concat('celsius=', k, '.5')
        when 'view' then concat('bytes=', cast(k as bigint) * 1048576, ';mib=', k, '.0')
        else 'healthy=true;hex=0x0;live=[];raw=0;sticky=[];unknown_bits=[]' end end as payload
  from c
  union all
  select family, artifact, a, lineno, case when bit < 4 then 1 when bit > 15 then 2 else 3 end, e, k, bit, ctx,
    case when bit < 4 then 'throttle_active' when bit > 15 then 'throttle_occurred' else 'throttle_unknown_bits' end,
    case when bit < 4 then concat('condition_keys=["', ({_LIVE})[bit + 1], '"];conditions=', ({_LIVE_TEXT})[bit + 1], ';count=1')
         when bit > 15 then concat('condition_keys=["', ({_LIVE})[bit - 15], '_occurred"];conditions=', ({_STICKY_TEXT})[bit - 15], ';count=1')
         else concat('bit_numbers=[', bit, '];bits=', bit) end || ';hex=0x' || upper(to_hex(cast(pow(2, bit) as bigint)))
  from c where a % 4 = 3 and e = 'signup'
  union all
  select family, artifact, a, lineno, 4, e, k, bit, ctx, 'throttle_clear', 'hex=0x0' from c where a % 4 = 3 and e = 'purchase'),
n as (select *, cast(row_number() over (partition by a order by lineno, ord) as bigint) as seq from x where kind is not null)"""

# d: derived facts of session logs. f: all facts of V_LOG.
EXPECTED_FACTS = EXPECTED_LINES + """,
o as (
  select family, artifact, a, count(*) as line_facts,
    count(distinct case when kind = 'node_placement' then e end) as n_providers,
    count(*) filter (kind = 'node_placement' and e = 'error') as n_cpu_placements,
    coalesce(sum(k) filter (kind = 'node_placement' and e = 'error'), 0) as cpu_groups,
    min(lineno) filter (kind = 'node_placement') as placed_at,
    count(*) filter (kind = 'node_on_provider' and ctx = 'CPUExecutionProvider') as cpu_nodes,
    list_sort(list_distinct(list(concat('Op', k)) filter (kind = 'node_on_provider' and ctx = 'CPUExecutionProvider'))) as cpu_ops,
    arg_min(concat('Op', k), lineno) filter (kind = 'node_on_provider' and ctx = 'CPUExecutionProvider') as first_op,
    min(lineno) filter (kind = 'node_on_provider' and ctx = 'CPUExecutionProvider') as cpu_node_at,
    min(lineno) filter (kind = 'provider_unavailable') as missing_at,
    count(*) filter (kind = 'session_providers') as sessions
  from n where family = 'onnxruntime' group by all),
d0 as (
  select family, artifact, a, line_facts, 1 as p, 'split_execution' as kind, placed_at as lineno, cpu_groups as cnt,
    concat('accelerators=["CoreMLExecutionProvider"];cpu_node_groups=', cpu_groups,
           ';providers=["CPUExecutionProvider","CoreMLExecutionProvider"]') as payload, null as first_op
  from o where n_providers > 1 and n_cpu_placements > 0
  union all
  select family, artifact, a, line_facts, 2, 'cpu_fallback_ops', cpu_node_at, cpu_nodes,
    concat('count=', cpu_nodes, ';distinct_ops=', len(cpu_ops), ';first_op=', first_op, ';ops=["', array_to_string(cpu_ops, '","'), '"]'), first_op
  from o where cpu_nodes > 0 and n_providers > 1
  union all
  select family, artifact, a, line_facts, 3, 'silent_cpu_only', missing_at, 0,
    'actual=["CPUExecutionProvider"];requested=CUDAExecutionProvider', null
  from o where missing_at is not null and sessions > 0),
d as (select *, line_facts + row_number() over (partition by a order by p) as seq from d0),
f as (
  select family, artifact, a, lineno, seq, kind, payload, e, k, bit, ctx,
    cast(case kind when 'mismatched_outputs' then 2 when 'all_outputs_matched' then 1 end as bigint) as cnt, cast(null as varchar) as first_op
  from n
  union all
  select family, artifact, a, lineno, seq, kind, payload, null, null, null, null, cnt, first_op from d)"""

# r: the rules that V_LOG can fire. fired and ev: what must fire and what it cites.
EXPECTED_RULES = EXPECTED_FACTS + """,
r(family, code, severity, srank, ord, req, absent, opt, cond_kind, cond_min) as (values
  ('tensorrt', 'ED0101', 'error', 0, 0, ['unsupported_op'], []::varchar[], []::varchar[], null, null),
  ('tensorrt', 'ED0102', 'error', 0, 1, ['no_implementation'], [], [], null, null),
  ('tensorrt', 'ED0104', 'warning', 1, 3, ['tactic_skipped'], [], [], null, null),
  ('polygraphy', 'ED0201', 'error', 0, 0, ['output_mismatch'], ['all_outputs_matched'], ['required_tolerance', 'divergence_metrics', 'tolerance_setting'], null, null),
  ('polygraphy', 'ED0202', 'error', 0, 1, ['mismatched_outputs'], ['shape_mismatch'], ['required_tolerance'], 'mismatched_outputs', 2),
  ('polygraphy', 'ED0205', 'info', 2, 4, ['all_outputs_matched'], ['output_mismatch', 'nan_detected'], ['required_tolerance', 'divergence_metrics', 'tolerance_setting'], null, null),
  ('onnxruntime', 'ED0301', 'warning', 1, 0, ['split_execution'], [], ['cpu_fallback_ops', 'provider_capability'], null, null),
  ('onnxruntime', 'ED0302', 'error', 0, 1, ['silent_cpu_only'], [], ['provider_unavailable', 'session_providers', 'all_nodes_one_provider'], null, null),
  ('onnxruntime', 'ED0303', 'warning', 1, 2, ['cpu_fallback_ops'], ['silent_cpu_only'], ['provider_capability', 'split_execution'], 'cpu_fallback_ops', 3),
  ('raspberrypi', 'ED0401', 'error', 0, 0, ['throttle_active'], [], ['soc_temperature', 'arm_clock'], null, null),
  ('raspberrypi', 'ED0402', 'warning', 1, 1, ['throttle_occurred'], ['throttle_active'], ['soc_temperature'], null, null),
  ('raspberrypi', 'ED0403', 'error', 0, 2, ['oom_kill'], [], ['oom_invoked', 'oom_memory_summary'], null, null),
  ('raspberrypi', 'ED0404', 'error', 0, 3, ['allocation_failed'], ['oom_kill'], ['oom_memory_summary'], null, null),
  ('raspberrypi', 'ED0405', 'warning', 1, 4, ['throttle_unknown_bits'], [], [], null, null),
  ('raspberrypi', 'ED0406', 'info', 2, 5, ['throttle_clear'], ['throttle_active', 'throttle_occurred', 'throttle_unknown_bits', 'oom_kill'], ['soc_temperature', 'arm_clock'], null, null)),
kinds as (select family, artifact, a, list(distinct kind) as kinds from f group by all),
fired as (
  select kinds.family, kinds.artifact, kinds.a, r.code, r.severity, r.srank, r.ord, r.req, r.opt,
    row_number() over (partition by kinds.a order by r.srank, r.ord) as rank
  from kinds join r on kinds.family = r.family
  where list_has_all(kinds.kinds, r.req) and not list_has_any(kinds.kinds, r.absent)
    and (r.cond_kind is null or exists (select 1 from f where f.a = kinds.a and f.kind = r.cond_kind and f.cnt >= r.cond_min))),
ev as (
  select fired.family, fired.artifact, fired.a, fired.code, fired.severity, f.seq, f.kind, f.e, f.k, f.bit, f.ctx, f.cnt, f.first_op,
    row_number() over (partition by fired.a, fired.code order by
      case when list_contains(fired.req, f.kind) then 0 else list_position(fired.opt, f.kind) end, f.seq) as position
  from fired join f on fired.a = f.a and (list_contains(fired.req, f.kind) or list_contains(fired.opt, f.kind)))"""

MESSAGES = f"""
  case code
    when 'ED0101' then concat('TensorRT''s ONNX importer does not know operator ''ns.Op', k, '''')
    when 'ED0102' then concat('the builder has no kernel for node ''/n', k, '''')
    when 'ED0104' then 'the builder left tactics out while timing kernels'
    when 'ED0201' then concat('output ''t', k, ''' differs by more than the tolerance')
    when 'ED0202' then concat('2 outputs do not agree, the first one listed is ''t', k, '''')
    when 'ED0205' then 'every compared output agrees within the tolerance'
    when 'ED0301' then concat('the graph runs on several providers, ', cnt, ' node group(s) of it on the CPU')
    when 'ED0302' then 'provider ''CUDAExecutionProvider'' is not available, so everything ran on the CPU'
    when 'ED0303' then concat(cnt, ' nodes fell back to the CPU, the first is ''', first_op, '''')
    when 'ED0401' then concat('the board is throttling at this moment (', ({_LIVE_TEXT})[bit + 1], '), so timings taken now are void')
    when 'ED0402' then concat('the board throttled since it was started (', ({_STICKY_TEXT})[bit - 15], '), so earlier timings may be void')
    when 'ED0403' then 'the kernel killed process ''worker'' because memory ran out'
    when 'ED0404' then 'a memory allocation failed: the runtime could not get the buffer it asked for'
    when 'ED0405' then concat('get_throttled has bits without documented meaning: ', bit)
    when 'ED0406' then 'no throttling and no undervoltage, now or earlier: timings of this host hold' end"""

# All artifacts of V_LOG, also those without facts.
ARTIFACTS = f"(select distinct {_FAMILY} as family, concat('log-', a, '.log') as artifact, a from b)"


def with_lines(select: str) -> str:
    return f"with {EXPECTED_LINES}\n{select}"


def with_facts(select: str) -> str:
    return f"with {EXPECTED_FACTS}\n{select}"


def with_rules(select: str) -> str:
    return f"with {EXPECTED_RULES}\n{select}"


# Trace aggregates, straight from the view.
EXPECTED_TRACE = f"""
t as ({duck(V_TRACE)}),
s as (select artifact, idx, name, dur, row_number() over (partition by artifact order by idx) as seq
      from ({duck(V_SESSION)}) where name <> 'session_run'),
total as (select artifact, cast(sum(dur) as bigint) as total, count(distinct node) as nodes, count(distinct op) as ops,
                 count(distinct provider) as providers,
                 cast(coalesce(sum(dur) filter (provider = 'CPUExecutionProvider'), 0) as bigint) as cpu from t group by artifact),
iter as (select artifact, max(c) as iterations from (select artifact, node, count(*) as c from t group by all) group by artifact),
cost as (select t.artifact, op, cast(sum(dur) as bigint) as us, count(*) as calls, count(distinct node) as nodes, min(idx) as first_idx
         from t group by all)"""


def with_trace(select: str) -> str:
    return f"with {EXPECTED_TRACE}\n{select}"
