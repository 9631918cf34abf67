"""Sources, sinks and fact extraction."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultscope.families import FAMILIES
from faultscope.families.poly import METRICS
from faultscope.functions.bits import decode_bitfield, describe_bits
from faultscope.operators.facts import citation, number_facts, summary_text
from faultscope.operators.ordered import carry_last
from faultscope.operators.report import facts_listing
from faultscope.operators.rule_tables import normalize_rules
from faultscope.operators.signatures import match_signatures
from faultscope.sources.artifacts import explode_lines, lines_of_text, read_artifacts, read_lines, sidecar_labels
from faultscope.sources.documents import read_facts_json, write_facts_json
from faultscope.sources.traces import read_trace, type_events
from faultscope.staging import shared_folder
from faultscope.workload.registry import flat_map, query, table
from faultscope.workload.views import ARTIFACTS, BASE, duck, log_facts, resolved_log, v_log, with_facts, with_lines

def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/faultscope/{name}-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BASE, events=table(spark, sf_dir, "events"))


# ------------------------------------------------------------------- S: sources


@query("s1_read_artifacts", """
select n_nationkey as nation, count(*) as lines, cast(sum(length(c_name) + 1) as bigint) as chars,
       cast(count(*) filter (c_custkey % 10 = 0) as bigint) as replaced
from customer join nation on c_nationkey = n_nationkey group by n_nationkey""")
def s1_read_artifacts(spark, sf_dir):
    """Text files on disk, some with a byte that is no UTF-8, read whole."""
    folder = _new_folder(spark, "texts")
    bad = F.when(F.col("c_custkey") % 10 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("2E")))
    (table(spark, sf_dir, "customer")
     .select("c_nationkey", "c_custkey", F.concat(F.encode("c_name", "utf-8"), bad, F.encode(F.concat(F.lit("@"), F.col("c_nationkey")), "utf-8")).cast("string").alias("value"))
     .repartition("c_nationkey", F.expr("c_custkey div 100000")).drop("c_custkey").write.option("maxRecordsPerFile", 100_000).partitionBy("c_nationkey").text(folder))
    lines = explode_lines(read_artifacts(spark, folder, "customers"))
    parts = F.split("line", "@")
    return (lines.select(F.element_at(parts, -1).cast("int").alias("nation"), F.element_at(parts, 1).alias("text"))
            .groupBy("nation").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"),
                                   F.count_if(F.col("text").endswith("�")).alias("replaced")))


@query("s1_read_lines", "select count(*) as lines, count(distinct e) as kinds, 0 as gaps from (" + duck(BASE) + ")")
def s1_read_lines(spark, sf_dir):
    """Log lines in files of any size, read block by block: no number is missing or given twice."""
    folder = _new_folder(spark, "line-files")
    events = _events(spark, sf_dir)
    events.select(F.concat("e", F.lit(" "), "k").alias("value")).write.text(folder)
    per_file = (read_lines(spark, folder, "events").groupBy("artifact")
                .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lineno").alias("d"), F.max("lineno").alias("last"), F.collect_set(F.split("line", " ")[0]).alias("e")))
    return per_file.agg(F.sum("n").alias("lines"), F.size(F.array_distinct(F.flatten(F.collect_set("e")))).alias("kinds"),
                        F.count_if((F.col("n") != F.col("d")) | (F.col("n") != F.col("last"))).alias("gaps"))


@query("s2_explode_lines", r"""
with p as (select doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]') as parts from documents),
q as (select doc_id, case when parts[-1] = '' then parts[1:len(parts) - 1] else parts end as parts from p)
select doc_id, cast(generate_subscripts(parts, 1) as bigint) as lineno, unnest(parts) as line from q""")
def s2_explode_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return explode_lines(docs).select("doc_id", "lineno", "line")


_TRACE_DOC = """
select a, concat('[', array_join(transform(array_sort(collect_list(struct(lineno, j))), s -> s.j), ','), ']') as list
from (select a, lineno, concat('{{"cat":"', if(e = 'signup', 'Session', 'Node'), '","name":"',
        case when e = 'signup' then 'session_initialization' else concat(e, '_kernel_time') end, '","dur":',
        case k % 5 when 0 then cast(-k - 1 as string) when 1 then 'true' when 2 then concat('"', k, '"') when 3 then concat(k, '.75') else cast(k as string) end,
        case when e = 'error' then '}}' else concat(',"args":{{"op_name":"', if(e = 'view', '', e), '","provider":"P', k % 3, '"}}}}') end) as j
      from {b}) group by a"""


@query("s3_read_trace", f"""
with b as ({duck(BASE)})
select concat('doc-', a, '.json') as artifact, lineno - 1 as idx, case when e = 'signup' then 'Session' else 'Node' end as cat,
  case when k % 5 = 0 then -k - 1 when k % 5 in (3, 4) then k end as dur, case when k % 5 = 0 then false when k % 5 in (3, 4) then true end as dur_ok,
  case when e not in ('error', 'view') then e end as op, case when e <> 'error' then concat('P', k % 3) end as provider
from b where a % 7 in (0, 1, 6)""")
def s3_read_trace(spark, sf_dir):
    """Lists, wrapped lists, cut documents, scalars and objects without events. Each
    document holds four events."""
    docs = spark.sql(_TRACE_DOC, b=_events(spark, sf_dir))
    kind = F.col("a") % 7
    text = (F.when(kind.isin(0, 6), F.col("list")).when(kind == 1, F.concat(F.lit('{"traceEvents":'), "list", F.lit("}")))
            .when(kind == 2, F.left("list", F.length("list") - 2)).when(kind == 3, F.lit("3")).when(kind == 4, F.lit("null"))
            .otherwise(F.lit('{"other": 1}')))
    events = type_events(read_trace(docs.select(F.concat(F.lit("doc-"), "a", F.lit(".json")).alias("artifact"), text.alias("text"))))
    return events.select("artifact", "idx", "cat", "dur", "dur_ok", "op", "provider")


def derived_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule table made from ``part``, with the slips of hand-edited data."""
    text = spark.sql("""
      select concat('fam', p_size % 5) as family, cast(p_partkey as int) as ord,
        case p_partkey % 13 when 5 then '"just text"' when 9 then '{{broken' else concat(
          '{{"id": "ED', lpad(case when p_partkey % 11 = 3 then p_partkey % 100 else p_partkey % 10000 end, case when p_partkey % 11 = 7 then 3 else 4 end, '0'), '"',
          case when p_partkey % 4 = 0 then ', "severity": "warning"' else '' end,
          ', "requires": ', case p_partkey % 3 when 0 then '"kind_a"' when 1 then '["kind_a", "kind_b", "kind_a"]' else '7' end,
          case when p_partkey % 6 = 1 then ', "absent": "kind_b"' else '' end,
          case p_partkey % 5 when 1 then ', "conditions": [{{"kind": "kind_a", "field": "n", "min": 2}}]' when 2 then ', "conditions": "n > 2"'
            when 3 then ', "conditions": [{{"kind": "kind_a", "field": "n", "min": "two"}}]' when 4 then ', "conditions": [{{"kind": "kind_z", "field": "n", "max": 9}}]' else '' end,
          ', "message": "', p_brand, ' {{op}} and {{n}}", "cause": "  because  ", "suggestions": ',
          case p_partkey % 4 when 0 then '[{{"summary": "do it"}}, "text"]' when 1 then '"text"' when 2 then '[]' else '[{{"summary": "run", "applicability": "machine-applicable"}}]' end,
          case when p_partkey % 2 = 0 then ', "refs": ["https://example.org/a"]' else '' end, '}}') end as text
      from {part}""", part=table(spark, sf_dir, "part"))
    return normalize_rules(text.select("family", "ord", F.try_parse_json("text").alias("rule")))


# w: the same rules, written from the columns.
EXPECTED_DERIVED = """
w as (select concat('fam', p_size % 5) as family, cast(p_partkey as int) as ord,
    concat('ED', case when p_partkey % 11 = 7 then left(lpad(cast(p_partkey % 10000 as varchar), 3, '0'), 3)
      when p_partkey % 11 = 3 then lpad(cast(p_partkey % 100 as varchar), 4, '0') else lpad(cast(p_partkey % 10000 as varchar), 4, '0') end) as code,
    case when p_partkey % 4 = 0 then 'warning' else 'error' end as severity,
    case p_partkey % 3 when 0 then ['kind_a'] when 1 then ['kind_a', 'kind_b'] else [] end as requires,
    case when p_partkey % 6 = 1 then ['kind_b'] else []::varchar[] end as absent,
    p_partkey % 5 as c, p_partkey % 4 as s, p_partkey % 2 as r, p_brand
  from part where p_partkey % 13 not in (5, 9))"""


@query("s4_rule_table", f"""
with {EXPECTED_DERIVED}
select family, ord, code, severity, array_to_string(requires, ',') as requires, array_to_string(absent, ',') as absent,
  cast(case when c = 0 then 0 else 1 end as int) as conditions, cast(case when c in (1, 4) then 1 else 0 end as int) as readable,
  cast(case when s in (0, 3) then 1 else 0 end as int) as suggestions from w""")
def s4_rule_table(spark, sf_dir):
    rules = derived_rules(spark, sf_dir)
    return rules.select("family", "ord", F.col("id").alias("code"), "severity", F.array_join("requires", ",").alias("requires"),
                        F.array_join("absent", ",").alias("absent"), F.size("conditions").alias("conditions"),
                        F.size(F.filter("conditions", lambda c: c["ok"])).alias("readable"), F.size("suggestions").alias("suggestions"))


@query("r1_normalize_rules", f"""
with {EXPECTED_DERIVED}
select family, ord, p_brand || ' <op> and <n>' as message, 'because' as cause, case c when 1 then 'kind_a.n>=2' when 2 then 'unreadable' when 3 then 'unreadable' when 4 then 'kind_z.n<=9' else '' end as conditions,
  case s when 0 then 'do it/maybe-incorrect' when 3 then 'run/machine-applicable' else '' end as suggestions from w""")
def r1_normalize_rules(spark, sf_dir):
    """Templates cut at placeholders, defaults filled in, conditions that fail closed."""
    text = F.array_join(F.transform("segments", lambda s: F.coalesce(s["lit"], F.concat(F.lit("<"), s["key"], F.lit(">")))), "")

    def bound(sign, value):
        return F.concat(F.lit(sign), value.cast("int"))
    conditions = F.array_join(F.transform("conditions", lambda c: F.when(~c["ok"], "unreadable").otherwise(
        F.concat(c["kind"], F.lit("."), c["field"], F.coalesce(bound(">=", c["lo"]), bound("<=", c["hi"]))))), ",")
    suggestions = F.array_join(F.transform("suggestions", lambda s: F.concat(s["summary"], F.lit("/"), s["applicability"])), ",")
    return derived_rules(spark, sf_dir).select("family", "ord", text.alias("message"), "cause", conditions.alias("conditions"), suggestions.alias("suggestions"))


@query("s5_read_sidecars", """
select concat(s_name, '.meta.md') as artifact, unnest(['command', 'machine', 'outcome', 'root cause']) as key,
  unnest([concat('run --id ', s_suppkey), case when s_nationkey % 2 = 0 then 'arm64' else 'x86_64' end,
          case when s_suppkey % 3 = 0 then 'failed' else 'succeeded' end, '']) as value
from supplier""")
def s5_read_sidecars(spark, sf_dir):
    text = F.concat(F.lit("# "), "s_name", F.lit("\n\n- command: run --id "), F.col("s_suppkey").cast("string"),
                    F.lit("\n- Machine: "), F.when(F.col("s_nationkey") % 2 == 0, "arm64").otherwise("x86_64"),
                    F.lit("\nplain text: no bullet\n- outcome: "), F.when(F.col("s_suppkey") % 3 == 0, "failed").otherwise("succeeded"),
                    F.lit("\n- root cause: \n"))
    return sidecar_labels(table(spark, sf_dir, "supplier").select(
        F.lit("sidecar").alias("family"), F.concat("s_name", F.lit(".meta.md")).alias("artifact"), text.alias("text")))


@query("s6_facts_json", with_facts("select family, artifact, seq, concat('f', seq) as id, kind, payload from f"))
def s6_facts_json(spark, sf_dir):
    folder = _new_folder(spark, "facts-json")
    write_facts_json(log_facts(spark, sf_dir), folder)
    return read_facts_json(spark, folder).select("family", "artifact", "seq", "id", "kind", flat_map("data").alias("payload"))


@query("s8_facts_listing", with_facts(f"""
select g.family, g.artifact, f.seq, f.artifact || ':' || f.lineno as source, f.kind, coalesce(t.n, 0) as facts
from {ARTIFACTS} g left join f on f.a = g.a left join (select a, count(*) as n from f group by a) t on t.a = g.a"""))
def s8_facts_listing(spark, sf_dir):
    return facts_listing(log_facts(spark, sf_dir), v_log(spark, sf_dir)).drop("observation")


@query("s9_facts_from_text", with_lines("""
select concat('event-', a * 4 + lineno - 1) as artifact, concat('event-', a * 4 + lineno - 1, ':1') as source, kind
from x where kind is not null
union all select concat('event-', a * 4 + lineno - 1), concat('event-', a * 4 + lineno - 1, ':1'), 'node_on_provider' from x where kind is null and family = 'onnxruntime'"""))
def s9_facts_from_text(spark, sf_dir):
    """A text column of any table, family by family; each message is an artifact of its
    own, so a node line has no heading before it."""
    messages = v_log(spark, sf_dir).withColumn("event", F.regexp_extract("artifact", r"(\d+)", 1).cast("bigint") * 4 + F.col("lineno") - 1)
    facts = None
    for name, family in FAMILIES.items():
        lines = lines_of_text(messages.where(F.col("family") == name), name, F.concat(F.lit("event-"), F.col("event")), F.col("line"))
        found = match_signatures(lines, [family]).select("artifact", citation(F.col("artifact"), F.col("lineno")).alias("source"), "kind")
        facts = found if facts is None else facts.unionByName(found)
    return facts


# ---------------------------------------------------------------- X: extraction


@query("x1_match_signatures", with_lines("""
select family, artifact, lineno, kind from x where kind is not null
union all select family, artifact, lineno, 'node_on_provider' from x where kind is null and family = 'onnxruntime'"""))
def x1_match_signatures(spark, sf_dir):
    """Before context: a node line counts even ahead of any heading."""
    return match_signatures(v_log(spark, sf_dir)).select("family", "artifact", "lineno", "kind")


@query("x2_capture_payload", with_lines("select artifact, lineno, kind, payload from x where kind is not null"))
def x2_capture_payload(spark, sf_dir):
    """All families. Context is resolved too: the payloads of two families carry it."""
    return resolved_log(spark, sf_dir).select("artifact", "lineno", "kind", flat_map("data").alias("payload"))


@query("x3_fact_ids", with_lines("select family, artifact, lineno, kind, concat('f', seq) as id from n"))
def x3_fact_ids(spark, sf_dir):
    return resolved_log(spark, sf_dir).select("family", "artifact", "lineno", "kind", F.concat(F.lit("f"), "seq").alias("id"))


@query("x4_citation", with_lines("select concat('f', seq) as id, concat(artifact, ':', lineno) as source from n"))
def x4_citation(spark, sf_dir):
    return number_facts(resolved_log(spark, sf_dir)).select("id", "source")


@query("x5_excerpt", f"""
with b as ({duck(BASE)})
select a, lineno, concat('&&&& PASSED TensorRT.trtexec ', k) as excerpt from b""")
def x5_excerpt(spark, sf_dir):
    """Lines framed by several kinds of Unicode white space."""
    pads = F.array(*[F.lit(p) for p in (" ", "\t \t", " ", "　 ", " \x1f", "")])
    pad = F.element_at(pads, F.col("k") % 6 + 1)
    lines = _events(spark, sf_dir).select(
        F.lit("tensorrt").alias("family"), F.col("a").cast("string").alias("artifact"), "lineno",
        F.concat(pad, F.lit("&&&& PASSED TensorRT.trtexec "), "k", pad).alias("line"))
    return match_signatures(lines, [FAMILIES["tensorrt"]]).select(F.col("artifact").cast("bigint").alias("a"), "lineno", "excerpt")


@query("x6_summary_text", with_lines("""
select artifact, lineno, kind, case kind
  when 'trt_version' then concat('TensorRT 10.', k % 10, '.0')
  when 'no_implementation' then concat('No kernel can execute node ''/n', k, '''')
  when 'tactic_skipped' then concat('Tactic ', k, ' was skipped: insufficient memory')
  when 'unsupported_op' then concat('No importer for operator ''ns.Op', k, ''', a plugin is tried instead')
  when 'oom_kill' then concat('The kernel killed ''worker'' (pid ', k, ') for lack of memory')
  when 'soc_temperature' then concat('SoC temperature ', k, '.5 °C')
  when 'allocation_failed' then concat('A buffer of ', cast(k as bigint) * 1048576, ' bytes could not be allocated')
  when 'throttle_clear' then 'No throttling and no undervoltage, now or earlier'
  when 'throttled_bitfield' then concat('get_throttled reads ', case when e = 'purchase' then '0x0' else cast(cast(pow(2, bit) as bigint) as varchar) end)
  when 'throttle_active' then concat('Now: ', string_split(string_split(payload, 'conditions=')[2], ';')[1])
  when 'throttle_occurred' then concat('Earlier: ', string_split(string_split(payload, 'conditions=')[2], ';')[1])
  when 'throttle_unknown_bits' then concat('Bits without documented meaning are set: ', bit)
  when 'compared_output' then concat('Comparison of ''t', k, ''' (dtype=float32, shape=(1, ', k, '))')
  when 'output_mismatch' then concat('''t', k, ''' differs by more than the tolerance (rel=1e-05, abs=1e-05)')
  when 'required_tolerance' then concat('abs=0.', k, ' or rel=1.', k, ' would have been enough (elemwise error)')
  when 'all_outputs_matched' then 'All 1 compared output(s) agree'
  when 'mismatched_outputs' then '2 output(s) did not agree'
  when 'node_placement' then concat(k, ' node group(s) run on ', ctx)
  when 'node_on_provider' then concat('Node ''Op', k, '_0'' (Op', k, ') runs on ', ctx)
  when 'provider_unavailable' then 'Provider CUDAExecutionProvider was asked for but is not in this build'
  when 'session_providers' then 'The session uses CPUExecutionProvider' end as summary
from x where kind is not null"""))
def x6_summary_text(spark, sf_dir):
    """Every kind of every family, context included."""
    return resolved_log(spark, sf_dir).select("artifact", "lineno", "kind", summary_text().alias("summary"))


@query("x7_parse_metrics_blob", f"""
with b as ({duck(BASE)})
select a, lineno, concat('t', k) as output, concat('0.', k) as max_absdiff, case when k % 2 = 0 then concat(k, 'e-3') end as max_reldiff,
  case when k % 3 = 0 then concat(k, '.5') end as mean_absdiff, cast(null as varchar) as mean_reldiff, cast(null as varchar) as median_absdiff,
  concat('1.', k) as median_reldiff from b""")
def x7_parse_metrics_blob(spark, sf_dir):
    line = F.concat(
        F.lit("[I] Average Metrics | t"), "k", F.lit(": max_absdiff=0."), "k", F.lit(" (n=1), "),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit("max_reldiff="), "k", F.lit("e-3 (n=1), "))).otherwise(""),
        F.when(F.col("k") % 3 == 0, F.concat(F.lit("mean_absdiff="), "k", F.lit(".5, "))).otherwise(""),
        F.lit("median_reldiff=1."), "k")
    lines = _events(spark, sf_dir).select(F.lit("polygraphy").alias("family"), F.col("a").cast("string").alias("artifact"), "lineno", line.alias("line"))
    raw = match_signatures(lines, [FAMILIES["polygraphy"]])
    return raw.select(F.col("artifact").cast("bigint").alias("a"), "lineno", F.col("data")["output"].alias("output"),
                      *[F.col("data")[m].alias(m) for m in METRICS])


@query("x8_split_quoted_names", f"""
with b as ({duck(BASE)})
select a, lineno, cast(k % 4 as varchar) as n, case when k % 4 > 0 then concat('/l', k, '.0/Conv') end as first_output,
  concat('[', array_to_string([concat('"/l', k + i, '.0/Conv"') for i in range(0, k % 4)], ','), ']') as outputs from b""")
def x8_split_quoted_names(spark, sf_dir):
    names = F.when(F.col("k") % 4 == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("k") % 4 - 1), lambda i: F.concat(F.lit("'/l"), F.col("k") + i, F.lit(".0/Conv'"))))
    line = F.concat(F.lit("[E] FAILED | Mismatched outputs: ["), F.array_join(names, ", "), F.lit("]"))
    lines = _events(spark, sf_dir).select(F.lit("polygraphy").alias("family"), F.col("a").cast("string").alias("artifact"), "lineno", line.alias("line"))
    d = F.col("data")
    return match_signatures(lines, [FAMILIES["polygraphy"]]).select(
        F.col("artifact").cast("bigint").alias("a"), "lineno", d["count"].alias("n"), d["first_output"].alias("first_output"), d["outputs"].alias("outputs"))


@query("x9_split_providers", f"""
with b as ({duck(BASE)})
select a, lineno, case k % 3 when 0 then concat('["A', k, 'ExecutionProvider","CPUExecutionProvider"]') when 1 then '["CPUExecutionProvider"]' else '[]' end as providers from b""")
def x9_split_providers(spark, sf_dir):
    line = F.concat(F.lit("SESSION_PROVIDERS: "), F.when(F.col("k") % 3 == 0, F.concat(F.lit("A"), "k", F.lit("ExecutionProvider , CPUExecutionProvider,")))
                    .when(F.col("k") % 3 == 1, ",CPUExecutionProvider").otherwise(" , ,"))
    lines = _events(spark, sf_dir).select(F.lit("onnxruntime").alias("family"), F.col("a").cast("string").alias("artifact"), "lineno", line.alias("line"))
    return match_signatures(lines, [FAMILIES["onnxruntime"]]).select(
        F.col("artifact").cast("bigint").alias("a"), "lineno", F.col("data")["providers"].alias("providers"))


@query("x10_typed_counts", f"""
with b as ({duck(BASE)})
select a, lineno, k % 7 as partitions, cast(k * 3 as bigint) as graph_nodes, cast(k as bigint) as supported, cast(k * 2 as bigint) as unsupported from b""")
def x10_typed_counts(spark, sf_dir):
    line = F.concat(F.lit("[W:onnxruntime:] CoreMLExecutionProvider::GetCapability, number of partitions supported by CoreML: 0"), F.col("k") % 7,
                    F.lit(" number of nodes in the graph: "), F.col("k") * 3, F.lit(" number of nodes supported by CoreML: "), "k")
    lines = _events(spark, sf_dir).select(F.lit("onnxruntime").alias("family"), F.col("a").cast("string").alias("artifact"), "lineno", line.alias("line"))
    d = F.col("data")
    return match_signatures(lines, [FAMILIES["onnxruntime"]]).select(
        F.col("artifact").cast("bigint").alias("a"), "lineno",
        *[d[c].cast("bigint").alias(c) for c in ("partitions", "graph_nodes", "supported", "unsupported")])


@query("x11_carry_context", with_lines("select family, artifact, seq, kind, payload from n where family in ('polygraphy', 'onnxruntime')"))
def x11_carry_context(spark, sf_dir):
    return (resolved_log(spark, sf_dir).where(F.col("family").isin("polygraphy", "onnxruntime"))
            .select("family", "artifact", "seq", "kind", flat_map("data").alias("payload")))


@query("x11_carry_turns", """
select conv_id, turn, role, md5(last_value(case when role = 'user' then text end ignore nulls)
  over (partition by conv_id order by turn rows between unbounded preceding and current row)) as question
from conversations""")
def x11_carry_turns(spark, sf_dir):
    """The same forward fill over conversations: each turn with the last user text."""
    turns = table(spark, sf_dir, "conversations")
    filled = carry_last(turns, ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("text")), "question")
    return filled.select("conv_id", "turn", "role", F.md5("question").alias("question"))


@query("x12_node_lines", with_lines("select artifact, lineno, concat('Op', k) as op, concat('Op', k, '_0') as node, ctx as provider from n where kind = 'node_on_provider'"))
def x12_node_lines(spark, sf_dir):
    d = F.col("data")
    return (resolved_log(spark, sf_dir).where("kind = 'node_on_provider'")
            .select("artifact", "lineno", d["op"].alias("op"), d["node"].alias("node"), d["provider"].alias("provider")))


@query("x13_drop_synthetic_nodes", f"""
with b as ({duck(BASE)})
select a, lineno, case k % 4 when 2 then concat('Op', k) else concat('a_', k, '_b') end as op from b where k % 4 in (2, 3)""")
def x13_drop_synthetic_nodes(spark, sf_dir):
    """Two hash-like names drop, two ordinary ones with digits stay."""
    k = F.col("k")
    op = (F.when(k % 4 == 0, F.concat(k + 100000, F.lit("_CoreML_1234567_0"))).when(k % 4 == 1, F.concat(F.lit("EP_"), k + 1000000, F.lit("_x")))
          .when(k % 4 == 2, F.concat(F.lit("Op"), k)).otherwise(F.concat(F.lit("a_"), k, F.lit("_b"))))
    lines = _events(spark, sf_dir).select(
        F.lit("onnxruntime").alias("family"), F.col("a").cast("string").alias("artifact"), "lineno",
        F.concat(F.lit("[V] VerifyEachNodeIsAssignedToAnEp]   "), op, F.lit(" (n)")).alias("line"))
    return match_signatures(lines, [FAMILIES["onnxruntime"]]).select(F.col("artifact").cast("bigint").alias("a"), "lineno", F.col("data")["op"].alias("op"))


def _duck_bits(first: int, names: list[str]) -> str:
    picks = ", ".join(f"case when (v >> {first + i}) & 1 = 1 then '{n}' end" for i, n in enumerate(names))
    return f"array_to_string(list_filter([{picks}], lambda x: x is not null), ',')"


_LIVE = ["undervoltage", "freq_capped", "throttled", "soft_temp_limit"]
_STICKY = [f"{n}_occurred" for n in _LIVE]
_UNKNOWN = "array_to_string([b for b in range(0, 40) if (v >> b) & 1 = 1 and b not in (0, 1, 2, 3, 16, 17, 18, 19)], ',')"


@query("x14_decode_bitfield", f"""
with q as (select o_orderkey, case when o_orderkey % 50 = 7 then -o_orderkey else o_orderkey * 37 end as v from orders)
select o_orderkey, case when v >= 0 then v end as raw, case when v >= 0 then concat('0x', upper(to_hex(v))) end as hex,
  case when v >= 0 then {_duck_bits(0, _LIVE)} end as live, case when v >= 0 then {_duck_bits(16, _STICKY)} end as sticky,
  case when v >= 0 then {_UNKNOWN} end as unknown_bits, case when v >= 0 then v = 0 end as healthy from q""")
def x14_decode_bitfield(spark, sf_dir):
    value = F.when(F.col("o_orderkey") % 50 == 7, -F.col("o_orderkey")).otherwise(F.col("o_orderkey") * 37)
    return (table(spark, sf_dir, "orders").select("o_orderkey", decode_bitfield(value).alias("d"))
            .select("o_orderkey", "d.raw", "d.hex", F.array_join("d.live", ",").alias("live"), F.array_join("d.sticky", ",").alias("sticky"),
                    F.array_join("d.unknown_bits", ",").alias("unknown_bits"), "d.healthy"))


_LIVE_PROSE = ["undervoltage detected", "Arm frequency capped", "currently throttled", "soft temperature limit active"]


@query("x15_describe_bits", f"""
with q as (select o_orderkey, o_orderkey % 16 as v, o_orderstatus from orders)
select o_orderkey, array_to_string(list_concat(list_filter([{", ".join(f"case when (v >> {i}) & 1 = 1 then '{n}' end" for i, n in enumerate(_LIVE_PROSE))}],
  lambda x: x is not null), [concat('status ', o_orderstatus)]), ', ') as prose from q""")
def x15_describe_bits(spark, sf_dir):
    """Known keys become prose, an unknown key passes through."""
    keys = F.concat(decode_bitfield(F.col("o_orderkey") % 16)["live"], F.array(F.concat(F.lit("status "), "o_orderstatus")))
    return table(spark, sf_dir, "orders").select("o_orderkey", describe_bits(keys).alias("prose"))


@query("x16_bitfield_facts", with_lines("select artifact, lineno, ord as ordinal, kind, payload from x where kind like 'throttle%'"))
def x16_bitfield_facts(spark, sf_dir):
    raw = match_signatures(v_log(spark, sf_dir).where("family = 'raspberrypi'"))
    return raw.where(F.col("kind").startswith("throttle")).select("artifact", "lineno", "ordinal", "kind", flat_map("data").alias("payload"))


@query("x17_derive_units", f"""
with b as ({duck(BASE)})
select a, lineno, case k % 3 when 0 then concat(k, '.25') end as celsius, case when k % 3 = 1 then cast(k as bigint) * 12345678 // 1000000 end as mhz,
  case when k % 3 = 2 then concat(k, '.5') end as mib from b""")
def x17_derive_units(spark, sf_dir):
    k = F.col("k")
    line = (F.when(k % 3 == 0, F.concat(F.lit("temp="), k, F.lit(".250'C"))).when(k % 3 == 1, F.concat(F.lit("frequency(48)="), k.cast("bigint") * 12345678))
            .otherwise(F.concat(F.lit("Failed to allocate memory for requested buffer of size "), k.cast("bigint") * 1048576 + 524288)))
    lines = _events(spark, sf_dir).select(F.lit("raspberrypi").alias("family"), F.col("a").cast("string").alias("artifact"), "lineno", line.alias("line"))
    d = F.col("data")
    return match_signatures(lines, [FAMILIES["raspberrypi"]]).select(
        F.col("artifact").cast("bigint").alias("a"), "lineno", d["celsius"].alias("celsius"), d["mhz"].cast("bigint").alias("mhz"), d["mib"].alias("mib"))
