"""Whole ways: files in, verdicts out; rule tables and sidecars from files; a stream."""

from pyspark.sql import functions as F

from faultscope.plans.diagnosis import all_facts, diagnose_lines, run_diagnosis
from faultscope.plans.standing import Standing
from faultscope.sources.artifacts import list_artifacts, read_lines, read_sidecars
from faultscope.sources.rulebook import Rulebook
from faultscope.sources.traces import read_trace_documents, read_trace_lines, type_events
from faultscope.staging import new_path, stage
from faultscope.streaming.lines import stream_facts
from faultscope.streaming.stateful import LINES, diagnose_lines_stream, streamed
from faultscope.workload.registry import flat_map, query, table
from faultscope.workload.views import ARTIFACTS, EXPECTED_RULES, EXPECTED_TRACE, V_LOG, log_facts, v_log, v_trace, with_facts, with_lines, with_rules


@query("s5_sidecars_from_files", """
select lower(concat('Doc ', doc_id)) as key, concat('quality ', quality) as value from labels""")
def s5_sidecars_from_files(spark, sf_dir):
    """Sidecars written as text files and read again, some with a continuation line."""
    folder = new_path(spark, "sidecars")
    line = F.concat(F.lit("- Doc "), "doc_id", F.lit(":  quality "), "quality", F.when(F.col("doc_id") % 3 == 0, "\n  and more").otherwise(""))
    table(spark, sf_dir, "labels").select((F.col("doc_id") % 16).alias("part"), line.alias("value")).write.partitionBy("part").text(folder)
    return read_sidecars(spark, folder).select("key", "value")


@query("s4_rulebook_from_files", """
select concat('fam', p_size % 5) as family, cast(p_partkey as int) as ord, concat('ED', lpad(cast(p_partkey % 10000 as varchar), 4, '0')) as code,
  case when p_partkey % 4 = 0 then 'warning' else 'error' end as severity, concat('kind', p_partkey % 97) as requires from part where p_partkey % 13 <> 5""")
def s4_rulebook_from_files(spark, sf_dir):
    """A rule table in JSON lines, some of them broken, read as a rule book: more kinds
    than one mask word holds."""
    folder = new_path(spark, "rules")
    key = F.col("p_partkey")
    rule = F.struct(F.concat(F.lit("fam"), F.col("p_size") % 5).alias("family"), key.cast("int").alias("ord"),
                    F.concat(F.lit("ED"), F.lpad((key % 10000).cast("string"), 4, "0")).alias("id"),
                    F.when(key % 4 == 0, "warning").otherwise("error").alias("severity"), F.array(F.concat(F.lit("kind"), key % 97)).alias("requires"),
                    F.lit("message").alias("message"), F.lit("cause").alias("cause"), F.array(F.struct(F.lit("do it").alias("summary"))).alias("suggestions"))
    table(spark, sf_dir, "part").select(F.when(key % 13 == 5, "{broken").otherwise(F.to_json(rule)).alias("value")).write.text(folder)
    rules = Rulebook.read(spark, folder).table(spark)
    return rules.select("family", "ord", F.col("id").alias("code"), "severity", F.array_join("requires", ",").alias("requires"))


@query("s3_trace_lines", """
select case when event_id % 50 <> 7 then concat(event_type, '_kernel_time') end as name, case when event_id % 50 = 7 then null else event_id end as dur,
  case when event_id % 50 = 7 then null else concat('P', user_id % 3) end as provider, event_id % 50 = 7 as unread from events""")
def s3_trace_lines(spark, sf_dir):
    """Events in list files of one event per line, some of them cut off, read by blocks."""
    folder = new_path(spark, "trace-lines")
    event = F.to_json(F.struct(F.lit("Node").alias("cat"), F.concat("event_type", F.lit("_kernel_time")).alias("name"), F.col("event_id").alias("dur"),
                               F.struct(F.col("event_type").alias("op_name"), F.concat(F.lit("P"), F.col("user_id") % 3).alias("provider")).alias("args")))
    cut = F.when(F.col("event_id") % 50 == 7, F.left(event, F.length(event) - 9)).otherwise(F.concat(event, F.lit(",")))
    lines = F.when(F.col("event_id") == 0, F.concat(F.lit("[\n"), cut)).otherwise(cut)
    table(spark, sf_dir, "events").select(lines.alias("value")).write.text(folder)
    trace = read_trace_lines(spark, folder)
    return type_events(trace).join(trace.select("artifact", "idx", F.col("unread").isNotNull().alias("unread")), ["artifact", "idx"]).select("name", "dur", "provider", "unread")


@query("s3_trace_documents", """
with e as (select event_id, event_type, user_id % 24 as d from events),
heads as (select distinct d from e where d % 4 <> 3)
select concat('doc', d) as name, row_number() over (partition by d order by event_id) as idx, event_id as dur, event_type as op from e where d % 4 <> 3
union all select concat('doc', d), 0, null, null from heads""")
def s3_trace_documents(spark, sf_dir):
    """Whole trace documents, half of them on one line and half pretty-printed, as a list or as
    an object among other members, a quarter cut off: read by blocks, by many tasks."""
    folder = new_path(spark, "trace-documents")
    rows = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 24).cast("int").alias("d"), F.col("event_id").alias("pos"),
        F.struct(F.lit("Node").alias("cat"), F.concat(F.lit("doc"), F.col("user_id") % 24).alias("name"), F.col("event_id").alias("dur"),
                 F.struct(F.col("event_type").alias("op_name"), F.col("props").alias("note {,")).alias("args")).alias("ev"))
    docs = rows.select("d").distinct()
    head = F.concat(F.when(F.col("d") % 4 == 1, '{"traceEvents":').when(F.col("d") % 4 == 2, '{"unit": "ns", "other": {"traceEvents": [1, {}]}, "traceEvents" :').otherwise(""),
                    F.lit('[{"cat": "Session", "name": "doc'), "d", F.lit('"}'))
    foot = F.when(F.col("d") % 4 == 0, "]").when(F.col("d") % 4 == 1, "]}").when(F.col("d") % 4 == 2, '], "tail": ["}"]}').otherwise("")
    one_line = F.col("d") % 8 < 4
    text = F.concat(F.lit(","), F.when(one_line, F.to_json("ev")).otherwise(F.to_json("ev", {"pretty": "true"})))
    parts = (rows.select("d", "pos", text.alias("value")).unionByName(docs.select("d", F.lit(-1).cast("long").alias("pos"), head.alias("value")))
             .unionByName(docs.select("d", F.lit((1 << 63) - 1).alias("pos"), foot.alias("value"))))
    # A task for each document: the parts of a file follow each other.
    parts = parts.repartitionById(24, "d").sortWithinPartitions("d", "pos")
    parts.where(one_line).select("d", "value").write.option("lineSep", " ").partitionBy("d").text(folder)
    parts.where(~one_line).select("d", "value").write.mode("append").partitionBy("d").text(folder)
    events = read_trace_documents(spark, folder)
    return type_events(events).select("name", "idx", "dur", "op")


@query("run_log_files", """
select 2 as exit_code, count(*) as facts, 0 as empty_files from customer where c_nationkey % 3 = 0
union all select 0, 2 * count(*), 1 from customer where c_nationkey % 3 = 1""")
def run_log_files(spark, sf_dir):
    """Host captures of every nation's customers as text files, and one empty file: through
    the library's own entry point, to one verdict per file."""
    folder = new_path(spark, "captures")
    nation = F.col("c_nationkey") % 3
    line = (F.when(nation == 0, F.concat(F.lit("Out of memory: Killed process "), "c_custkey", F.lit(" (worker)")))
            .when(nation == 1, "throttled=0x0").otherwise("nothing to see"))
    # A partition of its own for each nation: files of one partition share their name.
    nations = table(spark, sf_dir, "nation").agg(F.max("n_nationkey")).first()[0] + 1
    (table(spark, sf_dir, "customer").select("c_nationkey", line.alias("value"))
     .repartitionById(nations, F.col("c_nationkey").cast("int")).write.partitionBy("c_nationkey").text(folder))
    spark.createDataFrame([], "c_nationkey int, value string").drop("c_nationkey").coalesce(1).write.text(f"{folder}/c_nationkey=999")
    lines = read_lines(spark, folder, "raspberrypi")
    artifacts = stage(list_artifacts(spark, folder, "raspberrypi"), "artifacts")
    run = diagnose_lines(lines, artifacts=artifacts)
    per = run.facts.groupBy("artifact").agg(F.count("*").alias("facts"))
    empty = artifacts.join(lines.select("artifact").distinct(), "artifact", "left_anti").withColumn("empty", F.lit(1))
    return (run.verdicts.join(per, "artifact", "left").join(empty.select("artifact", "empty"), "artifact", "left").groupBy("exit_code")
            .agg(F.coalesce(F.sum("facts"), F.lit(0)).alias("facts"), F.count("empty").cast("int").alias("empty_files")))


@query("t1_stream_facts", with_lines("""
select family, artifact, lineno, kind from x where kind is not null
union all select family, artifact, lineno, 'node_on_provider' from x where kind is null and family = 'onnxruntime'"""))
def t1_stream_facts(spark, sf_dir):
    """Raw facts of log lines that arrive as a stream, all that is there, into a table."""
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
    facts = stream_facts(spark.sql(V_LOG, events=stream).select("family", "artifact", "lineno", "line"))
    out = new_path(spark, "streamed")
    (facts.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "stream-state"))
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(facts.schema).parquet(out).select("family", "artifact", "lineno", "kind")


# Files of one batch of a stream.
_FILES = 24


def _streamed(spark, sf_dir, name: str):
    """The log lines of ``events`` arrive in four parts that are cut inside an artifact; then
    every artifact ends. Returns one table of the stream's results."""
    events = table(spark, sf_dir, "events")
    lines = spark.sql(V_LOG, events=events).select(
        "family", "artifact", "lineno", "line", F.timestamp_seconds(F.regexp_extract("artifact", r"(\d+)", 1).cast("long") * 4 + F.col("lineno")).alias("at"), F.lit(False).alias("end"))
    most = events.agg(F.max("event_id")).first()[0]
    place = F.regexp_extract("artifact", r"(\d+)", 1).cast("long") * 4 + F.col("lineno") - 1
    source, out = new_path(spark, "arriving"), new_path(spark, "stream-results")
    cuts = [-1, most // 4 + 2, most // 2 + 1, 3 * most // 4 + 3, most]
    stop = lines.groupBy("family", "artifact").agg(F.max("lineno").alias("lineno")).select(
        "family", "artifact", "lineno", F.lit(None).cast("string").alias("line"), F.timestamp_seconds(F.lit(most + 4)).alias("at"), F.lit(True).alias("end"))
    # A batch is one part, in as many files as tasks write and read it: a row of no family in each
    # of them, which the stream passes over, so that no file is missing.
    file = F.pmod(F.xxhash64("family", "artifact"), F.lit(_FILES)).cast("int").alias("file")
    filler = spark.range(_FILES).select(*[F.lit(None).cast(t.dataType).alias(t.name) for t in LINES if t.name != "at"], F.timestamp_seconds(F.lit(0)).alias("at"), F.col("id").cast("int").alias("file"))
    for k, part in enumerate([*[lines.where((place > a) & (place <= b)) for a, b in zip(cuts, cuts[1:])], stop]):
        rows = part.select("*", file).unionByName(filler).repartitionById(_FILES, "file").drop("file")
        rows.write.mode("append").parquet(f"{source}/part={k}")
    stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", _FILES).option("basePath", source).parquet(f"{source}/part=*")
    diagnose_lines_stream(stream.select(*LINES.fieldNames()), out, new_path(spark, "stream-state"), availableNow=True).awaitTermination()
    return streamed(spark, out, name)


@query("t2_stream_numbered_facts", with_facts("select family, artifact, seq, kind, lineno, payload from f"))
def t2_stream_numbered_facts(spark, sf_dir):
    """All facts with numbers, headings and derived facts, from state kept between batches."""
    facts = _streamed(spark, sf_dir, "facts")
    return facts.select("family", "artifact", "seq", "kind", F.regexp_extract("source", r":(\d+)$", 1).cast("bigint").alias("lineno"), flat_map("data").alias("payload"))


_VERDICTS = with_rules(f"""
select g.family, g.artifact, cast(case when bool_or(fired.severity = 'error') then 2 when bool_or(fired.severity = 'warning') then 3 else 0 end as int) as exit_code
from {ARTIFACTS} g left join fired on fired.a = g.a group by g.family, g.artifact""")


@query("t2_stream_verdicts", _VERDICTS)
def t2_stream_verdicts(spark, sf_dir):
    """Verdicts of a stream cut at arbitrary places, also of artifacts without facts."""
    return _streamed(spark, sf_dir, "verdicts")


def _standing(spark, sf_dir) -> Standing:
    """Facts in three batches that cut every artifact, last ones first."""
    facts = log_facts(spark, sf_dir)
    standing = Standing(spark, new_path(spark, "standing"))
    for part in (2, 0, 1):
        standing.add(facts.where(F.col("seq") % 3 == part), v_log(spark, sf_dir).select("family", "artifact"))
    return standing


@query("a13_standing_verdicts", _VERDICTS)
def a13_standing_verdicts(spark, sf_dir):
    """Verdicts kept up to date over three batches."""
    return _standing(spark, sf_dir).verdicts()


@query("a13_standing_firsts", with_facts("select family, artifact, kind, concat('f', min(seq)) as id, count(distinct kind) as kinds from f group by family, artifact, kind"))
def a13_standing_firsts(spark, sf_dir):
    """The first fact of every kind, whatever batch brought it."""
    return _standing(spark, sf_dir).firsts().groupBy("family", "artifact", "kind").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("kinds"))


@query("run_logs_and_traces", f"""
with {EXPECTED_RULES}, {EXPECTED_TRACE},
tops as (select artifact, max(us) as top from cost group by artifact),
k as (select artifact, total, cpu, providers, iterations from total join iter using (artifact))
select g.family, g.artifact, cast(case when bool_or(fired.severity = 'error') then 2 when bool_or(fired.severity = 'warning') then 3 else 0 end as int) as exit_code
from {ARTIFACTS} g left join fired on fired.a = g.a group by g.family, g.artifact
union all select 'ort_profile', artifact, case when iterations < 3 or (providers > 1 and round(cpu / total * 100, 2) >= 10) then 3 else 0 end from k""")
def run_logs_and_traces(spark, sf_dir):
    """Logs of four families and traces in one run, from lines and events to verdicts."""
    lines, events = v_log(spark, sf_dir), v_trace(spark, sf_dir)
    artifacts = lines.select("family", "artifact").unionByName(events.where("cat = 'Node'").select(F.lit("ort_profile").alias("family"), "artifact"))
    run = run_diagnosis(artifacts, all_facts(lines, events, staged=True))
    return run.verdicts
