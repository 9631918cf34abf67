"""Facts about the relation between the lines of one session log."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultscope.families.ort import CPU
from faultscope.operators.facts import as_facts
from faultscope.schema import FACTS, KEY


def session_overview(resolved: DataFrame) -> DataFrame:
    """One row per ONNX Runtime log: what was placed where, what was asked for
    and what came of it. Facts first fold to a row per provider placed on and per operator
    on the CPU, so distinct names are found on many tasks; the lists hold each name once."""
    kind, data = F.col("kind"), F.col("data")
    placed = kind == "node_placement"
    on_cpu = (kind == "node_on_provider") & (data["provider"] == CPU)

    def first(cond: Column, name: str, **more: Column) -> Column:
        return F.min(F.when(cond, F.struct("seq", "lineno", "excerpt", *[c.alias(n) for n, c in more.items()]))).alias(name)

    firsts = ("placement", "cpu_node", "unavailable", "sessions")
    folded = (resolved.where(F.col("family") == "onnxruntime")
              .groupBy(*KEY, F.when(placed, data["provider"]).alias("provider"), F.when(on_cpu, data["op"]).alias("cpu_op")).agg(
                  F.count(F.lit(1)).alias("line_facts"), F.count_if(on_cpu).alias("cpu_nodes"),
                  F.sum(F.when(placed & (data["provider"] == CPU), data["count"].try_cast("decimal(38,0)"))).alias("cpu_groups"),
                  first(placed, "placement"), first(on_cpu, "cpu_node", op=data["op"]),
                  first(kind == "provider_unavailable", "unavailable", requested=data["requested"]), first(kind == "session_providers", "sessions", active=data["providers"])))
    return folded.groupBy(*KEY).agg(
        F.sum("line_facts").alias("line_facts"), F.sum("cpu_nodes").alias("cpu_nodes"), F.coalesce(F.sum("cpu_groups"), F.lit(0)).alias("cpu_groups"),
        F.array_sort(F.collect_list("provider")).alias("providers"), F.array_sort(F.collect_list("cpu_op")).alias("cpu_ops"),
        *[F.min(c).alias(c) for c in firsts]).withColumn("active", F.col("sessions.active"))


def _splits(o: str = "providers") -> Column:
    return (F.size(o) > 1) & F.array_contains(o, CPU)


def _text_map(**entries: Column) -> Column:
    return F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v.cast("string"))])


def split_execution(overview: DataFrame) -> Column:
    """The graph is on several providers and the CPU is one of them."""
    return F.when(_splits(), F.struct(
        F.lit("split_execution").alias("kind"), F.col("placement.lineno").alias("lineno"),
        F.col("placement.excerpt").alias("excerpt"),
        _text_map(providers=F.to_json("providers"),
                  accelerators=F.to_json(F.array_remove("providers", CPU)),
                  cpu_node_groups=F.col("cpu_groups")).alias("data")))


def cpu_fallback_ops(overview: DataFrame) -> Column:
    """Nodes on the CPU beside another provider. ``count`` counts node lines,
    ``distinct_ops`` the operators among them."""
    return F.when((F.col("cpu_nodes") > 0) & (F.size("providers") > 1), F.struct(
        F.lit("cpu_fallback_ops").alias("kind"), F.col("cpu_node.lineno").alias("lineno"),
        F.col("cpu_node.excerpt").alias("excerpt"),
        _text_map(ops=F.to_json("cpu_ops"), count=F.col("cpu_nodes"), first_op=F.col("cpu_node.op"),
                  distinct_ops=F.size("cpu_ops")).alias("data")))


def silent_cpu_only(overview: DataFrame) -> Column:
    """A provider was asked for and missing, and the session has the CPU alone."""
    return F.when(F.col("unavailable").isNotNull() & (F.col("active") == F.to_json(F.array(F.lit(CPU)))), F.struct(
        F.lit("silent_cpu_only").alias("kind"), F.col("unavailable.lineno").alias("lineno"),
        F.col("unavailable.excerpt").alias("excerpt"),
        _text_map(requested=F.col("unavailable.requested"), actual=F.col("active")).alias("data")))


def derive_facts(resolved: DataFrame) -> DataFrame:
    """The derived facts in the facts schema, numbered behind the line facts."""
    overview = session_overview(resolved)
    found = F.filter(F.array(split_execution(overview), cpu_fallback_ops(overview), silent_cpu_only(overview)),
                     lambda s: s.isNotNull())
    rows = (overview.select(*KEY, "line_facts", F.posexplode(found).alias("pos", "f"))
            .select(*KEY, (F.col("line_facts") + F.col("pos") + 1).alias("seq"), "f.*"))
    return as_facts(rows, F.col("lineno")).select(*FACTS.fieldNames())


def first_divergence(facts: DataFrame) -> DataFrame:
    """Per comparison log: the first name of the first printed list, the first
    diverging tensor by line, and how many tensors diverged."""
    kind, data, seq = F.col("kind"), F.col("data"), F.col("seq")
    listed = kind == "mismatched_outputs"
    failed = kind == "output_mismatch"
    per_output = (facts.where((F.col("family") == "polygraphy") & (listed | failed))
                  .groupBy(*KEY, F.when(failed, data["output"]).alias("output"))
                  .agg(F.min(F.when(failed, seq)).alias("seq"),
                       F.min_by(F.struct(data["first_output"].alias("name"), data["count"].cast("bigint").alias("n")),
                                F.when(listed, seq)).alias("list"),
                       F.min(F.when(listed, seq)).alias("list_seq")))
    return per_output.groupBy(*KEY).agg(
        F.min_by("list", "list_seq").alias("list"), F.min_by("output", "seq").alias("first_mismatch"),
        F.count("output").alias("diverged")).select(
            *KEY, F.col("list.name").alias("first_listed"), F.col("list.n").alias("listed"), "first_mismatch", "diverged")
