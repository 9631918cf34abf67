"""Facts from profiling traces."""

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultscope.families import profile
from faultscope.families.ort import CPU
from faultscope.functions.numbers import div, ms_text, percent
from faultscope.operators.facts import as_facts
from faultscope.operators.ordered import SLICE, number_within
from faultscope.schema import FACTS
from faultscope.staging import stage

# Two bigints in one decimal, so that "longest, then earliest" is a plain max.
_HIGH = Decimal(10 ** 19)


def session_phases(events: DataFrame) -> DataFrame:
    """``(artifact, idx, phase, us, ms)``: one-time costs of a session. Other
    names, and durations that are no measurement, drop out."""
    return (events.where((F.col("cat") == "Session") & F.col("name").isin(*profile.PHASES) & F.col("dur_ok"))
            .select("artifact", "idx", F.col("name").alias("phase"), F.col("dur").alias("us"),
                    F.col("dur_text"), (F.col("dur") / 1000).alias("ms")))


def kernel_events(events: DataFrame) -> DataFrame:
    """``(artifact, idx, node, op, provider, dur)`` of every timed kernel. An event
    without arguments stays, under ``Unknown``."""
    suffix = profile.KERNEL_SUFFIX
    return (events.where((F.col("cat") == "Node") & F.col("dur_ok") & F.col("name").endswith(suffix))
            .select("artifact", "idx", F.left("name", F.length("name") - len(suffix)).alias("node"),
                    F.coalesce("op", F.lit("Unknown")).alias("op"),
                    F.coalesce("provider", F.lit("Unknown")).alias("provider"), "dur"))


def readable_op(op: Column) -> Column:
    """Label of a compiled subgraph. Exactly two shapes of names are relabelled;
    any other name is an operator's own and stays."""
    # The two shapes of names.
    as_op = r"(?U)^\d{6,}+_(\w+?)_\d{6,}+_(\d++)$"
    as_node = r"(?U)^(\w+?)_\d{6,}+_\w+?_\d{6,}+_(\d++)_\d++$"

    def label(pattern: str) -> Column:
        return F.concat(F.regexp_replace(F.regexp_extract(op, pattern, 1), "ExecutionProvider$", ""),
                        F.lit(" compiled subgraph #"), F.regexp_extract(op, pattern, 2))
    return F.when(op.rlike(as_op), label(as_op)).when(op.rlike(as_node), label(as_node)).otherwise(op)


def kernel_cube(kernels: DataFrame) -> DataFrame:
    """Events folded to ``(artifact, op, node, provider)``. Only primitive buffers:
    a hash aggregate with map-side combine, and the one shuffle of event volume."""
    longest = F.col("dur").cast("decimal(19,0)") * F.lit(_HIGH) - F.col("idx").cast("decimal(19,0)")
    return kernels.groupBy("artifact", "op", "node", "provider").agg(
        F.sum("dur").alias("us"), F.count(F.lit(1)).alias("calls"), F.min("idx").alias("first_idx"),
        F.max(longest.cast("decimal(38,0)")).alias("longest"))


def profile_rollup(cube: DataFrame) -> DataFrame:
    """One row per operator, per provider and per whole trace, each with the totals
    of its trace.

    ``level`` is ``op``, ``provider`` or ``trace``. All levels come from one pass
    over the cube by grouping sets, so nothing is computed twice. ``by_provider`` is
    null but for ``trace``.
    """
    sets = [["artifact", "op", "node"], ["artifact", "node"], ["artifact", "provider"]]
    slow = F.max(F.struct("longest", "node", "op", "provider"))
    parts = (cube.groupingSets([[F.col(c) for c in s] for s in sets], "artifact", "op", "node", "provider")
             .agg(F.sum("us").alias("us"), F.sum("calls").alias("calls"), F.min("first_idx").alias("first_idx"),
                  slow.alias("slowest"), F.grouping("op").alias("g_op"), F.grouping("node").alias("g_node"))
             .withColumn("level", F.when(F.col("g_op") == 0, "op").when(F.col("g_node") == 0, "trace").otherwise("provider"))
             .withColumn("item", F.when(F.col("g_op") == 0, F.col("op")).when(F.col("g_node") == 1, F.col("provider"))))
    rows = parts.groupBy("artifact", "level", "item").agg(
        F.sum("us").alias("us"), F.sum("calls").alias("calls"), F.count(F.lit(1)).alias("nodes"),
        F.max("calls").alias("most_calls"), F.min("first_idx").alias("first_idx"), F.max("slowest").alias("slowest"))
    # Few rows, read twice: for the totals and beside them.
    rows = stage(rows, "trace-rollup")
    is_trace, is_op, on_provider = (F.col("level") == x for x in ("trace", "op", "provider"))
    # Totals are one row per trace; operators get theirs by a join, and the list of
    # providers stays with the trace's own row.
    totals = rows.groupBy("artifact").agg(
        *[F.max(F.when(is_trace, F.col(c))).alias(name) for c, name in (("us", "total_us"), ("nodes", "unique_nodes"), ("most_calls", "iterations"), ("calls", "events"))],
        F.count_if(is_op).alias("op_types"), F.count_if(on_provider).alias("provider_count"),
        F.coalesce(F.sum(F.when(on_provider & (F.col("item") == CPU), F.col("us"))), F.lit(0)).alias("cpu_us"),
        F.array_sort(F.collect_list(F.when(on_provider, F.struct("item", "us")))).alias("providers"))
    joined = rows.join(totals, "artifact")
    return joined.withColumn("by_provider", F.map_from_entries(F.when(is_trace, F.col("providers")))).drop("providers")


def _entry(**values: Column) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def _fact(order: int, kind: str, cond: Column, anchor: Column, excerpt: Column, data: Column) -> Column:
    return F.when(cond, F.struct(F.lit(order).alias("order"), F.lit(kind).alias("kind"), anchor.alias("anchor"),
                                 excerpt.alias("excerpt"), data.alias("data")))


def rollup_facts(rollup: DataFrame) -> DataFrame:
    """``(artifact, ord, kind, anchor, excerpt, data)``: the facts of each trace in
    order: summary, few iterations, operators by cost, provider split, slowest node."""
    total, us = F.col("total_us"), F.col("us")
    trace, op = F.col("level") == "trace", F.col("level") == "op"
    summary = F.lit("summary")
    slow_us = div(F.col("slowest.longest") + F.lit(_HIGH - 1), F.lit(_HIGH))
    slow_idx = (slow_us.cast("decimal(19,0)") * F.lit(_HIGH) - F.col("slowest.longest")).cast("bigint")
    split_share = percent(F.col("cpu_us"), total)
    facts = F.array(
        _fact(0, "profile_summary", trace, summary,
              F.concat(F.col("events"), F.lit(" kernel events, "), total, F.lit(" us")),
              _entry(total_node_us=total, total_node_ms=ms_text(total), unique_nodes=F.col("unique_nodes"),
                     iterations=F.col("iterations"), op_types=F.col("op_types"))),
        _fact(1, "few_iterations", trace & (F.col("iterations") < profile.RELIABLE_ITERATIONS), summary,
              F.concat(F.lit("most events of one node: "), F.col("iterations")),
              _entry(iterations=F.col("iterations"), minimum=F.lit(profile.RELIABLE_ITERATIONS))),
        _fact(2, "op_cost", op & (us / F.nullif(total, F.lit(0)) >= profile.NOTABLE_SHARE),
              F.concat(F.lit("op:"), F.col("item")),
              F.concat(F.lit("op_name="), F.col("item"), F.lit(", "), us, F.lit(" us in "), F.col("calls"), F.lit(" event(s)")),
              _entry(op=readable_op(F.col("item")), raw_op=F.col("item"), us=us, ms=ms_text(us),
                     share_pct=percent(us, total), calls=F.col("calls"), distinct_nodes=F.col("nodes"),
                     total_node_ms=ms_text(total))),
        _fact(3, "provider_time_split", trace & (F.col("provider_count") > 1), summary,
              F.concat(F.lit("providers: "), F.array_join(F.map_keys("by_provider"), ", ")),
              _entry(providers=F.to_json("by_provider"), provider_count=F.col("provider_count"),
                     cpu_us=F.col("cpu_us"), cpu_share_pct=split_share, total_node_ms=ms_text(total))),
        _fact(4, "slowest_node", trace & (total > 0), F.concat(F.lit("events["), slow_idx, F.lit("]")),
              F.concat(F.col("slowest.node"), F.lit(": "), slow_us, F.lit(" us")),
              _entry(node=readable_op(F.col("slowest.node")), raw_node=F.col("slowest.node"),
                     op=readable_op(F.col("slowest.op")), us=slow_us, ms=ms_text(slow_us),
                     provider=F.col("slowest.provider"), share_pct=percent(slow_us, total),
                     total_node_ms=ms_text(total))))
    # At most 24 rows per trace reach the numbering: 20 operators can hold 5 % each.
    order = Window.partitionBy("artifact").orderBy("order", F.desc("us"), "first_idx")
    return (rollup.select("artifact", "us", "first_idx", F.inline(F.filter(facts, lambda f: f.isNotNull())))
            .withColumn("ord", F.row_number().over(order))
            .select("artifact", "ord", "kind", "anchor", "excerpt", "data"))


def trace_facts(events: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """All facts of traces in the facts schema: session phases in event order,
    then the rollup. ``events`` is read more than once, so stage parsed events."""
    phases = session_phases(events)
    numbered = number_within(phases.withColumn("slice", div(F.col("idx"), slice_rows)),
                             ["artifact"], ["slice"], ["idx"], "seq")
    session = numbered.select(
        "artifact", "seq", F.lit("session_phase").alias("kind"),
        F.concat(F.lit("events["), F.col("idx"), F.lit("]")).alias("anchor"),
        F.concat(F.lit('{"name": "'), F.col("phase"), F.lit('", "dur": '), F.coalesce("dur_text", F.col("us").cast("string")), F.lit("}")).alias("excerpt"),
        _entry(phase=F.col("phase"), us=F.col("us"), ms=ms_text(F.col("us"))).alias("data"))
    counts = phases.groupBy("artifact").agg(F.count(F.lit(1)).alias("n"))
    rollup = (rollup_facts(profile_rollup(kernel_cube(kernel_events(events))))
              .join(counts, "artifact", "left")
              .select("artifact", (F.coalesce("n", F.lit(0)) + F.col("ord")).alias("seq"), "kind", "anchor", "excerpt", "data"))
    both = session.unionByName(rollup).withColumn("family", F.lit(profile.NAME))
    return as_facts(both, F.col("anchor")).select(*FACTS.fieldNames())
