"""Facts and diagnoses on their way out: masking, listing, JSON documents."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultscope import __version__
from faultscope.functions.secrets import sanitize
from faultscope.functions.text import MESSAGE_LIMIT, oneline, visible
from faultscope.operators.rules import SHOWN
from faultscope.schema import KEY

# Payload keys that hold numbers, lists, objects or booleans.
TYPED_KEYS = [
    "count", "partitions", "graph_nodes", "supported", "unsupported", "cpu_node_groups", "distinct_ops",
    "outputs", "providers", "available", "accelerators", "ops", "actual",
    "raw", "live", "sticky", "unknown_bits", "healthy", "condition_keys", "bit_numbers",
    "celsius", "hertz", "mhz", "bytes", "mib",
    "us", "ms", "share_pct", "calls", "distinct_nodes", "total_node_ms", "total_node_us", "unique_nodes",
    "iterations", "op_types", "minimum", "provider_count", "cpu_us", "cpu_share_pct",
]


def redact_facts(facts: DataFrame) -> DataFrame:
    """Masked copies of excerpt, summary, source and every payload value (lists
    included), plus the ``secrets`` found per fact. The stored facts stay as they are."""
    def pick(name: str) -> Column:
        return F.col(f"_{name}.text").alias(name)
    entries = F.transform(F.map_entries("data"), lambda e: F.struct(e["key"].alias("key"), sanitize(e["value"]).alias("s")))
    clean = facts.select("*", sanitize(F.col("excerpt")).alias("_excerpt"), sanitize(F.col("summary")).alias("_summary"),
                         sanitize(F.col("source")).alias("_source"), entries.alias("_data"))
    found = F.array_sort(F.array_distinct(F.concat(
        F.col("_excerpt.kinds"), F.col("_summary.kinds"), F.col("_source.kinds"),
        F.flatten(F.transform("_data", lambda e: e["s"]["kinds"])))))
    masked = F.map_from_entries(F.transform("_data", lambda e: F.struct(e["key"], e["s"]["text"])))
    return clean.select(*KEY, "seq", "id", "kind", pick("summary"), pick("source"), pick("excerpt"),
                        masked.alias("data"), found.alias("secrets"))


def secret_kinds_of(masked: DataFrame) -> DataFrame:
    """``(family, artifact, secrets)``: sorted distinct kinds. The kinds are made distinct
    before they are collected, so 13 rows per artifact at most meet."""
    return (masked.select(*KEY, F.explode("secrets").alias("kind")).distinct()
            .groupBy(*KEY).agg(F.array_sort(F.collect_list("kind")).alias("secrets")))


def facts_listing(facts: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``(family, artifact, seq, source, kind, observation, facts)``, to be read by ``seq``.
    One of ``artifacts`` without facts is one row with the count 0: a result too."""
    counts = facts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("facts"))
    rows = facts.select(*KEY, "seq", visible(F.col("source")).alias("source"), "kind", sanitize(F.col("summary"))["text"].alias("observation"))
    # Inner and anti join instead of one outer join: Spark can split a hot artifact
    # on the facts' side of an inner join only.
    empty = artifacts.select(*KEY).distinct().join(counts, KEY, "left_anti").select(
        *KEY, *[F.lit(None).cast(t).alias(c) for c, t in rows.drop(*KEY).dtypes], F.lit(0).cast("bigint").alias("facts"))
    return rows.join(counts, KEY).unionByName(empty)


def evidence_lookup(evidence: DataFrame, facts: DataFrame) -> DataFrame:
    """Citations with their facts; an id without a fact drops out."""
    return evidence.select(*KEY, "code", "position", "id").join(facts, [*KEY, "id"])


def evidence_shown(evidence: DataFrame, facts: DataFrame, limit: int = SHOWN) -> DataFrame:
    """``(…, code, position, id, source, excerpt, hidden)``: the first facts of each
    diagnosis, and how many citations stay hidden. Ranks are per diagnosis over the
    facts that exist, so a dangling id never takes a place."""
    there = evidence_lookup(evidence, facts.select(*KEY, "id"))
    order = Window.partitionBy(*KEY, "code").orderBy("position")
    totals = evidence.groupBy(*KEY, "code").agg(F.count(F.lit(1)).alias("cited"))
    # Ranks over narrow rows; the texts join the few that are left.
    head = there.withColumn("shown", F.row_number().over(order)).where(F.col("shown") <= limit)
    return (head.join(totals, [*KEY, "code"]).join(facts.select(*KEY, "id", "source", "excerpt"), [*KEY, "id"])
            .withColumn("hidden", F.greatest(F.col("cited") - limit, F.lit(0)))
            .select(*KEY, "code", "shown", "id", "source", "excerpt", "hidden"))


def typed_payload(data: Column) -> Column:
    """map<string,variant>: numbers as numbers and lists as lists, for JSON."""
    return F.transform_values(data, lambda k, v: F.coalesce(
        F.when(k.isin(*TYPED_KEYS), F.try_parse_json(v)), v.cast("variant")))


def mask_diagnoses(diagnoses: DataFrame) -> DataFrame:
    """Messages and causes as one safe line each: masked as well, because a message
    holds payload values."""
    return (diagnoses.withColumn("message", oneline(sanitize(F.col("message"))["text"], MESSAGE_LIMIT))
            .withColumn("root_cause", sanitize(F.col("root_cause"))["text"]))


_HEAD = ("schemaVersion", "tool", "backend", "name", "redacted", "secretsDetected")
_DIAGNOSIS = ("code", "proposal", "severity", "message", "root_cause", "suggestions", "cited", "confidence", "insufficient_info", "origin")


def _fact() -> Column:
    return F.struct("id", "kind", "summary", "source", "excerpt", typed_payload(F.col("data")).alias("data"))


def _prepared(facts: DataFrame, diagnoses: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """What goes into a report, fit to be shown, and whether it is masked."""
    redact = "secrets" in facts.columns
    if redact:
        diagnoses = mask_diagnoses(diagnoses)
    else:
        facts = facts.withColumns({c: visible(F.col(c)) for c in ("excerpt", "summary", "source")})
        facts = facts.withColumn("secrets", F.array().cast("array<string>"))
    if "proposal" not in evidence.columns:
        evidence = evidence.withColumn("proposal", F.lit(0).cast("bigint"))

    return facts, diagnoses, evidence, redact


def _heads(artifacts: DataFrame, facts: DataFrame, redact: bool) -> DataFrame:
    """One row per artifact with the fields of a report's header."""
    counts = facts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    name = sanitize(F.col("artifact"), redact)["text"] if redact else visible(F.col("artifact"))
    head = artifacts.select(*KEY).distinct().join(counts, KEY, "left").join(secret_kinds_of(facts), KEY, "left")
    return head.select(
        *KEY, F.lit(1).alias("schemaVersion"), F.struct(F.lit("faultscope").alias("name"), F.lit(__version__).alias("version")).alias("tool"),
        F.col("family").alias("backend"), name.alias("name"), F.lit(redact).alias("redacted"),
        F.coalesce("secrets", F.array().cast("array<string>")).alias("secretsDetected"), F.coalesce("n", F.lit(0)).alias("facts"))


def report_fragments(artifacts: DataFrame, facts: DataFrame, diagnoses: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(family, artifact, section, at, pos, element, ends, text)``: one JSON document per artifact,
    in pieces of one diagnosis, citation or fact, for ``report_files.write_documents``.

    ``{schemaVersion, tool, backend, artifact, redacted, secretsDetected, diagnostics, facts}``; every
    diagnosis lists the ids of its evidence. Masking is as in ``report_json``.
    """
    facts, diagnoses, evidence, redact = _prepared(facts, diagnoses, evidence)
    last = (1 << 62)

    def part(df: DataFrame, section: int, at: Column, pos: Column, element: bool, ends: bool, text: Column) -> DataFrame:
        return df.select(*KEY, F.lit(section).alias("section"), at.cast("bigint").alias("at"), pos.cast("bigint").alias("pos"),
                         F.lit(element).alias("element"), F.lit(ends).alias("ends"), text.alias("text"))

    def opened(body: Column, name: str) -> Column:
        """An object without its closing brace, and a list begun in it."""
        return F.concat(F.regexp_replace(F.to_json(body), r"\}$", ""), F.lit(f',"{name}":['))

    zero, rank = F.lit(0), F.col("rank")
    heads = _heads(artifacts, facts, redact)
    ranks = diagnoses.select(*KEY, "code", "proposal", "rank")
    cites = evidence.select(*KEY, "code", "proposal", "position", "id").join(ranks, [*KEY, "code", "proposal"])
    fields = [F.col("name").alias("artifact") if c == "name" else F.col(c) for c in _HEAD]
    pieces = [
        part(heads, 0, zero, zero, False, False, opened(F.struct(*fields), "diagnostics")),
        part(diagnoses, 1, rank, zero, True, False, opened(F.struct(*_DIAGNOSIS), "evidence")),
        part(cites, 1, rank, F.col("position"), True, True, F.to_json(F.array("id")).substr(F.lit(2), F.length(F.to_json(F.array("id"))) - 2)),
        part(diagnoses, 1, rank, F.lit(last), False, True, F.lit("]}")),
        part(heads, 2, zero, zero, False, False, F.lit('],"facts":[')),
        part(facts, 3, F.col("seq"), zero, True, True, F.to_json(_fact())),
        part(heads, 4, zero, zero, False, False, F.lit("]}\n")),
    ]
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionByName(piece)
    return out


def report_json(artifacts: DataFrame, facts: DataFrame, diagnoses: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(family, artifact, section, at, pos, json)``: a report as strictly valid JSON lines,
    read in the order of section, at, pos.

    Section 0 is the header of an artifact, 1 its diagnostics by rank, 2 their citations
    (``at`` is the proposal, 0 for rules), 3 its facts. The layout is the same for one
    fact and for a billion: nothing is gathered into an array, and only the header, one
    row per artifact, takes a join.

    ``facts`` from ``redact_facts`` give a masked report; plain facts give a verbatim
    one, with control characters shown. Hand in stored tables: facts are read three times.
    """
    facts, diagnoses, evidence, redact = _prepared(facts, diagnoses, evidence)

    def rows(df: DataFrame, section: int, at: Column, pos: Column, body: Column) -> DataFrame:
        return df.select(*KEY, F.lit(section).alias("section"), at.cast("bigint").alias("at"), pos.cast("bigint").alias("pos"), F.to_json(body).alias("json"))

    zero = F.lit(0)
    head = _heads(artifacts, facts, redact)
    head = rows(head, 0, zero, zero, F.struct(*[F.col("name").alias("artifact") if c == "name" else F.col(c) for c in _HEAD], "facts"))
    found = rows(diagnoses, 1, F.col("rank"), zero, F.struct(*_DIAGNOSIS))
    cites = rows(evidence, 2, F.col("proposal"), F.col("position"), F.struct("code", "proposal", "position", F.col("id").alias("fact")))
    seen = rows(facts, 3, F.col("seq"), zero, _fact())
    return head.unionByName(found).unionByName(cites).unionByName(seen)
