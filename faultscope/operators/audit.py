"""Data-quality checks: each returns the rows that break a promise."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultscope.families import FAMILIES, profile
from faultscope.functions.paths import find_machine_paths
from faultscope.functions.secrets import secret_kinds
from faultscope.functions.sql import literal
from faultscope.functions.text import strip_unicode
from faultscope.operators.rules import SEVERITIES
from faultscope.schema import KEY
from faultscope.staging import stage


def audit_citations(facts: DataFrame, lines: DataFrame) -> DataFrame:
    """Facts whose cited line does not exist or is not the excerpt, and facts of text
    families that cite no line. The join key holds the line number, so one artifact
    spreads over all tasks; of a line only its length and hash travel."""
    def mark(text: Column) -> Column:
        return F.struct(F.length(text), F.xxhash64(text))

    cited = facts.select(*KEY, "id", mark(F.col("excerpt")).alias("_excerpt"), F.substring_index("source", ":", -1).try_cast("bigint").alias("lineno"))
    truth = lines.select(*KEY, "lineno", mark(strip_unicode(F.col("line"))).alias("_line"))
    unnumbered = cited.where(F.col("lineno").isNull() & (F.col("family") != profile.NAME)).select(*KEY, "id", F.lit("no line number").alias("problem"))
    return (cited.where(F.col("lineno").isNotNull()).join(truth, [*KEY, "lineno"], "left")
            .select(*KEY, "id", F.when(F.col("_line").isNull(), "no such line")
                    .when(F.col("_line") != F.col("_excerpt"), "other text").alias("problem"))
            .where(F.col("problem").isNotNull()).unionByName(unnumbered))


def audit_evidence(diagnoses: DataFrame, evidence: DataFrame, facts: DataFrame) -> DataFrame:
    """Dangling ids, diagnoses without evidence, ids cited twice."""
    key = [*KEY, "code"]
    dangling = evidence.join(facts.select(*KEY, "id"), [*KEY, "id"], "left_anti").select(*key, "id", F.lit("dangling").alias("problem"))
    empty = (diagnoses.join(evidence.select(*key).distinct(), key, "left_anti")
             .select(*key, F.lit(None).cast("string").alias("id"), F.lit("no evidence").alias("problem")))
    twice = (evidence.groupBy(*key, "id").count().where("count > 1").select(*key, "id", F.lit("cited twice").alias("problem")))
    return dangling.unionByName(empty).unionByName(twice)


def audit_messages(diagnoses: DataFrame) -> DataFrame:
    """Open placeholders or printed lists in messages, unknown severities, wrong order."""
    from pyspark.sql import Window

    from faultscope.operators.rules import severity_rank
    before = F.lag(severity_rank(F.col("severity"))).over(Window.partitionBy(*KEY).orderBy("rank"))
    checked = diagnoses.select(*KEY, "code", "rank", F.array_compact(F.array(
        F.when(F.col("message").rlike(r"\{\w+\}"), "open placeholder"),
        F.when(F.col("message").rlike(r"\[['\"]"), "printed list"),
        F.when(~F.col("severity").isin(*SEVERITIES), "unknown severity"),
        F.when(before > severity_rank(F.col("severity")), "wrong order"))).alias("problems"))
    return checked.select(*KEY, "code", "rank", F.explode("problems").alias("problem"))


def signature_hits(lines: DataFrame) -> DataFrame:
    """``(family, signature, lines)``: how many lines each pattern matches, every pattern on
    its own and not only the first that wins."""
    branches = []
    for f in FAMILIES.values():
        each = ", ".join(f"case when {s.matches('line')} then {i} end" for i, s in enumerate(f.signatures))
        branches.append(f"when {literal(f.name)} then array({each})")
    all_hits = F.expr(f"case family {' '.join(branches)} end")
    return (lines.select("family", F.explode(F.array_compact(all_hits)).alias("signature"))
            .groupBy("family", "signature").agg(F.count(F.lit(1)).alias("lines")))


def signature_table(spark) -> DataFrame:
    rows = [f"('{f.name}', {i}, '{s.kind}')" for f in FAMILIES.values() for i, s in enumerate(f.signatures)]
    return spark.sql(f"select * from values {', '.join(rows)} as t(family, signature, kind)")


def signature_coverage(lines: DataFrame, awaiting: list[tuple[str, int]] = ()) -> DataFrame:
    """``(family, signature, kind, problem)``: signatures that match no line and are not
    awaited, and awaited ones that a line matches after all."""
    table = signature_table(lines.sparkSession)
    awaited = reduce(lambda acc, a: acc | ((F.col("family") == a[0]) & (F.col("signature") == a[1])), awaiting, F.lit(False))
    return (table.join(signature_hits(lines), ["family", "signature"], "left")
            .select("family", "signature", "kind",
                    F.when(F.col("lines").isNull() & ~awaited, "no line").when(F.col("lines").isNotNull() & awaited, "stale").alias("problem"))
            .where(F.col("problem").isNotNull()))


def rule_lint(rules: DataFrame) -> DataFrame:
    """``(family, code, problem)`` of a rule table. A rule table is small, so no hot group
    arises; duplicates and shared prefixes are found by aggregates."""
    code = F.col("id")
    bad_condition = F.exists("conditions", lambda c: ~c["ok"] | (c["lo"].isNull() & c["hi"].isNull()))
    foreign = F.exists("conditions", lambda c: ~F.array_contains(F.concat("requires", "optional"), c["kind"]))
    checks = {
        "code format": ~code.rlike(r"^ED\d{4}$"),
        "requires and forbids": F.arrays_overlap("requires", "absent"),
        "condition without bound": bad_condition,
        "condition on foreign kind": foreign,
        "no command to apply": F.exists("suggestions", lambda s: (s["applicability"] == "machine-applicable") & (F.trim(s["command"]) == "")),
        "no suggestion": F.size("suggestions") == 0,
        "no reference": ~F.exists("refs", lambda r: r.startswith("http")),
    }
    single = rules.select("family", code.alias("code"), F.explode(F.array_compact(F.array(
        *[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in checks.items()]))).alias("problem"))
    twice = rules.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"), F.min("family").alias("family")).where("n > 1")
    prefix = (rules.where(code.rlike(r"^ED\d{4}$")).select(F.left(code, F.lit(4)).alias("code"), "family").distinct()
              .groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("family").alias("family")).where("n > 1"))
    return (single.unionByName(twice.select("family", "code", F.lit("duplicate code").alias("problem")))
            .unionByName(prefix.select("family", "code", F.lit("prefix shared by families").alias("problem"))))


def payload_keys(facts: DataFrame) -> DataFrame:
    """``(family, kind, key)`` observed, with the number of facts that carry it."""
    return (facts.select("family", "kind", F.explode(F.map_keys("data")).alias("key"))
            .groupBy("family", "kind", "key").agg(F.count(F.lit(1)).alias("facts")))


def rule_payload_coverage(rules: DataFrame, facts: DataFrame) -> DataFrame:
    """``(family, code, use, name)``: condition fields and placeholders that no observed fact
    of the rule's own kinds carries."""
    known = payload_keys(facts).select("family", "kind", F.col("key").alias("name"))
    fields = rules.select("family", F.col("id").alias("code"), F.explode("conditions").alias("c")).select(
        "family", "code", F.lit("condition").alias("use"), F.array("c.kind").alias("kinds"), F.col("c.field").alias("name"))
    marks = rules.select("family", F.col("id").alias("code"), F.lit("placeholder").alias("use"),
                         F.array_distinct(F.concat("requires", "optional")).alias("kinds"),
                         F.explode(F.transform(F.filter("segments", lambda s: s["key"].isNotNull()), lambda s: s["key"])).alias("name"))
    uses = fields.unionByName(marks).distinct()
    carried = (uses.select("family", "code", "use", "name", F.explode("kinds").alias("kind"))
               .join(known, ["family", "kind", "name"], "left_semi").select("family", "code", "use", "name").distinct())
    return uses.select("family", "code", "use", "name").join(carried, ["family", "code", "use", "name"], "left_anti").distinct()


def rule_activity(rules: DataFrame, facts: DataFrame, fired: DataFrame) -> DataFrame:
    """``(family, name, problem)``: kinds that rules ask for and nobody observed, and
    rules that never fire."""
    asked = rules.select("family", F.explode(F.array_distinct(F.concat("requires", "absent", "optional"))).alias("name")).distinct()
    seen = facts.select("family", F.col("kind").alias("name")).distinct()
    silent = rules.select("family", F.col("id").alias("name")).join(
        fired.select("family", F.col("code").alias("name")).distinct(), ["family", "name"], "left_anti")
    return (asked.join(seen, ["family", "name"], "left_anti").withColumn("problem", F.lit("kind never observed"))
            .unionByName(silent.withColumn("problem", F.lit("rule never fires"))))


# Keys every sidecar must have.
REQUIRED_LABELS = ("command", "outcome", "root cause")


def corpus_hygiene(artifacts: DataFrame, labels: DataFrame, required: tuple[str, ...] = REQUIRED_LABELS) -> DataFrame:
    """``(artifact, problem)``: artifacts without labels, labels that lack a required key
    (as a prefix), and machine paths left in the text."""
    name = artifacts.select("artifact").distinct()
    unlabelled = name.join(labels.select("artifact").distinct(), "artifact", "left_anti").withColumn("problem", F.lit("no label"))
    have = labels.groupBy("artifact").agg(*[F.max(F.col("key").startswith(k) & (F.trim("value") != "")).alias(k) for k in required])
    lacking = have.select("artifact", F.explode(F.array_compact(F.array(
        *[F.when(~F.col(k), F.lit(f"lacks {k}")) for k in required]))).alias("problem"))
    paths = artifacts.where(F.size(find_machine_paths(F.col("text"))) > 0).select("artifact", F.lit("machine path").alias("problem"))
    return unlabelled.unionByName(lacking).unionByName(paths)


def fact_digests(facts: DataFrame) -> DataFrame:
    """``(family, artifact, n, total, parity, second0, second1)``: a digest of an artifact's facts that does not
    depend on their order: their number, sum and exclusive-or of row hashes, and a second
    sum over hashes of another seed. Equal rows count as often as they occur."""
    row = F.struct("id", "kind", "source", F.array_sort(F.map_entries("data")))
    one, two = F.xxhash64(row), F.xxhash64(F.lit("again"), row)
    halves = [F.shiftrightunsigned(two, 32), two.bitwiseAND(0xFFFFFFFF)]
    return facts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.sum(one.cast("decimal(20,0)")).alias("total"), F.bit_xor(one).alias("parity"),
                                   *[F.sum(h.cast("decimal(20,0)")).alias(f"second{k}") for k, h in enumerate(halves)])


def changed_artifacts(first: DataFrame, second: DataFrame) -> DataFrame:
    """``(family, artifact)`` whose digests differ, or that only one run has."""
    a, b = fact_digests(first), fact_digests(second)
    kept = [c for c in a.columns if c not in KEY]
    both = a.select(*KEY, F.struct(*kept).alias("a")).join(b.select(*KEY, F.struct(*kept).alias("b")), KEY, "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select(*KEY)


def determinism(first: DataFrame, second: DataFrame) -> DataFrame:
    """Facts of either run that the other lacks, and ids given twice.

    Artifacts are compared by digests, one row each; facts are compared row by row only
    inside artifacts whose digests differ. Equal digests of different facts would take the
    same count and three sums of hashes with two seeds.
    """
    suspects = stage(changed_artifacts(first, second), "changed-artifacts")

    def flat(facts: DataFrame) -> DataFrame:
        inside = facts.join(suspects, KEY, "left_semi")
        return inside.select(*KEY, "id", "kind", "source", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("data")))).alias("payload"))
    a, b = flat(first), flat(second)
    lost, extra = a.exceptAll(b).select(*KEY, "id"), b.exceptAll(a).select(*KEY, "id")
    twice = first.groupBy(*KEY, "id").count().where("count > 1").select(*KEY, "id")
    return (lost.withColumn("problem", F.lit("only in the first run"))
            .unionByName(extra.withColumn("problem", F.lit("only in the second run")))
            .unionByName(twice.withColumn("problem", F.lit("id given twice"))))


def false_positive_audit(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """``(family, artifact, facts, secrets)`` of text that should hold neither. ``lines`` is
    prose labelled with the family whose signatures are tried."""
    secret_lines = (lines.select(*KEY, F.size(secret_kinds(F.col("line"))).alias("n")).where("n > 0")
                    .groupBy(*KEY).agg(F.count(F.lit(1)).alias("secrets")))
    found = facts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("facts"))
    return found.join(secret_lines, KEY, "full").fillna(0, ["facts", "secrets"]).select(*KEY, "facts", "secrets")
