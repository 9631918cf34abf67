"""Proposals written by a model: admitted only when every citation resolves."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.functions.secrets import sanitize
from faultscope.functions.text import strip_unicode
from faultscope.operators.rules import SEVERITIES, SHOWN
from faultscope.schema import KEY

# How a synthesized finding is labelled.
CODE = "ED9001"
ORIGIN = "llm"
CONFIDENCE = "medium"
SUGGESTIONS = 4


def unmatched_facts(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Facts that no diagnosis cites: all that a proposal may build on. The join key
    holds the fact id, so a hot artifact does not land in one task."""
    return facts.join(evidence.select(*KEY, "id"), [*KEY, "id"], "left_anti")


def ground(proposals: DataFrame, unmatched: DataFrame) -> DataFrame:
    """Proposals with a message and at least one citation, all of them unmatched
    facts of the same artifact. Nothing is repaired: one invented citation and the
    proposal is out."""
    usable = proposals.where(~F.coalesce("insufficient_info", F.lit(False)) & (F.size("evidence") > 0)
                             & (strip_unicode(F.col("message")) != ""))
    cited = usable.select(*KEY, "proposal", F.explode(F.array_distinct("evidence")).alias("id"))
    known = unmatched.select(*KEY, "id", F.lit(True).alias("known"))
    sound = (cited.join(known, [*KEY, "id"], "left")
             .groupBy(*KEY, "proposal").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("sound"))
             .where("sound").drop("sound"))
    return usable.join(sound, [*KEY, "proposal"])


def label_synthesized(grounded: DataFrame) -> DataFrame:
    """Grounded proposals in the diagnoses schema, marked so that they never pass for
    a reviewed rule. Identity, confidence and applicability are set here."""
    evidence = F.array_sort(F.array_distinct("evidence"))
    suggestions = F.transform(
        F.filter(F.slice("suggestions", 1, SUGGESTIONS), lambda s: strip_unicode(s["summary"]) != ""),
        lambda s: F.struct(s["summary"].alias("summary"), s["command"].alias("command"), F.lit("maybe-incorrect").alias("applicability")))
    severity = F.when(F.col("severity").isin(*SEVERITIES), F.col("severity")).otherwise("warning")
    return grounded.select(
        *KEY, F.col("proposal").cast("int").alias("rank"), F.lit(CODE).alias("code"), severity.alias("severity"), "message",
        "root_cause", suggestions.alias("suggestions"), F.slice(evidence, 1, SHOWN).alias("shown"),
        F.size(evidence).cast("bigint").alias("cited"), F.lit(CONFIDENCE).alias("confidence"),
        F.lit(False).alias("insufficient_info"), F.lit(ORIGIN).alias("origin"), F.col("proposal").cast("bigint").alias("proposal"))


def synthesized_evidence(grounded: DataFrame) -> DataFrame:
    """Citations of grounded proposals: ``(…, code, proposal, position, id)``."""
    ids = F.array_sort(F.array_distinct("evidence"))
    return (grounded.select(*KEY, F.lit(CODE).alias("code"), "proposal", F.posexplode(ids).alias("pos", "id"))
            .select(*KEY, "code", "proposal", (F.col("pos") + 1).cast("bigint").alias("position"), "id"))


def merge_evidence(evidence: DataFrame, synthesized: DataFrame) -> DataFrame:
    """Citations of rules (proposal 0) and of grounded proposals in one table."""
    cols = [*KEY, "code", "proposal", "position", "id"]
    return evidence.withColumn("proposal", F.lit(0).cast("bigint")).select(*cols).unionByName(synthesized.select(*cols))


def merge_synthesized(diagnoses: DataFrame, synthesized: DataFrame) -> DataFrame:
    """Diagnoses of rules, then the synthesized ones behind them."""
    last = diagnoses.groupBy(*KEY).agg(F.max("rank").alias("_last"))
    behind = (synthesized.join(last, KEY, "left")
              .withColumn("rank", F.col("rank") + F.coalesce("_last", F.lit(0))).drop("_last"))
    return diagnoses.unionByName(behind.select(*diagnoses.columns))


def masked_payload(unmatched: DataFrame) -> DataFrame:
    """``(family, artifact, name, seq, text, secrets)``: the text block of each fact, for a
    later batch model call that takes as many as fit, in the order of ``seq``. Everything
    that leaves is masked, the artifact's name too. One row per fact: no size of an
    artifact changes the layout."""
    rows = unmatched.select(
        *KEY, "seq", "id", "kind", F.size("data").alias("keys"), sanitize(F.col("artifact")).alias("n"),
        sanitize(F.col("summary")).alias("s"), sanitize(F.col("source")).alias("c"),
        sanitize(F.col("excerpt")).alias("e"), sanitize(F.to_json("data")).alias("d"))
    block = F.concat(
        F.lit("- id: "), "id", F.lit("\n  kind: "), "kind", F.lit("\n  observed: "), "s.text",
        F.lit("\n  source: "), "c.text", F.lit("\n  log line: "), "e.text",
        F.when(F.col("keys") > 0, F.concat(F.lit("\n  data: "), F.col("d.text"))).otherwise(""))
    found = F.array_sort(F.array_distinct(F.flatten(F.array("s.kinds", "c.kinds", "e.kinds", "d.kinds"))))
    return rows.select(*KEY, F.col("n.text").alias("name"), "seq", block.alias("text"), found.alias("secrets"))
