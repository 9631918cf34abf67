"""Rules against facts."""

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultscope.functions.numbers import div, finite_number
from faultscope.operators.ordered import SLICE, number_within
from faultscope.operators.rule_match import match_named, named_profile
from faultscope.schema import KEY
from faultscope.sources.rulebook import Rulebook, RuleTable

# Severities in the order of a report.
SEVERITIES = ("error", "warning", "info")
SHOWN = 4


def severity_rank(severity: Column) -> Column:
    out = F.lit(9)
    for i, name in enumerate(SEVERITIES):
        out = F.when(severity == name, i).otherwise(out)
    return out


def within(value: Column, lo: Column | float | None, hi: Column | float | None) -> Column:
    """Inclusive bounds on a numeric text; no number, NaN or infinity is never within."""
    number = finite_number(value)
    ok = number.isNotNull()
    if lo is not None:
        ok = ok & (F.coalesce(number >= lo, F.lit(True)) if isinstance(lo, Column) else (number >= lo))
    if hi is not None:
        ok = ok & (F.coalesce(number <= hi, F.lit(True)) if isinstance(hi, Column) else (number <= hi))
    return F.coalesce(ok, F.lit(False))


def conditions_met(book: Rulebook, word: int = 0) -> Column:
    """Bits, in one mask word, of the conditions that one fact meets."""
    out = F.lit(0).cast("bigint")
    for family in book.families:
        for text, (at, bit) in book.condition_bits(family).items():
            c = json.loads(text)
            if c["ok"] and at == word:
                hit = (F.col("family") == family) & (F.col("kind") == c["kind"]) & within(F.col("data")[c["field"]], c["lo"], c["hi"])
                out = out.bitwiseOR(F.when(hit, F.lit(bit)).otherwise(F.lit(0)).cast("bigint"))
    return out


def artifact_profile(facts: DataFrame, book: Rulebook | RuleTable) -> DataFrame:
    """``(family, artifact, kinds, met, facts)``: all that rule matching asks about an
    artifact, in two masks of a few words and a number. A hash aggregate with map-side
    combine: an artifact with a third of all facts sends one row per task. For a
    ``RuleTable`` the profile is rows (``rule_match.named_profile``)."""
    if isinstance(book, RuleTable):
        return named_profile(facts, book)
    words = range(book.words)
    masks = facts.groupBy(*KEY).agg(
        *[F.bit_or(book.kind_bit(F.col("family"), F.col("kind"), w)).alias(f"_kinds{w}") for w in words],
        *[F.bit_or(conditions_met(book, w)).alias(f"_met{w}") for w in words],
        F.max("seq").alias("facts"))
    return masks.select(*KEY, F.array(*[f"_kinds{w}" for w in words]).alias("kinds"), F.array(*[f"_met{w}" for w in words]).alias("met"), "facts")


def covers(mask: Column | str, wanted: Column | str) -> Column:
    """Whether a mask has every bit of another."""
    return F.forall(F.zip_with(mask, wanted, lambda m, w: m.bitwiseAND(w) == w), lambda x: x)


def meets(mask: Column | str, other: Column | str) -> Column:
    """Whether two masks have a bit in common."""
    return F.exists(F.zip_with(mask, other, lambda m, o: m.bitwiseAND(o) != 0), lambda x: x)


def asks(mask: Column | str) -> Column:
    """Whether a mask has any bit."""
    return F.exists(mask, lambda w: w != 0)


def match_rules(profile: DataFrame, book: Rulebook | RuleTable) -> DataFrame:
    """``(family, artifact, code, ord, severity, facts)`` of every rule that fires: all
    required kinds there, no forbidden one, every condition met by some fact. A
    rule that requires nothing never fires."""
    if isinstance(book, RuleTable):
        return match_named(profile, book)
    rules = book.table(profile.sparkSession).select("family", F.col("id").alias("code"), "ord", "severity", "need", "bar", "meet")
    return (profile.join(rules, "family")
            .where(asks("need") & covers("kinds", "need") & ~meets("kinds", "bar") & covers("met", "meet"))
            .select(*KEY, "code", "ord", "severity", "facts"))


def cited_facts(facts: DataFrame, fired: DataFrame, book: Rulebook | RuleTable, slice_rows: int = SLICE) -> DataFrame:
    """Every fact that a fired rule cites, with its order group.

    The roles are broadcast. The fired rules are one row per artifact and rule, so
    they are repeated per slice of the artifact and joined on the slice: the facts
    of a hot artifact spread over many tasks.
    """
    roles = book.roles(facts.sparkSession).drop("ord")
    sliced = fired.select(*KEY, "code", F.explode(F.sequence(F.lit(0).cast("bigint"), div(F.col("facts") - 1, slice_rows))).alias("slice"))
    return (facts.join(roles, ["family", "kind"])
            .withColumn("slice", div(F.col("seq") - 1, slice_rows))
            .join(sliced, [*KEY, "code", "slice"], "left_semi")
            .select(*KEY, "code", "grp", "slice", "seq", "id", "kind", "data", "keys", "conditions"))


def gather_evidence(cited: DataFrame) -> DataFrame:
    """``(family, artifact, code, position, id, seq, kind)``: required facts first, then
    each optional kind in its declared order. One row per citation and no array,
    so a rule may cite any number of facts."""
    narrow = cited.select(*KEY, "code", "grp", "slice", "seq", "id", "kind")
    return (number_within(narrow, [*KEY, "code"], ["grp", "slice"], ["seq"], "position")
            .select(*KEY, "code", F.col("position").cast("bigint").alias("position"), "id", "seq", "kind"))


def resolve_placeholders(cited: DataFrame, prefer_met: bool = False) -> DataFrame:
    """``(family, artifact, code, key, value)``: the first cited fact that has the key
    wins. With ``prefer_met``, facts that meet the rule's own condition come first,
    so that a message shows the number the rule fired on."""
    met = F.exists("conditions", lambda c: c["ok"] & within(F.try_element_at("data", c["field"]), c["lo"], c["hi"]))
    order = F.struct(*([(~met).alias("m")] if prefer_met else []), F.col("grp"), F.col("seq"))
    return (cited.select(*KEY, "code", order.alias("at"), "data", F.explode("keys").alias("key"))
            .where(F.map_contains_key("data", F.col("key")))
            .groupBy(*KEY, "code", "key").agg(F.min_by(F.col("data")[F.col("key")], "at").alias("value")))


def render_messages(fired: DataFrame, values: DataFrame, book: Rulebook | RuleTable) -> DataFrame:
    """``(family, artifact, code, message)``; a placeholder nobody fills stays visible."""
    maps = values.groupBy(*KEY, "code").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("values"))
    rules = book.table(fired.sparkSession).select("family", F.col("id").alias("code"), "ord", "segments")
    text = F.concat_ws("", F.transform("segments", lambda s: F.coalesce(
        s["lit"], F.try_element_at("values", s["key"]), F.concat(F.lit("{"), s["key"], F.lit("}")))))
    return (fired.select(*KEY, "code", "ord").join(rules, ["family", "code", "ord"])
            .join(maps, [*KEY, "code"], "left")
            .select(*KEY, "code", text.alias("message")))


def rank_diagnoses(fired: DataFrame) -> DataFrame:
    """Position in the report: by severity, then in rule order."""
    order = Window.partitionBy(*KEY).orderBy(severity_rank(F.col("severity")), "ord")
    return fired.withColumn("rank", F.row_number().over(order))


def diagnose(facts: DataFrame, book: Rulebook | RuleTable, fired: DataFrame | None = None, evidence: DataFrame | None = None,
             slice_rows: int = SLICE, prefer_met: bool = False, cited: DataFrame | None = None) -> DataFrame:
    """The diagnoses of every artifact; an artifact no rule explains has none.

    Citations stay in their own table (``gather_evidence``); here are their number
    and the first few. Every input is read more than once: hand in stored tables.
    """
    fired = match_rules(artifact_profile(facts, book), book) if fired is None else fired
    cited = cited_facts(facts, fired, book, slice_rows) if cited is None else cited
    evidence = gather_evidence(cited) if evidence is None else evidence
    messages = render_messages(fired, resolve_placeholders(cited, prefer_met), book)
    counts = evidence.groupBy(*KEY, "code").agg(
        F.max("position").alias("cited"),
        F.array_sort(F.collect_list(F.when(F.col("position") <= SHOWN, F.struct("position", "id")))).alias("_head"))
    rules = book.table(facts.sparkSession).select("family", F.col("id").alias("code"), "ord", "cause", "suggestions")
    return (rank_diagnoses(fired).join(rules, ["family", "code", "ord"])
            .join(messages, [*KEY, "code"]).join(counts, [*KEY, "code"])
            .select(*KEY, "rank", "code", "severity", "message", F.col("cause").alias("root_cause"), "suggestions",
                    F.transform("_head", lambda h: h["id"]).alias("shown"), "cited",
                    F.lit("high").alias("confidence"), F.lit(False).alias("insufficient_info"), F.lit("rules").alias("origin"), F.lit(0).cast("bigint").alias("proposal")))
