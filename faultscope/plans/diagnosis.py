"""The whole way from lines or traces to verdicts."""

from dataclasses import dataclass

from pyspark.sql import DataFrame

from faultscope.operators import grounding
from faultscope.operators.derive import derive_facts
from faultscope.operators.facts import number_facts, resolve_facts
from faultscope.operators.ordered import SLICE
from faultscope.operators.rules import artifact_profile, cited_facts, diagnose, gather_evidence, match_rules
from faultscope.operators.signatures import match_signatures
from faultscope.operators.traces import trace_facts
from faultscope.operators.verdicts import verdicts
from faultscope.schema import KEY
from faultscope.sources.rulebook import Rulebook, RuleTable
from faultscope.staging import stage


def line_facts(lines: DataFrame, slice_lines: int = SLICE, staged: bool = True) -> DataFrame:
    """Facts of text artifacts, derived ones included.

    The text is scanned once: raw facts go to the shared folder, and context,
    numbering and derivation read that table.
    """
    raw = match_signatures(lines, slice_lines=slice_lines)
    resolved = resolve_facts(stage(raw, "raw-facts") if staged else raw)
    return number_facts(resolved).unionByName(derive_facts(resolved))


def all_facts(lines: DataFrame | None, events: DataFrame | None, slice_rows: int = SLICE, staged: bool = True) -> DataFrame:
    """Facts of logs and of typed trace events together."""
    parts = []
    if lines is not None:
        parts.append(line_facts(lines, slice_rows, staged))
    if events is not None:
        parts.append(trace_facts(stage(events, "trace-events") if staged else events, slice_rows))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


@dataclass(frozen=True)
class Diagnosis:
    """The tables of one run, keyed by ``(family, artifact)``."""

    artifacts: DataFrame
    facts: DataFrame
    evidence: DataFrame
    diagnoses: DataFrame
    verdicts: DataFrame


def run_diagnosis(artifacts: DataFrame, facts: DataFrame, book: Rulebook | RuleTable | None = None,
                  proposals: DataFrame | None = None, slice_rows: int = SLICE, prefer_met: bool = False,
                  staged: bool = True) -> Diagnosis:
    """Diagnoses and verdicts from facts. ``artifacts`` names every artifact, so that a
    clean one gets its verdict too; ``proposals`` pass the grounding gate first."""
    book = book or Rulebook.builtin()
    facts = stage(facts, "facts") if staged else facts
    fired = match_rules(artifact_profile(facts, book), book)
    fired = stage(fired, "fired") if staged else fired
    # Evidence and messages both read the cited facts: found once, written once.
    cited = cited_facts(facts, fired, book, slice_rows)
    cited = stage(cited, "cited") if staged else cited
    evidence = gather_evidence(cited)
    evidence = stage(evidence, "evidence") if staged else evidence
    found = diagnose(facts, book, fired, evidence, slice_rows, prefer_met, cited)
    if proposals is not None:
        sound = grounding.ground(proposals, grounding.unmatched_facts(facts, evidence))
        found = grounding.merge_synthesized(found, grounding.label_synthesized(sound))
    artifacts = artifacts.select(*KEY).distinct()
    return Diagnosis(artifacts, facts, evidence, found, verdicts(artifacts, found))


def diagnose_lines(lines: DataFrame, book: Rulebook | RuleTable | None = None, artifacts: DataFrame | None = None, **options) -> Diagnosis:
    """Text artifacts in, all result tables out. ``artifacts`` lists them (``list_artifacts``):
    then an artifact without a single line has its verdict too, and the text is read once.
    Without it the artifacts are those of the lines."""
    return run_diagnosis(lines.select(*KEY) if artifacts is None else artifacts, line_facts(lines, options.get("slice_rows", SLICE), options.get("staged", True)), book, **options)
