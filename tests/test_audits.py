"""Rule audits over all families."""

import os

import pytest

from faultscope.sources.rulebook import Rulebook
from faultscope.workload import QUERIES, checks

SF = os.environ.get("FAULTSCOPE_TEST_SF", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture
def spoilt_trace_rule(monkeypatch):
    """A trace rule with a placeholder no fact carries, a forbidden kind nobody sees and
    a condition no operator meets."""
    builtin = Rulebook.builtin()
    rule = next(r for r in builtin.rules if r["id"] == "ED0501")
    spoilt = {**rule, "id": "ED0599", "ord": 99, "absent": ["nowhere_seen"], "segments": [{"lit": None, "key": "nowhere"}],
              "conditions": [{"kind": "op_cost", "field": "share_pct", "lo": 101.0, "hi": None, "ok": True}]}
    monkeypatch.setattr(checks, "BOOK", Rulebook((*builtin.rules, spoilt)))


def test_placeholders_of_trace_rules_are_audited(spark, spoilt_trace_rule):
    rows = QUERIES["q6_rule_payload_coverage"](spark, SF).where("family = 'ort_profile'").collect()
    assert [(r["code"], r["use"], r["name"]) for r in rows] == [("ED0599", "placeholder", "nowhere")]


def test_activity_of_trace_rules_is_audited(spark, spoilt_trace_rule):
    rows = QUERIES["q7_rule_activity"](spark, SF).where("family = 'ort_profile'").collect()
    assert sorted((r["name"], r["problem"]) for r in rows) == [("ED0599", "rule never fires"), ("nowhere_seen", "kind never observed")]


def test_a_table_that_every_signature_matches(spark):
    """The lines of x2_every_signature leave no signature without a line."""
    from faultscope.operators.audit import signature_coverage
    from faultscope.workload.signatures import sample_lines
    assert signature_coverage(sample_lines(spark, SF)).collect() == []
