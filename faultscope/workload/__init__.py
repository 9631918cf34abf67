"""The registered queries over the given tables."""

from faultscope.workload import checks, extraction, relations, rule_tables, signatures, text, whole  # noqa: F401
from faultscope.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
