"""All registered queries of the core."""

from __future__ import annotations

from millrace.plans import corpus, relational, shapes, statistics, streams, texts, vectors  # noqa: F401 - they register themselves
from millrace.plans.registry import ORACLES, QUERIES

FLAGSHIP = QUERIES["corpus_control_report"]

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
