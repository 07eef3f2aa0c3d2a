"""The core's queries and their SQL by name."""

from __future__ import annotations

from sparkcorpus.plans import problems, reference

#: The query that ``entry`` runs.
FLAGSHIP = "hybrid_topk"


def queries() -> dict:
    return reference.QUERIES | problems.QUERIES


def oracle_sql() -> dict[str, str]:
    return reference.ORACLES | problems.ORACLES
