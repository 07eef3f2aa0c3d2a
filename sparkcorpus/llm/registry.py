"""The text queries and their SQL by name."""

from __future__ import annotations

from sparkcorpus.llm import queries as own


def queries() -> dict:
    return dict(own.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(own.ORACLES)
