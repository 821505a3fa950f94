"""Names of the corpus queries and their SQL twins."""

from __future__ import annotations

from pageloom.llm import queries as Q
from pageloom.llm import oracles


def queries() -> dict:
    return {name: getattr(Q, name) for name in dir(Q) if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
