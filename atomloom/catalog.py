"""All registered queries and their SQL twins."""

from __future__ import annotations

from atomloom.plans.oracles import ORACLE_SQL
from atomloom.plans.queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
