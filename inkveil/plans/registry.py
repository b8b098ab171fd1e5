"""Every registered query of the engine, and the SQL that must give the same rows."""

from inkveil.plans.oracles import oracle_sql
from inkveil.plans.queries import queries

__all__ = ["oracle_sql", "queries"]
