"""From SQL text of the engine's dialect to Spark plans."""

from tessera.plans.catalog import TABLES, Catalog, run_sql
from tessera.plans.dialect import to_spark

__all__ = ["TABLES", "Catalog", "run_sql", "to_spark"]
