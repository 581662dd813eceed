"""Registered queries and their DuckDB SQL."""

from tessera.plans import run_sql
from tessera.queries import database, engine, relational  # noqa: F401 (database registers with engine)

QUERIES = {k: (lambda spark, base, text=text: run_sql(spark, base, text)) for k, (text, _) in relational.SQL.items()} | engine.QUERIES
ORACLE_SQL = {k: duck or text for k, (text, duck) in relational.SQL.items()} | engine.ORACLE
