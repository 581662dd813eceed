"""What is known of plans and tables: operators, rows seen by each, and column statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _nodes(node, depth: int = 0) -> list[tuple[int, object]]:
    """A plan's nodes from the top; adaptive and query-stage wrappers are looked through."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _nodes(node.executedPlan(), depth)
    if kind.endswith("QueryStageExec"):
        return _nodes(node.plan(), depth)
    out = [(depth, node)]
    children = node.children()
    for i in range(children.size()):
        out += _nodes(children.apply(i), depth + 1)
    return out


def explain(df: DataFrame) -> DataFrame:
    """EXPLAIN: a row (id, depth, operator) for each node of the optimized plan, top first."""
    nodes = _nodes(df._jdf.queryExecution().optimizedPlan())
    rows = [(k, depth, node.nodeName()) for k, (depth, node) in enumerate(nodes)]
    return df.sparkSession.createDataFrame(rows, "id int, depth int, operator string")


def runtime_statistics(df: DataFrame) -> DataFrame:
    """Runs df (without collecting it) and gives, for each physical operator that counts, the rows it put out."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    rows = []
    for depth, node in _nodes(execution.executedPlan()):
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined():
            rows.append((len(rows), depth, node.nodeName().split(" ")[0], metric.get().value()))
    return df.sparkSession.createDataFrame(rows, "id int, depth int, operator string, rows long")


def column_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """UPDATE STATISTICS: of each column its rows, nulls, distinct values (a sketch) and selectivity of an equality, in
    one pass."""
    parts = [F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), (F.count("*") - F.count(c)).alias("nulls"), F.approx_count_distinct(c, 0.01).alias("distinct")) for c in columns]
    return df.agg(F.array(*parts).alias("s")).select(F.inline("s")).withColumn("selectivity", 1 / F.greatest("distinct", F.lit(1)))
