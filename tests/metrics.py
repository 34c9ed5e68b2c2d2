"""What the nodes of a plan did."""

from __future__ import annotations


def most_joined(df) -> int:
    """The most rows that a join of a query made, after it has been run."""
    df.collect()

    def walk(node):
        kind = node.nodeName()
        inner = [node.executedPlan()] if kind == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in kind else []
        rows = [node.metrics().apply("numOutputRows").value()] if kind.endswith("Join") and node.metrics().contains("numOutputRows") else []
        children = node.children()
        return max([*rows, *map(walk, inner), *(walk(children.apply(k)) for k in range(children.size()))], default=0)

    return walk(df._jdf.queryExecution().executedPlan())
