"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stereoloom.operators.graph import connected_components


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges(a long, b long)``; the label is the component's least node.

    An empty edge table gives an empty result.
    """
    return connected_components(edges).withColumnRenamed("component", "label")
