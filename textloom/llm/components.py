"""Connected components over tables in the shared folder: the engine's distributed union-find, its rounds saved there."""

from __future__ import annotations

from pyspark.sql import DataFrame

from textloom.llm.common import cut
from textloom.operators import components


def connected(links: DataFrame, rows: int | None = None) -> DataFrame:
    """links(a, b) -> node, root: each linked node with the least node of its component. rows: a bound of the number of links, where one is known."""
    return components.connected(links, lambda df: cut(df, "links", rows))
