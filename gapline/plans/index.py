"""From postings to an index: positions, pages, blocks, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gapline.operators import fit, partition, stats

GREEDY_BLOCKS = {"none": 2048, "pfor": 8}


def build(keyed: DataFrame, epsilon: int = 0, variant: str = "none", m: int | None = None, method: str = "greedy") -> DataFrame:
    """Segments of keyed(list_id, pos, doc_id); epsilon 0 lets the cost model choose blocks and bounds."""
    if epsilon < 0:
        raise ValueError("epsilon: 0 or more")
    if epsilon:
        return fit.fit_lists(keyed, epsilon)
    return fit.fit(keyed, partition.blocks(stats.pages(keyed), m or GREEDY_BLOCKS[variant], variant, method))
