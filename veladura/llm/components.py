"""Connected components by alternating large and small stars.

Each round hangs every node under the smallest node it is linked to; the edges shrink to
stars whose centres are the smallest nodes of the components, in a number of rounds
that grows with the logarithm of the longest chain.  Minima are pre-aggregated and
written before they are joined back, so that a centre with very many links is an
ordinary skewed join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veladura.llm.common import cut


def _under_minimum(edges: DataFrame, smallest: DataFrame, keep: str, rows: int) -> DataFrame:
    least = cut(smallest, "least", rows)
    return edges.join(least, "u").filter(keep).selectExpr("v as u", "m as v").filter("u <> v")


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.unionByName(edges.selectExpr("v as u", "u as v"))
    smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _under_minimum(both, smallest, "v > u", rows).distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    smallest = down.groupBy("u").agg(F.min("v").alias("m"))
    centre = smallest.selectExpr("u", "m as v")
    return _under_minimum(down, smallest, "v <> m", rows).unionByName(centre).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, at_most: int | None = None) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``u, v``) that is not its own root.

    ``at_most`` is a bound of the number of edges, if one is known.
    """
    edges = edges.select("u", "v").filter("u <> v").distinct()
    edges = cut(edges, "links", at_most)
    state = _state(edges)
    rows = state[0]
    while state[0]:
        large = cut(_large_star(edges, rows), "links", rows)
        edges = cut(_small_star(large, rows), "links", rows)
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.selectExpr("u as node", "v as root")
