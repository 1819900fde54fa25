"""Checks that read new data only: mergeable sketches kept per part of a table.

Each part (a day, a batch, a file) leaves one small row per checked column: theta sketches of its
raw values, its protected values and its pairs of both.  Sketches merge, in any order and
grouping, so counts over the whole table, or over any choice of parts, need the parts'
sketches and no data.  Removing or repeating a part's rows means making that part's row again.

A sketch of ``2**size`` entries counts exactly below that many distinct values and beyond it with
a relative standard error of ``2**(-size/2)``; bounds are three of these (1.2 % at size 16).  So
a sketch shows violations that are larger than its bound, cheaply and every day;
``operators/verify`` shows each single one.  Rows whose raw value is blank or null are left out; a protected null is
no value, an empty one is.  A sketch takes 8 bytes an entry at most, whatever the size of its part.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veladura.operators.protect import has_value, named

SIZE = 16
_KINDS = ("raw", "protected", "pairs")


def sketch_parts(df: DataFrame, pairs: Mapping[str, str], part: str, size: int = SIZE) -> DataFrame:
    """One row per part and column: ``part, column, n_values`` and the sketches of the column.

    ``pairs`` maps raw to protected columns.  One pass; each task merges its rows into its
    sketches, so the shuffle carries one row per task, part and column.
    """
    entries = [
        F.struct(F.lit(raw).alias("column"), named(raw).cast("string").alias("r"), named(p).cast("string").alias("p"))
        for raw, p in pairs.items()
    ]
    rows = df.select(named(part).cast("string").alias("part"), F.inline(F.array(*entries))).filter(has_value(F.col("r")))
    # nulls are passed over by the hash: which side is null goes in with the values
    pair = F.xxhash64(F.col("p").isNull(), "r", "p")
    return rows.groupBy("part", "column").agg(
        F.count(F.lit(1)).alias("n_values"),
        F.theta_sketch_agg("r", size).alias("raw"),
        # a sketch passes over empty texts, their hash it counts
        F.theta_sketch_agg(F.when(F.col("p").isNotNull(), F.xxhash64("p")), size).alias("protected"),
        F.theta_sketch_agg(pair, size).alias("pairs"),
    )


def add_parts(df: DataFrame, pairs: Mapping[str, str], part: str, path: str, size: int = SIZE) -> None:
    """Sketch new parts and store them beside those of earlier ones, which are not read."""
    sketch_parts(df, pairs, part, size).write.mode("append").parquet(path)


def merged(sketches: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per column over all the given parts."""
    return sketches.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_parts"),
        F.sum("n_values").alias("n_values"),
        *[F.theta_union_agg(k, size).alias(k) for k in _KINDS],
    )


def bound(estimate: Column, size: int = SIZE) -> Column:
    """How far the true count may be from an estimate: nothing below the sketch's size."""
    return F.when(estimate < F.lit(2**size), F.lit(0.0)).otherwise(estimate * F.lit(3 * 2 ** (-size / 2)))


def convergence_bounds(sketches: DataFrame, size: int = SIZE) -> DataFrame:
    """Per column the estimated counts of distinct raw values, protected values and pairs.

    ``deterministic`` and ``injective`` are false where the counts differ by more than their
    bounds together, so that some value has several outputs, or some output several values.
    """
    counts = merged(sketches, size).select(
        "column", "n_parts", "n_values", *[F.theta_sketch_estimate(k).alias(f"n_{k}") for k in _KINDS]
    )

    def alike(other: str) -> Column:
        slack = bound(F.col("n_pairs"), size) + bound(F.col(other), size)
        return F.abs(F.col("n_pairs") - F.col(other)) <= slack

    return counts.withColumns({"deterministic": alike("n_raw"), "injective": alike("n_protected")})


def overlaps(arriving: DataFrame, held: DataFrame, kind: str = "protected", size: int = SIZE) -> DataFrame:
    """How many distinct values of new parts are in the parts held already: ``column, n_new, n_known``.

    From both sides' sketches alone.  The error of ``n_known`` is that of the distinct values of both
    sides together; exact while these are fewer than the sketch's size.
    """
    sides = [merged(s, size).select("column", F.col(kind).alias(n)) for s, n in ((arriving, "a"), (held, "h"))]
    known = F.coalesce(F.theta_sketch_estimate(F.theta_intersection("a", "h")), F.lit(0).cast("bigint"))
    return sides[0].join(sides[1], "column", "left").select(
        "column", (F.theta_sketch_estimate("a") - known).alias("n_new"), known.alias("n_known")
    )
