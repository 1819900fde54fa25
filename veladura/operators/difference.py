"""What differs between two versions of a table, without joining all of it.

Rows are summed up by ranges of their key into hashes that do not depend on the order of
the rows.  These leaves add up to a tree: the hash of a range is the sum of its children's.
Only rows in leaves whose hashes differ are ever shuffled.  A tree can be stored with its version, so that the old version need not
be read again to learn where a copy differs.

Leaves and what is broadcast of them are bounded by ``LEAVES``, whatever the size of the
table.  A row hash has 96 bits, is not keyed, and finds damage, not forgery (for that see
``operators/sealed_trail``).  Nulls, empty texts and repeated rows count: a row that is
there twice differs from the same row once.  Rows whose key is null lie in a range of their own.
Columns may have any type that can be grouped (maps cannot).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veladura.operators.protect import named

LEAVES = 65_536  # at most so many ranges
FANOUT = 16
_OUTSIDE = -1  # the leaf of rows whose key is null
_SUMS = ("h0", "h1", "h2", "h3")
_MOST_SPANS = 64  # spans of key handed to the scan; closer ones are read as one


@dataclass(frozen=True)
class Ranges:
    """Equal ranges of an integer key; what lies beyond the ends is in the first and last one."""

    key: str
    low: int
    width: int
    leaves: int

    def __post_init__(self):
        if not (self.width >= 1 and 1 <= self.leaves <= LEAVES):
            raise ValueError(f"ranges need a width and 1 to {LEAVES} leaves")

    @classmethod
    def of(cls, df: DataFrame, key: str, leaves: int = 4096) -> Ranges:
        """Ranges over the keys that a table holds; only file statistics are read for them."""
        low, high = df.agg(F.min(named(key)), F.max(named(key))).first()
        if low is None:
            return cls(key, 0, 1, 1)
        return cls(key, int(low), max(1, -(-(int(high) - int(low) + 1) // leaves)), leaves)

    def leaf(self) -> Column:
        place = F.call_function("div", named(self.key).cast("decimal(38,0)") - F.lit(self.low), F.lit(self.width))
        inside = F.greatest(F.lit(0), F.least(F.lit(self.leaves - 1), place.cast("bigint")))
        return F.when(named(self.key).isNull(), _OUTSIDE).otherwise(inside).cast("int")

    def spans(self, leaves: Sequence[int]) -> list[tuple[int, int]]:
        """Few spans of leaves that cover the given ones; the smallest gaps are closed first."""
        inside = sorted(x for x in leaves if x != _OUTSIDE)
        gaps = sorted(((b - a, b) for a, b in zip(inside, inside[1:]) if b - a > 1), reverse=True)
        starts = sorted(inside[:1] + [b for _, b in gaps[: _MOST_SPANS - 1]])
        ends = [max(x for x in inside if x < s) for s in starts[1:]] + inside[-1:]
        return list(zip(starts, ends))

    def condition(self, leaves: Sequence[int]) -> Column:
        """A plain condition on the key that covers these leaves and reaches the scan."""
        key, parts = named(self.key), []
        for first, last in self.spans(leaves):
            part = F.lit(True)
            if first > 0:
                part = part & (key >= F.lit(self.low + first * self.width))
            if last < self.leaves - 1:
                part = part & (key < F.lit(self.low + (last + 1) * self.width))
            parts.append(key.isNotNull() & part)
        if _OUTSIDE in leaves:
            parts.append(key.isNull())
        return reduce(lambda a, b: a | b, parts, F.lit(False))


def _row_hash(columns: Sequence[str]) -> list[Column]:
    """96 bits of a row as four numbers of 24: 2^39 rows of one range add up without overflow."""
    cells = [named(c) for c in columns]
    # the hash functions pass over nulls, so which cells are null is hashed too
    held = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in cells])
    halves = F.xxhash64(held, *cells), F.xxhash64(F.lit("second"), *reversed(cells), held)
    return [F.shiftrightunsigned(h, by).bitwiseAND(F.lit(0xFFFFFF)) for h in halves for by in (0, 24)]


def leaf_hashes(df: DataFrame, ranges: Ranges, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per range that holds rows: ``leaf, n_rows, h0..h3``.  Summed before the shuffle."""
    chosen = sorted(columns or df.columns)
    sums = [F.sum(h).alias(name) for h, name in zip(_row_hash(chosen), _SUMS)]
    return df.groupBy(ranges.leaf().alias("leaf")).agg(F.count(F.lit(1)).alias("n_rows"), *sums)


def tree(leaves: DataFrame, ranges: Ranges) -> DataFrame:
    """All levels over the leaves: ``level`` 0 are the leaves, ``node`` numbers the ranges of a level."""
    level = leaves.withColumnRenamed("leaf", "node")
    # null keys stay apart up to the top; sums of sums could overflow, so they are kept modulo 2^62
    levels, count, number = [level.select(F.lit(0).alias("level"), "*")], ranges.leaves, 0
    while count > 1:
        count, number = -(-count // FANOUT), number + 1
        parent = F.when(F.col("node") == _OUTSIDE, _OUTSIDE).otherwise(F.call_function("div", F.col("node"), F.lit(FANOUT)))
        level = level.groupBy(parent.cast("int").alias("node")).agg(
            F.sum("n_rows").alias("n_rows"),
            *[(F.sum(F.col(h).cast("decimal(38,0)")) % F.lit(2**62)).cast("bigint").alias(h) for h in _SUMS],
        )
        levels.append(level.select(F.lit(number).alias("level"), "*"))
    return reduce(DataFrame.unionByName, levels)


def differing_nodes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Nodes of two trees over the same ranges that differ: ``level, node, n_before, n_after``.

    Trees are bounded, so one join compares all levels; a filter on ``level`` reaches stored ones.
    """
    sides = [t.select("level", "node", F.struct("n_rows", *_SUMS).alias(side)) for t, side in ((before, "b"), (after, "a"))]
    met = sides[0].join(sides[1], ["level", "node"], "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    counts = [F.coalesce(F.col(f"{s}.n_rows"), F.lit(0)).alias(n) for s, n in (("b", "n_before"), ("a", "n_after"))]
    return met.select("level", "node", *counts)


def differing_leaves(before: DataFrame, after: DataFrame) -> list[int]:
    """The ranges whose leaves differ.  The driver gets their numbers, ``LEAVES`` at most."""
    sides = [df.select("leaf", F.struct("n_rows", *_SUMS).alias(s)) for df, s in ((before, "b"), (after, "a"))]
    met = sides[0].join(sides[1], "leaf", "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    return sorted(r[0] for r in met.select("leaf").collect())


def rows_in(df: DataFrame, ranges: Ranges, leaves: Sequence[int]) -> DataFrame:
    """The rows of these ranges; spans of the key filter the scan."""
    leaves = sorted(leaves)
    exact = F.array_contains(F.lit(leaves), ranges.leaf()) if len(leaves) <= _MOST_SPANS else None
    near = df.filter(ranges.condition(leaves))
    if exact is not None:
        return near.filter(exact)
    wanted = df.sparkSession.createDataFrame([(x,) for x in leaves], "_leaf int")
    return near.join(F.broadcast(wanted), ranges.leaf() == F.col("_leaf"), "left_semi")


def differences(
    before: DataFrame,
    after: DataFrame,
    key: str = "id",
    ranges: Ranges | None = None,
    leaves_before: DataFrame | None = None,
) -> DataFrame:
    """Rows that only one of two versions has, told by key.

    One row per key: ``change`` (``added``, ``removed``, ``changed``), ``n_before`` and
    ``n_after`` (differing rows, repeats counted), and ``columns``, the names of the columns that
    changed where the key has one differing row on each side (else null).

    Both versions must have the same columns.  Equal versions shuffle no rows at all; otherwise
    those of the differing ranges, grouped by all columns, so that a key with very many rows
    does not end in one task.  ``leaves_before`` are stored leaf hashes of ``before``.
    """
    columns = sorted(before.columns)
    if columns != sorted(after.columns):
        raise ValueError(f"columns differ: {sorted(set(before.columns) ^ set(after.columns))}")
    ranges = ranges or Ranges.of(before, key)
    held = leaf_hashes(before, ranges) if leaves_before is None else leaves_before
    hit = differing_leaves(held, leaf_hashes(after, ranges))
    sides = []
    for df, n_before, n_after in ((before, 1, 0), (after, 0, 1)):
        rows = rows_in(df, ranges, hit).select(F.struct(*[named(c) for c in columns]).alias("row"))
        sides.append(rows.select("row", F.lit(n_before).alias("b"), F.lit(n_after).alias("a")))
    surplus = F.sum("a") - F.sum("b")
    odd = sides[0].unionByName(sides[1]).groupBy("row").agg(surplus.alias("n")).filter("n <> 0")
    n_before, n_after = F.sum(F.greatest(-F.col("n"), F.lit(0))), F.sum(F.greatest(F.col("n"), F.lit(0)))
    per_key = odd.groupBy(F.col("row")[key].alias(key)).agg(
        n_before.alias("n_before"),
        n_after.alias("n_after"),
        F.first(F.when(F.col("n") < 0, F.col("row")), ignorenulls=True).alias("old"),
        F.first(F.when(F.col("n") > 0, F.col("row")), ignorenulls=True).alias("new"),
    )
    one_each = (F.col("n_before") == 1) & (F.col("n_after") == 1)
    differing = F.array_compact(
        F.array(*[F.when(~F.col("old")[c].eqNullSafe(F.col("new")[c]), F.lit(c)) for c in columns])
    )
    change = F.when(F.col("n_after") == 0, "removed").when(F.col("n_before") == 0, "added").otherwise("changed")
    return per_key.select(
        key, change.alias("change"), "n_before", "n_after", F.when(one_each, differing).alias("columns")
    )
