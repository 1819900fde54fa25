"""One layout of a table for lookups by several columns.

Rows are placed along a curve that interleaves the bits of several columns, each taken as its
rank among equal shares of the rows, so that every file and every row group holds a small box
of all of them.  A search by any one column then reads a share of about ``1/n**(1/d)`` of ``n``
row groups for ``d`` columns, by their statistics alone, where sorting by one column would help
that one only; a search by several reads the product of their shares.  Equality searches on
columns named in ``exact`` need not even read these: each row group has a bloom filter for them.

Shares come from quantiles of the given table (``approx_percentile``, at most ``2**BITS - 1``
numbers a column reach the driver), files from Spark's range partitioning over the curve, which is
sampled, so the sizes of files do not depend on how values are spread.  Rows alike in all
columns are spread by a hash of the whole row.  Nulls come first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, TimestampNTZType, TimestampType

from veladura.operators.protect import named
from veladura.session import TIMES_WITH_STATISTICS, settings

BITS = 8
ROWS_PER_FILE = 2_000_000
ROW_GROUP_BYTES = 16 << 20
_LEAD = 15  # characters of a text of digits that give its place


def place_of(df: DataFrame, column: str) -> Column:
    """A column as a number in the order of its values: numbers, times, and texts of digits."""
    kind, value = df.schema[column].dataType, named(column)
    if isinstance(kind, TimestampType):
        return F.unix_micros(value).cast("double")
    if isinstance(kind, TimestampNTZType):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    if isinstance(kind, NumericType):
        return value.cast("double")
    if isinstance(kind, StringType):
        return F.rpad(F.left(value, F.lit(_LEAD)), _LEAD, "0").try_cast("double")
    raise ValueError(f"column {column} has no place in a layout: numbers, times and texts of digits do")


def share_bounds(df: DataFrame, columns: Sequence[str], bits: int = BITS) -> Mapping[str, list[float]]:
    """Per column the numbers that part its rows into equal shares; repeated ones once."""
    shares = 2**bits
    steps = F.array(*[F.lit(i / shares) for i in range(1, shares)])
    row = df.agg(
        *[F.approx_percentile(place_of(df, c), steps, F.lit(shares * 8)).alias(f"q{i}") for i, c in enumerate(columns)]
    ).first()
    return {c: sorted({x for x in row[f"q{i}"] or [] if x == x}) for i, c in enumerate(columns)}


def _rank(place: Column, bounds: Sequence[float], bits: int) -> Column:
    """How many bounds lie at or below the place, found by halving: ``bits`` comparisons a row."""
    full = 2**bits - 1
    padded = F.lit([*bounds, *[float("inf")] * (full - len(bounds))])
    rank = F.lit(0)
    for bit in reversed(range(bits)):
        reached = place >= F.get(padded, rank + F.lit(2**bit - 1))
        rank = rank + F.when(reached, 2**bit).otherwise(0)
    # infinity reaches the padding too; nulls reach nothing
    return F.least(rank, F.lit(len(bounds)))


def curve(df: DataFrame, columns: Sequence[str], bounds: Mapping[str, Sequence[float]], bits: int = BITS) -> Column:
    """The place of a row on the curve: the bits of the ranks by turns, highest first."""
    spot, d = F.lit(0).cast("bigint"), len(columns)
    for i, c in enumerate(columns):
        rank = named(f"_rank{i}")
        for bit in range(bits):
            held = F.shiftright(rank, bit).bitwiseAND(F.lit(1)).cast("bigint")
            spot = spot + F.shiftleft(held, bit * d + (d - 1 - i))
    return spot


def write_for_lookups(
    df: DataFrame,
    path: str,
    columns: Sequence[str],
    exact: Sequence[str] = (),
    files: int | None = None,
    row_group_bytes: int = ROW_GROUP_BYTES,
    bits: int = BITS,
) -> None:
    """Store a table so that searches by each of ``columns`` skip most of it.

    ``df`` should be a stored table: it is read for the shares, for the sample of the range
    partitioning and for the rows.  ``bits`` times the number of columns is 60 at most.
    """
    if not columns or bits * len(columns) > 60:
        raise ValueError("a layout has at least one column and at most 60 bits")
    files = files or df.count() // ROWS_PER_FILE + 1
    bounds = share_bounds(df, columns, bits)
    ranked = df.withColumns({f"_rank{i}": _rank(place_of(df, c), bounds[c], bits) for i, c in enumerate(columns)})
    spread = F.xxhash64(*[named(c) for c in df.columns])
    placed = ranked.select(*[named(c) for c in df.columns], curve(ranked, columns, bounds, bits).alias("_spot"), spread.alias("_spread"))
    ordered = placed.repartitionByRange(files, "_spot", "_spread").sortWithinPartitions("_spot", *[named(c) for c in columns])
    blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in exact}
    options = {"parquet.block.size": str(row_group_bytes), **blooms}
    with settings(df.sparkSession, TIMES_WITH_STATISTICS):
        ordered.drop("_spot", "_spread").write.mode("overwrite").options(**options).parquet(path)
