"""Looking rows up in a table with unique keys when some keys are very frequent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def own_key(key: Column) -> Column:
    """A text key, or for rows without one a key of their own that nothing else has.

    Rows without a key then neither meet in one task nor match anything.  It is computed
    where the row is read, and keeps conditions on the key from moving below it, where
    a costly key (a cipher) would be computed a second time.
    """
    return F.coalesce(key, F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string")))


def lookup_join(
    facts: DataFrame, entries: DataFrame, key: str, hint: str | None = None
) -> DataFrame:
    """Left join of ``facts`` to ``entries``, which have one row per key.

    One ordinary join: Spark broadcasts the entries if they are small, and splits the
    partitions of frequent keys while the query runs.  ``hint`` asks for a kind of
    join, as in ``DataFrame.hint``.
    """
    sought = entries.withColumnRenamed(key, "_sought")
    if hint:
        sought = sought.hint(hint)
    probing = facts.withColumn("_probe", own_key(F.col(key)))
    return probing.join(sought, F.col("_probe") == F.col("_sought"), "left").drop("_probe", "_sought")
