"""Joining two streams of protected records."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veladura.operators.protect import named


def join_streams(
    left: DataFrame,
    right: DataFrame,
    on: str,
    left_time: str,
    right_time: str,
    within: timedelta,
    late: timedelta,
    how: str = "inner",
) -> DataFrame:
    """Pairs of records with the same token whose times are at most ``within`` apart.

    Both sides get a watermark of ``late``: records that come later than that may miss their
    partners, and what no record that still may come can meet leaves the state.  So the state holds
    about ``within`` plus ``late`` of both streams, however long they run.

    The join is on the token and a slot of time, each as long as ``within``: a right record goes
    to its own slot and its two neighbours, so that it meets each left record once.  A token that
    fills a third of the input is thereby spread over all slots, and a record is compared with
    those of three slots, not with all that the state holds of its token.

    ``how`` is ``inner`` or ``left_outer`` (left records without a partner come with nulls once the
    watermark has passed them; those without token or time do so at once in a batch, and in a stream
    with the watermark).  The same call on two batch frames gives the answer of a batch.  Columns must
    have different names, but for the token, which is returned once.  Records without token or time
    have no partner.  Repeated records are records of their own.  Times are timestamps.
    """
    if how not in ("inner", "left_outer"):
        raise ValueError("how is 'inner' or 'left_outer'")
    clash = {c.lower() for c in left.columns} & {c.lower() for c in right.columns} - {on.lower()}
    if clash:
        raise ValueError(f"both sides have columns named {sorted(clash)}")
    span = within // timedelta(microseconds=1)
    if span <= 0 or late < timedelta(0):
        raise ValueError("within must be positive, late must not be negative")
    delay = f"{late // timedelta(microseconds=1)} microseconds"

    def slot(time: str) -> Column:
        micros = F.unix_micros(named(time))  # whole numbers throughout: no rounding at the edges of slots
        return F.call_function("div", micros - F.pmod(micros, F.lit(span)), F.lit(span))

    near = F.explode(F.sequence(slot(right_time) - 1, slot(right_time) + 1))
    ours = left.withWatermark(left_time, delay).withColumn("_slot", slot(left_time))
    met = right.withColumnRenamed(on, "_on").filter(F.col("_on").isNotNull() & named(right_time).isNotNull())
    theirs = met.withWatermark(right_time, delay).withColumn("_near", near)
    apart = F.expr(f"INTERVAL '{span // 10**6}.{span % 10**6:06d}' SECOND")
    meets = (
        (named(on) == F.col("_on"))
        & (F.col("_slot") == F.col("_near"))
        & (named(right_time) >= named(left_time) - apart)
        & (named(right_time) <= named(left_time) + apart)
    )
    return ours.join(theirs, meets, how).drop("_slot", "_near", "_on")
