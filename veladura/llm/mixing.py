"""Mixing sources to target weights, by a curriculum that changes over training time.

Every source has a schedule: its weight as a piecewise linear function of training time 0
to 1.  The integral of the schedule is the source's weight in the whole mix.  All words
are shared out by weight; a source that would have to repeat its documents more than
``EPOCHS`` times stops there, and what it leaves is shared among the others by weight until
none is above.  That is the source's target.

A source's documents stand in a fixed pseudo-random order, once per epoch, and are taken
one after the other until the target is reached; the last one is taken up to the word that
reaches it, so a source gives exactly the whole part of its target.  A copy that begins after
``u`` of the source's ``W`` words belongs where the integrated schedule has reached the same
share ``u / W``: inverting the integral gives its position in training time.  Sorting by
position deals out the mix, and sources come and go as their schedules say.

How much of a source stands before a document is a running sum over many rows.  It is
computed along the digits of the order's hash: sums of the cells that share their first
three digits, then six, and so on, each level in windows of at most 4096 rows, and a last
window over the few documents of a cell.  So no task gets a whole source, and the numbers
that belong to a source are joined to its cells of the first level only.  Rows that agree
in id, source, size and text are summed before and told apart afterwards by number, in
pieces.  Sources are ranked by a range sort, and the driver holds a few sums.

Edge cases: null and empty texts have size 0 and are never taken; null sources are one
source, the last; null ids are ordered like ids; repeated rows each stand in the order;
rows that agree in id and size are interchangeable, so ties change no result; an empty
table gives an empty result.  Other columns are ignored, and kept by ``training_set``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce
from math import lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veladura.llm.common import cut, free_name, ship

ship(__name__)

EPOCHS = 3
SEED = "mix:"
#: A cell of the last level has about this many documents, and a window at most this many cells.
CELL, FAN_DIGITS = 1000, 3
_PIECE = 1000


@dataclass(frozen=True)
class Schedule:
    """Weight by training time: knots ``(time, weight)`` from time 0 to 1, joined by lines."""

    knots: tuple[tuple[float, float], ...]

    def __post_init__(self):
        times = [t for t, _ in self.knots]
        if times != sorted(set(times)) or times[0] != 0 or times[-1] != 1 or min(w for _, w in self.knots) < 0:
            raise ValueError("knots go from time 0 to 1 and have no negative weight")
        if not self.weight:
            raise ValueError("a schedule without weight takes nothing")

    @property
    def segments(self) -> list[tuple[Fraction, Fraction, Fraction, Fraction]]:
        """Start, length, weight there, weight at the end."""
        exact = [(Fraction(t), Fraction(w)) for t, w in self.knots]
        return [(a, b - a, v, w) for (a, v), (b, w) in zip(exact, exact[1:])]

    @property
    def weight(self) -> Fraction:
        return sum(length * (v + w) / 2 for _, length, v, w in self.segments)

    def time(self, share: Column) -> Column:
        """When the integral of the weight has reached this share of the whole."""
        area = share * float(self.weight)
        done, out = Fraction(0), F.lit(1.0)
        pieces = []
        for start, length, v, w in self.segments:
            here = length * (v + w) / 2
            slope = float((w - v) / length)
            rest = area - float(done)
            root = F.sqrt(F.greatest(F.lit(float(v * v)) + 2 * slope * rest, F.lit(0.0)))
            within = F.when(rest > 0, 2 * rest / (float(v) + root)).otherwise(0.0)
            done += here
            pieces.append((area < float(done), float(start) + within))
        for inside, value in reversed(pieces):
            out = F.when(inside, F.least(value, F.lit(1.0))).otherwise(out)
        return out


#: Weights 1, 2 and 3: the first fades out, the second stays, the third fades in.
SCHEDULES = (
    Schedule(((0, 1.5), (1, 0.5))),
    Schedule(((0, 2), (1, 2))),
    Schedule(((0, 2), (1, 4))),
)


def whole_weights(schedules: Sequence[Schedule]) -> list[int]:
    """The schedules' weights as whole numbers in the same proportion."""
    unit = lcm(*[s.weight.denominator for s in schedules])
    return [int(s.weight * unit) for s in schedules]


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, text_hash, size``, stored once."""
    kind = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            # bytes.split() without argument splits at exactly these: space, and 09 to 0D
            n = [len(t.as_py().encode().split()) if t.is_valid else 0 for t in texts]
            columns = [batch.column(c) for c in ("doc_id", "source", "text_hash")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n, pa.int64())], ["doc_id", "source", "text_hash", "size"]
            )

    read = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), "text")
    out = f"doc_id {kind['doc_id']}, source {kind['source']}, text_hash bigint, size bigint"
    return cut(read.mapInArrow(run, out), "mix-sizes")


def ranked(per_source: DataFrame) -> DataFrame:
    """Adds ``rank``: 0, 1, ... by code point, null last, without bringing all sources together."""
    order = F.col("source").asc_nulls_last()
    placed = per_source.repartitionByRange(order).sortWithinPartitions(order)
    placed = cut(placed.withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    part, n_bits = F.shiftright("at", 33), (1 << 33) - 1
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part).count().collect())  # a row per partition
    before, starts = 0, {}
    for p, n in counts:
        starts[p], before = before, before + n
    if not starts:
        return placed.withColumn("rank", F.lit(0).cast("bigint")).drop("at")
    start = F.create_map(*[F.lit(x) for p in starts.items() for x in p])[part]
    return placed.withColumn("rank", start + F.col("at").bitwiseAND(n_bits)).drop("at")


def targets(
    rows: DataFrame,
    schedules: Sequence[Schedule] = SCHEDULES,
    named: dict[str, int] | None = None,
    epochs: int = EPOCHS,
) -> DataFrame:
    """``source, source_size, schedule, target, want`` for rows of ``source, size``.

    Sources take the schedules in turn; ``named`` gives some sources schedules by number.
    """
    own = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-totals")
    turn = F.col("rank") % len(schedules)
    if named:
        turn = F.coalesce(F.create_map(*[F.lit(x) for p in named.items() for x in p])[F.col("source")], turn)
    weights = F.array(*[F.lit(w).cast("bigint") for w in whole_weights(schedules)])
    by = ranked(own).withColumn("schedule", turn.cast("int"))
    by = cut(by.withColumn("w", weights[F.col("schedule")]).drop("rank"), "mix-weights")
    most = epochs * F.col("source_size")
    first = by.agg(F.sum("source_size"), F.sum("w")).first()
    words, weight = first[0] or 0, first[1] or 1
    # words per weight among the sources that are not at their most; it only grows
    share, per, full = words, weight, -1
    while True:
        above = F.col("w").cast("decimal(38,0)") * share > most.cast("decimal(38,0)") * per
        got = by.agg(
            F.count_if(above), F.sum(F.when(above, most)), F.sum(F.when(~above, F.col("w")))
        ).first()
        if got[0] == full or got[2] is None:
            break
        full, share, per = got[0], words - (got[1] or 0), got[2]
    part = F.col("w").cast("decimal(38,0)") * share
    exact = F.expr(f"(w * {share}BD) div {per}").cast("bigint")
    return by.select(
        "source", "source_size", "schedule",
        F.when(above, most.cast("double")).otherwise(part.cast("double") / float(per)).alias("target"),
        F.when(above, most).otherwise(exact).alias("want"),
    )


def _levels(rows: int) -> int:
    levels = 1
    while rows > CELL * 16 ** (FAN_DIGITS * levels):
        levels += 1
    return levels


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    return reduce(Column.__and__, [left[c].eqNullSafe(right[f"of_{c}"]) for c in columns])


def with_offsets(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """Adds the columns of ``by_source`` and ``before``: the words of the source that stand before."""
    levels = _levels(rows.count())
    key = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    groups = rows.groupBy("source", "doc_id", "text_hash", "size").agg(F.count(F.lit(1)).alias("n"))
    groups = groups.withColumn("key", key)
    for level in range(1, levels + 1):
        groups = groups.withColumn(f"p{level}", F.col("key").substr(1, FAN_DIGITS * level))
    groups = cut(groups, "mix-groups")
    words = F.sum(F.col("n") * F.col("size"))
    above = by_source.select(F.col("source").alias("of_source"), *[c for c in by_source.columns if c != "source"])
    above = above.withColumn("start", F.lit(0).cast("bigint"))
    on = ["source"]
    for level in range(1, levels + 1):
        cells = groups.groupBy(*on, f"p{level}").agg(words.alias("words"))
        running = Window.partitionBy(*on).orderBy(f"p{level}").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("inner", F.coalesce(F.sum("words").over(running), F.lit(0).cast("bigint")))
        cells = cells.join(above, _same(cells, above, on)).withColumn("start", F.col("start") + F.col("inner"))
        cells = cells.drop("inner", "words", *[f"of_{c}" for c in on])
        on = [*on, f"p{level}"]
        above = cells
        for c in on:
            above = above.withColumnRenamed(c, f"of_{c}")
    inside = Window.partitionBy(*on).orderBy("key", "doc_id", "size", "text_hash")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(F.col("n") * F.col("size")).over(inside), F.lit(0).cast("bigint"))
    placed = groups.withColumn("inner", own)
    placed = placed.join(above, _same(placed, above, on)).withColumn("before", F.col("start") + F.col("inner"))
    placed = placed.drop("inner", "start", *on[1:], *[f"of_{c}" for c in on])
    # rows that agree in everything come back, in pieces
    last = F.expr(f"(n - 1) div {_PIECE}")
    pieces = placed.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    begin = F.col("piece") * _PIECE
    numbers = F.sequence(begin, F.least(F.col("n"), begin + _PIECE) - 1)
    each = pieces.withColumn("j", F.explode(numbers))
    return each.withColumn("before", F.col("before") + F.col("j") * F.col("size")).drop("piece", "j", "n")


def mix(
    docs: DataFrame,
    schedules: Sequence[Schedule] = SCHEDULES,
    named: dict[str, int] | None = None,
    epochs: int = EPOCHS,
) -> DataFrame:
    """One row per document with what the mix takes of it.

    ``doc_id, source, text_hash, size, source_size, schedule, target, taken, copies``, and
    ``order``, a fixed pseudo-random text to tell apart what falls on one position.
    ``copies`` has ``position`` (0 to 1) and ``words`` of every copy, ``epochs`` at most.
    """
    rows = sizes(docs)
    placed = with_offsets(rows, targets(rows, schedules, named, epochs))

    def copy(epoch: Column) -> Column:
        begins = epoch * F.col("source_size") + F.col("before")
        share = begins / F.col("want")
        times = F.array(*[s.time(share) for s in schedules])
        return F.struct(
            F.element_at(times, F.col("schedule") + 1).alias("position"),
            F.least(F.col("size"), F.col("want") - begins).alias("words"),
        )

    all_epochs = F.array(*[F.lit(e).cast("bigint") for e in range(epochs)])
    begun = F.filter(
        all_epochs, lambda e: (e * F.col("source_size") + F.col("before") < F.col("want")) & (F.col("size") > 0)
    )
    copies = F.transform(begun, copy)
    taken = F.aggregate("copies", F.lit(0).cast("bigint"), lambda a, c: a + c["words"])
    return placed.withColumn("copies", copies).select(
        "doc_id", "source", "text_hash", "size", "source_size", "schedule", "target",
        taken.alias("taken"), "copies", F.col("key").alias("order"),
    )


def by_position(mixed: DataFrame) -> DataFrame:
    """The rows of ``mix`` in order of their first position; what is never taken comes last."""
    shown = mixed.withColumn("first_position", F.try_element_at("copies", F.lit(1))["position"])
    order = (F.col("first_position").asc_nulls_last(), "order", "doc_id", "size")
    return shown.repartitionByRange(*order).sortWithinPartitions(*order)


def training_set(
    docs: DataFrame,
    schedules: Sequence[Schedule] = SCHEDULES,
    named: dict[str, int] | None = None,
    epochs: int = EPOCHS,
) -> DataFrame:
    """The documents, with all their columns, as often as the mix takes them and in its order.

    Adds ``position`` and ``words`` (how many of the copy's words are taken, from its start;
    only the last copy of a source has fewer than the document).  Written as it is, file
    after file holds the training order.
    """
    position, words = free_name(docs, "position"), free_name(docs, "words")
    mixed = mix(docs, schedules, named, epochs)
    copies = mixed.select(
        F.struct("doc_id", "source", "text_hash").alias("of"), "order", F.explode("copies").alias("copy")
    )
    texts = docs.select(
        F.struct("doc_id", "source", F.xxhash64("text").alias("text_hash")).alias("key"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    ).dropDuplicates(["key"])
    order = (F.col(position), F.col("order"), F.col("words_taken"))
    out = copies.join(texts, F.col("of").eqNullSafe(F.col("key")))
    out = out.select("row", "order", F.col("copy.position").alias(position), F.col("copy.words").alias("words_taken"))
    out = out.repartitionByRange(*order).sortWithinPartitions(*order)
    return out.select(
        *[F.col(f"row.`{c}`").alias(c) for c in docs.columns], position, F.col("words_taken").alias(words)
    )
