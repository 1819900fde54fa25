"""Two streams against the batch join; what the state forgets."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veladura.streaming.intake import read_stream
from veladura.streaming.joins import join_streams

LEFT, RIGHT = "t string, a bigint, at timestamp", "t string, b bigint, bt timestamp"
START = datetime(2024, 1, 1)
HOUR = timedelta(hours=1)


def hours(*rows):
    return [(t, n, None if h is None else START + HOUR * h) for t, n, h in rows]


def join(left, right, **more):
    return join_streams(left, right, "t", "at", "bt", **{"within": 2 * HOUR, "late": HOUR} | more)


def run(spark, root, lefts, rights, how="inner"):
    """One file per micro-batch; what came out, and the rows in state after each batch."""
    for name, schema, files in (("l", LEFT, lefts), ("r", RIGHT, rights)):
        for rows in files:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/{name}")
    sides = [read_stream(spark, f"{root}/{n}", s, maxFilesPerTrigger=1) for n, s in (("l", LEFT), ("r", RIGHT))]
    query = (
        join(*sides, how=how).writeStream.format("parquet").option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    kept = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    return sorted(map(tuple, spark.read.parquet(f"{root}/out").collect()), key=str), kept


def plain(lefts, rights, within=2 * HOUR):
    return sorted(
        ((t, a, at, b, bt) for t, a, at in lefts for u, b, bt in rights
         if t is not None and t == u and at and bt and abs(at - bt) <= within),
        key=str,
    )


def test_batch_against_a_plain_join(spark):
    lefts = hours(*[("hot" if i % 3 else f"t{i % 4}", i, i * 0.37) for i in range(60)], (None, 90, 1), ("hot", 91, None))
    rights = hours(*[("hot" if i % 3 else f"t{i % 4}", i, i * 0.41) for i in range(60)], (None, 90, 1), ("hot", 91, None))
    rights += rights[:2]  # repeated records
    edge = [("e", 100, START - 3 * HOUR)], [("e", 100, START - HOUR), ("e", 101, START - HOUR + timedelta(microseconds=1))]
    lefts, rights = lefts + edge[0], rights + edge[1]
    got = join(spark.createDataFrame(lefts, LEFT), spark.createDataFrame(rights, RIGHT))
    assert got.columns == ["t", "a", "at", "b", "bt"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(lefts, rights)
    outer = join(spark.createDataFrame(lefts, LEFT), spark.createDataFrame(rights, RIGHT), how="left_outer")
    alone = [r for r in lefts if not any(r[1] == p[1] for p in plain(lefts, rights))]
    assert outer.filter("b IS NULL").count() == len(alone) > 0


def test_streams_equal_the_batch_and_forget(spark, tmp_path):
    lefts = [hours(*[("hot" if i % 3 else "cold", 100 * d + i, 12 * d + i / 3) for i in range(30)]) for d in range(8)]
    rights = [hours(*[("hot" if i % 3 else "cold", 100 * d + i, 12 * d + i / 4) for i in range(30)]) for d in range(8)]
    got, kept = run(spark, str(tmp_path), lefts, rights)
    assert got == plain(sum(lefts, []), sum(rights, []))
    # left records once, right ones in three slots: what stays is of the last two batches, not of all eight
    assert max(kept) <= 2 * (30 + 90) < 8 * (30 + 90) and kept[-1] <= 2 * (30 + 90)


def test_left_outer_stream(spark, tmp_path):
    lefts = [hours(("x", 1, 0), ("y", 2, 0.5)), hours(("x", 3, 30)), hours(("x", 4, 60))]
    rights = [hours(("x", 1, 1)), hours(("z", 2, 30)), hours(("z", 3, 60))]
    got, _ = run(spark, str(tmp_path), lefts, rights, "left_outer")
    pairs = {(r[1], r[3]) for r in got}
    assert {(1, 1), (2, None)} <= pairs and (1, None) not in pairs


def test_refusals_and_empty(spark):
    left, right = spark.createDataFrame([], LEFT), spark.createDataFrame([], RIGHT)
    assert join(left, right).isEmpty()
    with pytest.raises(ValueError, match="columns named"):
        join(left, right.withColumn("A", F.lit(1)))
    with pytest.raises(ValueError, match="within"):
        join(left, right, within=timedelta(0))
    with pytest.raises(ValueError, match="how"):
        join(left, right, how="full")
