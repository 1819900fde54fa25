"""Hash trees over two versions: what differs, and how little is read for it."""

import random

import pytest
from pyspark.sql import functions as F

from veladura.operators.difference import (
    Ranges,
    differences,
    differing_leaves,
    differing_nodes,
    leaf_hashes,
    rows_in,
    tree,
)

SCHEMA = "id bigint, v string, w string"


def found(df):
    return {(r.id, r.change, r.n_before, r.n_after, tuple(r.columns) if r.columns is not None else None) for r in df.collect()}


def test_three_changed_rows_among_many(spark, tmp_path):
    old = spark.range(20_000).select("id", F.md5(F.col("id").cast("string")).alias("v"), F.lit("x").alias("w"))
    old.repartitionByRange(20, "id").sortWithinPartitions("id").write.parquet(f"{tmp_path}/old")
    before = spark.read.parquet(f"{tmp_path}/old")
    hit = F.col("id").isin(7, 10_000, 19_999)
    before.withColumn("w", F.when(hit, "y").otherwise(F.col("w"))).write.parquet(f"{tmp_path}/new")
    after = spark.read.parquet(f"{tmp_path}/new")
    ranges = Ranges.of(before, "id", 1000)
    leaves = differing_leaves(leaf_hashes(before, ranges), leaf_hashes(after, ranges))
    assert leaves == [0, 500, 999]
    assert rows_in(before, ranges, leaves).count() == 60  # 3 of 1000 ranges of 20 rows
    plan = rows_in(before, ranges, leaves)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,10000)" in plan and "LessThan(id,10020)" in plan
    assert found(differences(before, after, ranges=ranges)) == {(i, "changed", 1, 1, ("w",)) for i in (7, 10_000, 19_999)}
    nodes = differing_nodes(tree(leaf_hashes(before, ranges), ranges), tree(leaf_hashes(after, ranges), ranges))
    per_level = {level: sorted(r.node for r in nodes.collect() if r.level == level) for level in range(4)}
    assert per_level == {3: [0], 2: [0, 1, 3], 1: [0, 31, 62], 0: [0, 500, 999]}


def test_equal_versions_join_nothing(spark):
    rows = spark.range(500).select("id", F.lit("a").alias("v"), F.lit(None).cast("string").alias("w"))
    ranges = Ranges.of(rows, "id", 64)
    stored = leaf_hashes(rows, ranges)
    assert differing_leaves(stored, leaf_hashes(rows.orderBy(F.rand(1)), ranges)) == []
    assert differing_nodes(tree(stored, ranges), tree(stored, ranges)).isEmpty()
    same = differences(rows, rows, ranges=ranges, leaves_before=stored)
    assert same.isEmpty() and "Join" not in same._jdf.queryExecution().optimizedPlan().toString()
    assert rows_in(rows, ranges, []).isEmpty()


def test_nulls_repeats_and_empty_tables(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    before = make((1, None, "a"), (2, "b", "b"), (2, "b", "b"), (None, "n", "n"), (4, "", None))
    after = make((1, "a", None), (2, "b", "b"), (None, "n", "m"), (4, None, ""), (9, "z", "z"))
    assert found(differences(before, after)) == {
        (1, "changed", 1, 1, ("v", "w")),
        (2, "removed", 1, 0, None),
        (None, "changed", 1, 1, ("w",)),
        (4, "changed", 1, 1, ("v", "w")),
        (9, "added", 0, 1, None),
    }
    assert found(differences(make(), make())) == set()
    assert found(differences(make(), make((5, "a", "b")))) == {(5, "added", 0, 1, None)}
    assert found(differences(make((5, "a", "b")), make())) == {(5, "removed", 1, 0, None)}
    with pytest.raises(ValueError, match="columns differ"):
        differences(make(), make().drop("w"))


def test_against_a_plain_version(spark):
    draw = random.Random(5)
    for leaves in (1, 7, 300):
        row = lambda: (draw.choice([None, *range(-40, 40)]), draw.choice("ab"), draw.choice(["", None, "c"]))
        a = [row() for _ in range(120)]
        b = [r for r in a if draw.random() < 0.9] + [row() for _ in range(15)]
        expected = {}
        for r in set(a) | set(b):
            n = b.count(r) - a.count(r)
            if n:
                was = expected.get(r[0], (0, 0))
                expected[r[0]] = (was[0] + max(-n, 0), was[1] + max(n, 0))
        before, after = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
        got = differences(before, after, ranges=Ranges.of(before, "id", leaves)).collect()
        assert {r.id: (r.n_before, r.n_after) for r in got} == expected


def test_many_ranges_are_read_in_few_spans(spark):
    ranges = Ranges("id", 0, 10, 4000)
    leaves = [*range(0, 4000, 7), -1]
    spans = ranges.spans(leaves)
    assert len(spans) == 64 and all(any(a <= x <= b for a, b in spans) for x in leaves if x >= 0)
    rows = spark.range(-50, 45_000).select(F.when(F.col("id") != 3, F.col("id")).alias("id"))
    got = {r.id for r in rows_in(rows, ranges, leaves).collect()}
    leaf = lambda i: -1 if i is None else min(3999, max(0, i // 10))
    assert got == {i for i in [None, *range(-50, 45_000)] if i != 3 and leaf(i) in set(leaves)}


def test_extreme_keys_and_hot_key(spark):
    edge = [(-(2**63), "a", "a"), (2**63 - 1, "b", "b")]
    before = spark.createDataFrame(edge + [(0, str(i), "h") for i in range(3000)], SCHEMA)
    after = before.filter("v <> '17'")
    assert found(differences(before, after)) == {(0, "removed", 1, 0, None)}
