"""Frequent keys: a third of all rows share one.  Results must be whole and spread."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from veladura.operators.protect import protect
from suite import QUERIES
from suite.data import TOKEN_FIELDS, people, stored, stored_token_map
from veladura.operators.lookup import find_many
from veladura.operators.skew import lookup_join
from veladura.operators.token_map import (
    build_token_map,
    detokenize,
    detokenize_by_address,
    only_tokens_of,
)
from veladura.operators.validate import duplicate_keys, only_new
from veladura.operators.verify import convergence_report
from veladura.policy import ProtectionPolicy
from veladura.sources.tables import with_new_ids, write_clustered, write_token_map

N = 30_000


@pytest.fixture(scope="module")
def facts(spark):
    """A third of the rows under one key, some under none, the rest under 5,000 keys."""
    key = (
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .when(F.col("id") % 100 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("k"), F.pmod(F.xxhash64("id"), F.lit(5000)).cast("string")))
    )
    return spark.range(N).select("id", key.alias("key"))


@pytest.mark.parametrize("hint", [None, "merge", "broadcast"])
def test_lookup_join_equals_the_plain_join(facts, hint):
    entries = facts.filter("key is not null and key <> 'k17'").groupBy("key").agg(
        F.max("id").alias("value")
    )
    ours = lookup_join(facts, entries, "key", hint).select("id", "key", "value")
    plain = facts.join(entries, "key", "left").select("id", "key", "value")
    assert ours.count() == N
    assert ours.exceptAll(plain).isEmpty() and plain.exceptAll(ours).isEmpty()


@pytest.fixture
def small_parts(spark):
    """Skew handling as it would be at size: a share of these rows counts as large."""
    names = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize("hot", ["'hot'", "null"])
def test_hot_rows_are_spread(spark, facts, tmp_path, small_parts, hot):
    """Neither a frequent key nor a third of rows without any fills one task."""
    facts = facts.withColumn("load", F.sha2(F.col("id").cast("string"), 256))
    facts.withColumn("key", F.expr(f"if(id % 3 = 0, {hot}, key)")).repartition(8).write.parquet(
        str(tmp_path / "facts")
    )
    facts = spark.read.parquet(str(tmp_path / "facts"))
    facts.filter("key is not null").groupBy("key").agg(F.max("id").alias("value")).write.parquet(
        str(tmp_path / "entries")
    )
    joined = lookup_join(facts, spark.read.parquet(str(tmp_path / "entries")), "key")
    per_task = joined.groupBy(F.spark_partition_id().alias("p"))
    sizes = [r.n for r in per_task.agg(F.count(F.lit(1)).alias("n"), F.max("load")).collect()]
    assert max(sizes) < N / 4 and sum(sizes) == N


def test_input_is_scanned_once_whatever_the_columns(spark, sf_dir, keys):
    """The plan grows with the number of columns, not with their power set."""
    tokens = stored_token_map(spark, sf_dir)
    for n in range(1, len(TOKEN_FIELDS) + 1):
        fields = dict(list(TOKEN_FIELDS.items())[:n])
        raw = people(spark, sf_dir).select("id", *fields)
        safe = protect(raw, ProtectionPolicy(fields), keys)
        started = time.perf_counter()
        back = detokenize(safe, fields, tokens, keys, hint="merge")
        plan = back._jdf.queryExecution().executedPlan().toString()
        assert time.perf_counter() - started < 5
        assert plan.count("/customer.parquet") == 1
        assert not re.search("GlobalLimit|SinglePartition", plan)


def test_search_lists_take_no_single_task(spark, sf_dir, keys):
    wanted = people(spark, sf_dir).select("cpf")
    plan = find_many(stored(spark, sf_dir), wanted, keys)._jdf.queryExecution().executedPlan()
    assert not re.search("GlobalLimit|SinglePartition", plan.toString())


def test_one_cipher_per_input(spark, sf_dir):
    df = QUERIES["keys_not_stored_yet"].run(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ArrowEvalPython \[", plan)) == 2


def test_few_tokens_filter_the_scan_of_the_map(spark, facts, keys, tmp_path):
    field = {"key": "tok-endereco"}
    write_token_map(build_token_map(facts, field, keys), str(tmp_path / "map"), files=4)
    stored = spark.read.parquet(str(tmp_path / "map"))
    assert stored.select(F.input_file_name()).distinct().count() == 4
    few = facts.filter("id between 10 and 13")
    safe = protect(few, ProtectionPolicy(field), keys)
    some = only_tokens_of(safe, field, stored)
    back = detokenize(safe, field, some, keys)
    assert sorted(back.collect()) == sorted(few.collect())
    with pytest.raises(ValueError):
        only_tokens_of(protect(facts, ProtectionPolicy(field), keys), field, stored)
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "In(token, [TKN-" in plan  # pushed to the files


def test_detokenize_with_a_hot_token(facts, keys):
    field = {"key": "tok-endereco"}
    tokens = build_token_map(facts, field, keys)
    safe = protect(facts, ProtectionPolicy(field), keys)
    back = detokenize(safe, field, tokens, keys, hint="merge")
    assert back.exceptAll(facts).isEmpty() and back.count() == N


def test_only_new_keeps_the_first_of_each_key(spark, facts):
    random.seed(7)
    rows = [(r.id, r.key) for r in facts.filter("key is not null").collect()]
    known = {f"k{i}" for i in random.sample(range(5000), 800)}
    expected = {}
    for i, k in sorted(rows):
        if k not in known:
            expected.setdefault(k, i)
    stored = spark.createDataFrame([(k,) for k in known], "key string")
    got = only_new(facts.filter("key is not null"), stored, "key").collect()
    assert {r.key: r.id for r in got} == expected and len(got) == len(expected)


def test_only_new_keeps_rows_without_key(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (2, None), (3, "a"), (4, "a")], "id int, key string")
    none = spark.createDataFrame([(None,), (None,), ("b",)], "key string")
    assert sorted(r.id for r in only_new(rows, none, "key").collect()) == [1, 2, 2, 3]


def test_rows_without_usable_key_are_spread_over_files(spark, tmp_path):
    key = F.when(F.col("id") % 2 == 0, F.lpad((F.col("id") * 4_000_037 % 10**11).cast("string"), 11, "0"))
    rows = spark.range(20_000).select("id", key.alias("cpf_protected"))
    write_clustered(rows, str(tmp_path / "t"), files=8)
    back = spark.read.parquet(str(tmp_path / "t"))
    sizes = [r["count"] for r in back.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 4000


def test_duplicates(facts):
    counts = {r.key: r.n for r in duplicate_keys(facts, "key").collect()}
    assert counts["hot"] == N // 3
    assert all(n > 1 for n in counts.values())


@pytest.mark.parametrize("rows_per_bucket", [10**6, 500, 7])
def test_new_ids_are_dense_and_repeatable(facts, rows_per_bucket):
    unique = facts.select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("key"))
    first = with_new_ids(unique, "key", F.lit(1000).cast("bigint"), rows_per_bucket)
    again = with_new_ids(unique.repartition(5), "key", F.lit(1000).cast("bigint"), rows_per_bucket)
    ids = sorted(r.id for r in first.collect())
    assert ids == list(range(1001, 1001 + N))
    assert first.exceptAll(again).isEmpty()


def test_convergence_of_a_hot_value(facts, keys):
    field = {"out": "tok-raca"}
    safe = protect(facts.withColumn("out", F.col("key")), ProtectionPolicy(field), keys)
    row = convergence_report(safe, {"key": "out"}).first()
    assert row.deterministic and row.injective
    assert row.n_pairs == facts.filter("key is not null").select("key").distinct().count()
    broken = safe.withColumn("out", F.when(F.col("id") == 3, F.lit("x")).otherwise(F.col("out")))
    assert not convergence_report(broken, {"key": "out"}).first().deterministic


def test_detokenize_by_address_shuffles_wide_rows_once(spark, facts, keys, small_parts):
    """Five columns, a hot token, blanks and nulls: the result of column by column, in one join with the map."""
    names = list(TOKEN_FIELDS)
    raw = facts.select("id", *[F.when(F.col("id") % 7 == i, F.lit("")).otherwise(F.col("key")).alias(c) for i, c in enumerate(names)])
    raw = raw.filter("id < 6000")
    safe = protect(raw, ProtectionPolicy(TOKEN_FIELDS), keys)
    token_map = build_token_map(raw, TOKEN_FIELDS, keys)
    got = detokenize_by_address(safe, TOKEN_FIELDS, token_map, keys)
    want = detokenize(safe, TOKEN_FIELDS, token_map, keys)
    assert got.columns == want.columns
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() == 6000
    plan = got._jdf.queryExecution().executedPlan().toString()
    wide = re.findall(r"Exchange hashpartitioning\(of#", plan)
    by_token = re.findall(r"Exchange hashpartitioning\(_probe#", plan)
    assert (len(wide), len(by_token)) == (1, 1), re.findall("Exchange hash.*", plan)
