"""Lookups by several columns on one layout: results, and the share of the table that is read."""

from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from suite.data import created_at
from veladura.operators.lookup import newest
from veladura.sources.layout import share_bounds, write_for_lookups

COLUMNS = ("cpf_protected", "id", "created_at")


@pytest.fixture(scope="module")
def laid_out(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("layout"))
    digits = F.lpad(F.pmod(F.xxhash64("id"), F.lit(10**11)).cast("string"), 11, "0")
    rows = spark.range(64_000).select("id", digits.alias("cpf_protected"), created_at(F.col("id") * 37).alias("created_at"), F.md5(digits).alias("other"))
    rows.write.parquet(f"{root}/plain")
    plain = spark.read.parquet(f"{root}/plain")
    write_for_lookups(plain, f"{root}/laid", COLUMNS, exact=("cpf_protected", "id"), files=64)
    return plain, spark.read.parquet(f"{root}/laid"), f"{root}/laid"


def files_that_may_hold(path, column, value):
    """From the statistics in the footers: files whose range has the value, and all files."""
    hit = total = 0
    for file in Path(path).glob("part-*"):
        meta = pq.read_metadata(file)
        i = meta.schema.names.index(column)
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(i).statistics
            total += 1
            hit += s is None or not s.has_min_max or s.min <= value <= s.max
    return hit, total


def rows_read(df):
    """Rows that the scan handed on, from its metrics after the query ran."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    stack, found = [execution.executedPlan()], 0
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            found += node.metrics().apply("numOutputRows").value()
        inner = node.executedPlan() if name == "AdaptiveSparkPlanExec" else node.plan() if name.endswith("QueryStageExec") else None
        stack += [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_same_rows_in_even_files(laid_out):
    plain, laid, path = laid_out
    assert plain.exceptAll(laid).isEmpty() and laid.count() == 64_000
    sizes = [pq.read_metadata(f).num_rows for f in Path(path).glob("part-*")]
    assert len(sizes) == 64 and max(sizes) < 3000


def test_each_search_reads_a_small_share(laid_out):
    plain, laid, path = laid_out
    row = plain.filter("id = 31415").first()
    for column in ("id", "cpf_protected"):
        hit, total = files_that_may_hold(path, column, row[column])
        assert total == 64 and hit <= 0.4 * total  # about 1/4 is expected: 64 to the power of -1/3
        found = laid.filter(F.col(column) == row[column])
        assert [r.id for r in found.collect()] == [31415]
        assert rows_read(laid.filter(F.col(column) == row[column])) <= 0.1 * 64_000  # bloom filters
    late = plain.agg(F.max("created_at")).first()[0]
    assert rows_read(laid.filter(F.col("created_at") >= F.lit(late))) <= 0.4 * 64_000
    assert newest(laid).collect() == newest(plain).collect()


def test_odd_values(spark, tmp_path):
    schema = "k string, n double, t timestamp, N2 bigint"
    rows = [(None, None, None, 1), ("x", float("nan"), None, 2), ("", float("inf"), None, 3), ("12", -float("inf"), None, None)]
    rows += [("777", 0.5, None, 7)] * 50  # one value in most rows
    df = spark.createDataFrame(rows, schema)
    write_for_lookups(df, f"{tmp_path}/a", ("k", "n", "t", "N2"), files=5)
    got = spark.read.parquet(f"{tmp_path}/a")
    assert got.count() == 54 and df.select("k", "t", "N2").exceptAll(got.select("k", "t", "N2")).isEmpty()
    assert share_bounds(df, ["t"]) == {"t": []}
    write_for_lookups(df.limit(0), f"{tmp_path}/b", ("n",))
    assert spark.read.schema(schema).parquet(f"{tmp_path}/b").isEmpty()
    with pytest.raises(ValueError, match="no place"):
        write_for_lookups(df.withColumn("b", F.lit(True)), f"{tmp_path}/c", ("b",))
    with pytest.raises(ValueError, match="60 bits"):
        write_for_lookups(df, f"{tmp_path}/c", ())
