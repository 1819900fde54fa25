"""Changing a table file by file."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from suite.data import stored_staging
from veladura.plans import retrofit
from veladura.sources.versions import ConflictError, VersionedTable


@pytest.fixture
def numbers(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    rows = spark.range(200).withColumns({"v": F.lit("old"), "updated_at": F.lit(None).cast("timestamp")})
    table.create(rows.repartitionByRange(20, "id"))
    return table


def digests(table, number=None):
    return {f: hashlib.md5(Path(f"{table.root}/data/{f}").read_bytes()).hexdigest() for f in table.version(number).files}


def change(spark, *ids, v="new"):
    return spark.createDataFrame([(i, v, None) for i in ids], "id bigint, v string, updated_at timestamp")


def test_only_hit_files_are_written(spark, numbers):
    before = digests(numbers)
    assert len(before) == 20
    new = numbers.update(change(spark, 57, 5_000, None))
    after = digests(numbers)
    assert len(before.items() & after.items()) == 19 and new.number == 1 and numbers.versions() == [0, 1]
    rows = {r.id: r for r in numbers.read().collect()}
    assert len(rows) == 200 and {i for i, r in rows.items() if r.v == "new"} == {57}
    assert rows[57].updated_at is not None and rows[56].updated_at is None
    assert {r.v for r in numbers.read(0).collect()} == {"old"}  # the old version stays readable
    assert numbers.update(change(spark, 5_000)).number == 1  # nothing to do, no version
    with pytest.raises(ValueError, match="several changes"):
        numbers.update(change(spark, 3, 3))


def test_broken_off_before_the_switch(spark, numbers, monkeypatch):
    before = digests(numbers)
    with monkeypatch.context() as broken:
        broken.setattr(VersionedTable, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            numbers.update(change(spark, 1, 199))
    assert digests(numbers) == before and {r.v for r in numbers.read().collect()} == {"old"}
    assert numbers.update(change(spark, 1, 199)).number == 1
    assert numbers.read().filter("v = 'new'").count() == 2


def test_second_writer_is_refused(spark, numbers):
    start = numbers.version()
    numbers.update(change(spark, 1))
    late = numbers.files_with(start, lambda rows: rows.filter("id = 150"))
    with pytest.raises(ConflictError):
        numbers.rewrite(start, late, lambda rows: rows.withColumn("v", F.lit("lost")))
    assert {r.v for r in numbers.read().collect()} == {"old", "new"}
    assert all(n.isdigit() for n in numbers._names("versions"))
    with pytest.raises(ConflictError):
        numbers.create(numbers.read())


def test_forget(spark, numbers):
    numbers.update(change(spark, 1))
    numbers.update(change(spark, 2))
    numbers.forget(2)
    assert numbers.versions() == [2] and numbers.read().count() == 200
    kept = {str(p.relative_to(f"{numbers.root}/data")) for p in Path(f"{numbers.root}/data").rglob("part-*")}
    assert kept == set(numbers.version().files)
    with pytest.raises(FileNotFoundError):
        numbers.read(0)


def test_retrofit_by_file(spark, keys, sf_dir, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "customers"))
    staged = stored_staging(spark, sf_dir)
    done = retrofit.protect_in_place(staged, keys)
    # the first half is protected already; one file of the rest must be written
    half = done.filter("id % 2 = 0").coalesce(1).unionByName(staged.filter("id % 2 = 1").coalesce(1))
    table.create(half)
    before = digests(table)
    version = retrofit.retrofit_files(table, keys)
    assert len(before.items() & digests(table).items()) == len(before) - 1
    got, want = table.read(), done
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert retrofit.retrofit_files(table, keys) == version  # again: nothing to do


def test_empty_table(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.read()
    table.create(spark.createDataFrame([], "id bigint, v string"))
    assert table.read().isEmpty()
    assert table.update(spark.createDataFrame([(1, "x")], "id bigint, v string")).number == 0
