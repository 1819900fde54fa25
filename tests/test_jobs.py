"""File-to-file job, retrofit, intake, streams, storage."""

import gzip

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from veladura import policy as P
from veladura.operators.protect import protect
from veladura.operators.token_map import build_token_map
from veladura.operators.verify import before_after_report
from veladura.plans import csv_job, retrofit
from veladura.plans.create import create_customers, take_in
from veladura.session import fresh_path, shared_folder
from veladura.sources import tables
from veladura.sources import csv_text
from veladura.sources.csv_text import read_csv, write_csv
from veladura.sources.synthetic import sample_customers
from veladura.streaming.intake import protect_stream, read_stream


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


# ---- CSV -------------------------------------------------------------------


def test_csv_keeps_text_and_blanks(spark, tmp_path):
    rows = [("007", " padded ", 'say "hi", ok', "N/A"), ("1e3", "", "ção", "null"), ("3", None, "a", "x")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    write_csv(df, str(tmp_path / "t"))
    back = read_csv(spark, str(tmp_path / "t"))
    assert [t for _, t in back.dtypes] == ["string"] * 4
    expected = [("007", " padded ", 'say "hi", ok', None), ("1e3", None, "ção", None), ("3", None, "a", "x")]
    assert sorted(map(tuple, back.collect())) == sorted(expected)
    raw = read_csv(spark, str(tmp_path / "t"), ["a", "b", "c", "d"], na_values=())
    assert {r.d for r in raw.collect()} == {"N/A", "null", "x"}


def test_csv_with_line_breaks_and_wrong_counts(spark, tmp_path):
    df = spark.createDataFrame([("1", "a\nb"), ("2", 'x "y"\n\nz, w')], "id string, v string")
    write_csv(df, str(tmp_path / "t"))
    assert same(read_csv(spark, str(tmp_path / "t"), multi_line=True), df)
    assert same(read_csv(spark, str(tmp_path / "t")), df)
    with pytest.raises(Exception, match="(?i)malformed"):
        read_csv(spark, str(tmp_path / "t"), multi_line=False).collect()
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n3\n")
    (tmp_path / "long.csv").write_text("a,b\n1,2\n3,4,5\n")
    for name in ("bad.csv", "long.csv"):
        for whole in (None, False, True):
            with pytest.raises(Exception, match="(?i)malformed"):
                read_csv(spark, str(tmp_path / name), multi_line=whole).select("a").collect()


def test_csv_columns_go_by_their_own_header(spark, tmp_path, monkeypatch):
    folder = tmp_path / "t"
    folder.mkdir()
    (folder / "a.csv").write_text("id,obs,cpf\n1,x,11122233344\n")
    (folder / "b.csv").write_text("id,cpf,obs\n2,55566677788,y\n")
    (folder / "c.csv").write_text("\ufeffCPF ,ID,nota\n99988877766,3,\"two\nlines\"\n")
    (folder / "d.csv").write_bytes(gzip.compress(b"id\n4\n"))
    (folder / "d.csv").rename(folder / "d.csv.gz")
    (folder / "empty.csv").write_text("")
    (folder / "_hidden.csv").write_text("zzz\n1\n")
    want = {("1", "x", "11122233344", None), ("2", "y", "55566677788", None), ("3", None, "99988877766", "two\nlines"), ("4", None, None, None)}
    for size in (0, csv_text.WHOLE_FILE):
        monkeypatch.setattr(csv_text, "WHOLE_FILE", size)
        got = read_csv(spark, str(folder), multi_line=None if size else True)
        assert got.columns == ["id", "obs", "cpf", "nota"]
        assert {tuple(r) for r in got.collect()} == want
    assert read_csv(spark, str(folder / "[ab].csv")).inputFiles() and len(got.inputFiles()) == 4
    swapped = read_csv(spark, str(folder / "b.csv"), ["obs", "id", "cpf"])
    assert [tuple(r) for r in swapped.collect()] == [("y", "2", "55566677788")]
    with pytest.raises(ValueError, match="no column 'obs'"):
        read_csv(spark, str(folder), ["id", "obs"])
    (folder / "e.csv").write_text("cpf,CPF\n1,2\n")
    with pytest.raises(ValueError, match="more than one column 'cpf'"):
        read_csv(spark, str(folder))
    assert read_csv(spark, str(folder / "empty.csv")).columns == []


def test_job_leaks_nothing_from_files_of_other_order(spark, keys, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.csv").write_text("id,obs,cpf\n1,ok,11122233344\n")
    (folder / "b.csv").write_text("id,cpf,obs\n2,98765432100,ok\n")
    (folder / "c.csv").write_text("Cpf,id\n45678912300,3\n")
    summary = csv_job.protect_csv(spark, str(folder), out, keys)
    assert (summary["records"], summary["fields_protected"], summary["errors"]) == (3, 1, 0)
    rows = read_csv(spark, out, ["id", "obs", "cpf"]).collect()
    assert {(r.id, r.obs) for r in rows} == {("1", "ok"), ("2", "ok"), ("3", None)}
    written = " ".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert not any(raw in written for raw in ("11122233344", "98765432100", "45678912300"))


def test_missing_input(spark, keys, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        csv_job.protect_csv(spark, str(tmp_path / "no"), str(tmp_path / "out"), keys)


def test_job_with_generated_input(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("VELADURA_MASTER_KEY", "00" * 32)
    raw, out = str(tmp_path / "raw"), str(tmp_path / "deep" / "out")
    summary = csv_job.main(["--input", raw, "--output", out, "--role", "api-role", "--generate", "250"])
    assert {k: summary[k] for k in ("records", "fields_protected", "errors")} == {
        "records": 250,
        "fields_protected": 7,
        "errors": 0,
    }
    before, after = read_csv(spark, raw), read_csv(spark, out)
    assert after.columns == before.columns and after.count() == 250
    assert not before.select("cpf").intersect(after.select("cpf")).count()
    usual = csv_job.main(["--input", raw, "--output", out + "2"])
    assert usual["errors"] == 250  # its role may not mask names
    hidden = read_csv(spark, out + "2")
    assert {r.nome for r in hidden.select("nome").collect()} == {"ERROR"}
    with pytest.raises(P.GrantError):
        csv_job.main(["--input", raw, "--output", out + "3", "--on-error", "raise"])
    chosen = ["--input", raw, "--output", out, "--fields", "email:mask-email", "--overwrite"]
    assert csv_job.main(chosen)["fields_protected"] == 1
    assert read_csv(spark, out).select("cpf").exceptAll(before.select("cpf")).isEmpty()


# ---- storage ---------------------------------------------------------------


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_folder(spark)
    assert folder == named.rstrip("/") if named else folder == shared_folder(spark)
    assert fresh_path(spark, "x").startswith(f"{folder}/veladura/x-")
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


def test_clustered_files_hold_separate_key_ranges(spark, keys, tmp_path):
    safe = protect(sample_customers(spark, 3000).select("id", "cpf"), P.customer_policy, keys)
    tables.write_clustered(safe.withColumnRenamed("cpf", "cpf_protected"), str(tmp_path / "t"), files=4)
    back = spark.read.parquet(str(tmp_path / "t"))
    ranges = sorted(
        (r.low, r.high, r.n)
        for r in back.groupBy(F.input_file_name())
        .agg(
            F.min("cpf_protected").alias("low"),
            F.max("cpf_protected").alias("high"),
            F.count(F.lit(1)).alias("n"),
        )
        .collect()
    )
    assert len(ranges) == 4 and sum(r[2] for r in ranges) == 3000
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    assert max(r[2] for r in ranges) < 1000


def test_staging_is_replaced(spark, tmp_path):
    path = str(tmp_path / "staging")
    tables.append_rows(tables.staging_rows(sample_customers(spark, 5)), path)
    tables.create_staging(spark, path)
    assert spark.read.parquet(path).count() == 0


# ---- retrofit --------------------------------------------------------------


@pytest.fixture(scope="module")
def staged(spark):
    return tables.staging_rows(sample_customers(spark, 400))


@pytest.fixture(scope="module")
def token_map(staged, keys):
    columns = {
        c: n for c, n in P.retrofit_policy.fields.items() if P.transformation(n).kind == P.TOKENIZATION
    }
    return build_token_map(staged, columns, keys)


def test_retrofit_in_two_steps(spark, staged, keys, tmp_path):
    half = staged.withColumn("created_at", F.lit(None).cast("timestamp"))
    done = retrofit.protect_rows(half.filter("id <= 150"), keys)
    mixed = done.unionByName(half.filter("id > 150"))
    after = retrofit.retrofit(mixed, str(tmp_path / "v2"), keys)
    assert same(after, retrofit.protect_in_place(half, keys))
    assert after.filter("protected").count() == 400
    assert same(retrofit.protect_in_place(after, keys), after)
    with pytest.raises(AnalysisException):  # a version is never overwritten
        retrofit.write_version(after, str(tmp_path / "v2"))


def test_raw_columns_go_only_when_all_is_right(staged, keys, token_map):
    with pytest.raises(ValueError):
        retrofit.drop_raw(staged, keys, token_map)
    after = retrofit.protect_in_place(staged, keys)
    broken = after.withColumn(
        "pan_protected",
        F.when(F.col("id") == 8, F.lit("1" * 16)).otherwise(F.col("pan_protected")),
    )
    with pytest.raises(ValueError):
        retrofit.drop_raw(broken, keys, token_map)
    assert not [c for c in retrofit.drop_raw(after, keys, token_map).columns if c.endswith("_raw")]
    cleared = retrofit.clear_raw(after, keys, token_map)
    assert cleared.columns == after.columns
    assert cleared.filter(F.coalesce(*retrofit.RAW_TO_PROTECTED).isNotNull()).isEmpty()


def test_before_and_after(staged, keys):
    after = retrofit.protect_in_place(staged, keys)
    rows = {r["column"]: r for r in before_after_report(staged, after, retrofit.RAW_TO_PROTECTED).collect()}
    assert rows["cpf_raw"].n_changed == 400
    assert rows["pan_raw"].n_null == 400 // 7
    assert all(r.n_lost == r.n_missing == r.n_added == 0 for r in rows.values())
    fewer = after.filter("id > 7").withColumn(
        "saude_token", F.when(F.col("id") != 9, F.col("saude_token"))
    )
    report = before_after_report(staged.filter("id < 400"), fewer, retrofit.RAW_TO_PROTECTED)
    rows = {r["column"]: r for r in report.collect()}
    assert (rows["saude_raw"].n_lost, rows["cpf_raw"].n_lost) == (1, 0)
    assert (rows["cpf_raw"].n_missing, rows["cpf_raw"].n_added) == (7, 1)


def test_updates_add_nobody(staged):
    table = staged.select("id", "nome")
    changes = staged.sparkSession.createDataFrame([(3, "new"), (9999, "nobody")], "id bigint, nome string")
    after = {r.id: r.nome for r in retrofit.apply_updates(table, changes).collect()}
    assert len(after) == 400 and after[3] == "new"
    with pytest.raises(ValueError):
        retrofit.apply_updates(table, changes.unionByName(changes))


def test_retrofit_scans_once(spark, staged, keys, tmp_path):
    staged.write.parquet(str(tmp_path / "staged"))
    stored = spark.read.parquet(str(tmp_path / "staged"))
    plan = retrofit.protect_in_place(stored, keys)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Exchange" not in plan


# ---- intake ----------------------------------------------------------------


@pytest.fixture(scope="module")
def incoming(spark):
    fields = ("nome", "cpf", "email", "telefone", "pan", "cvv", "dob", "endereco", "conta")
    raw = sample_customers(spark, 300).select("id", *fields)
    return raw.withColumns(
        {
            "cpf": F.when(F.col("id") % 10 == 0, F.lit("123")).otherwise(F.col("cpf")),
            "email": F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("email")),
        }
    )


def test_create_assigns_ids_and_skips_what_is_stored(spark, incoming, keys, tmp_path):
    path = str(tmp_path / "clientes")
    spark.createDataFrame([], tables.STORED_CUSTOMER).write.parquet(path)
    good = 300 - len({i for i in range(1, 301) if i % 10 == 0 or i % 11 == 0})
    create_customers(incoming.filter("id <= 100"), path, keys)
    first = spark.read.parquet(path).count()
    shown = create_customers(incoming, path, keys)
    assert 0 < first < good == shown.count()
    assert sorted(r.id for r in shown.collect()) == list(range(1, good + 1))
    assert shown.filter("created_at is null").isEmpty()


def test_rejections_carry_no_data(incoming, keys):
    rejected = take_in(incoming, keys).rejected
    assert rejected.columns == ["id", "reason"]
    reasons = {r.id: r.reason for r in rejected.collect()}
    assert reasons[10] == "invalid cpf" and reasons[11] == "missing email"


def _files(incoming, path, parts):
    incoming.repartition(parts, "id").write.parquet(path)


def test_stream_equals_batch_and_survives_a_restart(spark, incoming, keys, tmp_path):
    source = str(tmp_path / "in")
    _files(incoming.filter("id <= 200"), source, 3)
    target = [str(tmp_path / n) for n in ("accepted", "rejected", "state")]

    def run():
        stream = read_stream(spark, source, incoming.schema, maxFilesPerTrigger=1)
        protect_stream(stream, *target, keys).awaitTermination()

    run()
    incoming.filter("id > 200").write.mode("append").parquet(source)
    run()
    run()  # nothing new arrives
    batch = take_in(incoming, keys)
    assert same(spark.read.parquet(target[0]).drop("run", "batch"), batch.accepted)
    assert same(spark.read.parquet(target[1]).drop("run", "batch"), batch.rejected)


def test_stream_with_unique_keys(spark, incoming, keys, tmp_path):
    twice = incoming.unionByName(incoming.withColumn("id", F.col("id") + 1000))
    source = str(tmp_path / "in")
    for part in range(3):  # one file per part: repeats inside a batch and across batches
        twice.filter(F.col("id") % 3 == part).coalesce(1).write.mode("append").parquet(source)
    target = [str(tmp_path / n) for n in ("accepted", "rejected", "state")]
    stream = read_stream(spark, source, twice.schema, maxFilesPerTrigger=1)
    protect_stream(stream, *target, keys, unique=True).awaitTermination()
    accepted = spark.read.parquet(target[0])
    expected = take_in(incoming, keys).accepted.select("cpf_protected")
    assert accepted.select("run").distinct().count() == 1
    # the last file brings only customers that the first two brought already
    assert {r.batch for r in accepted.select("batch").distinct().collect()} == {0, 1}
    assert same(accepted.select("cpf_protected"), expected)


def test_two_checkpoints_add_to_one_table(spark, incoming, keys, tmp_path):
    target = [str(tmp_path / n) for n in ("accepted", "rejected")]
    parts = [incoming.filter("id <= 200"), incoming.filter("id > 120")]
    for number, part in enumerate(parts):
        source = str(tmp_path / f"in{number}")
        part.write.parquet(source)
        for unique in ([False] if number == 0 else [True, True]):
            stream = read_stream(spark, source, incoming.schema, maxFilesPerTrigger=1)
            state = str(tmp_path / f"state{number}")
            protect_stream(stream, *target, state, keys, unique=unique).awaitTermination()
    accepted = spark.read.parquet(target[0])
    assert accepted.select("run").distinct().count() == 2
    assert same(accepted.select("cpf_protected"), take_in(incoming, keys).accepted.select("cpf_protected"))
