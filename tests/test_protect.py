"""Policies, grants, guards, error policy, key hygiene, reveal."""

import pytest
from pyspark.sql import functions as F

from veladura import policy as P
from veladura.keys import Keyring
from veladura.operators import protect as M
from veladura.operators.lookup import encrypted_literal, find_by_cpf, find_many
from veladura.operators.reveal import IrreversibleError, decode_values, reveal
from veladura.operators.token_map import build_token_map, detokenize, token_collisions
from veladura.operators.verify import format_report, leak_report, leaked_values
from veladura.sources.synthetic import sample_customers

# Five made-up customers; two card numbers repeat.
ROWS = [
    (1, "Jorge Salgado", "31415926535", "jota@lugar.example.org", "21930001111", "4012888888881881", "Beco do Sal, 9, PE"),
    (2, "Lia Moura", "27182818284", "lia@outro.example.net", "31930002222", "5105105105105100", "Largo da Fonte, 4, MG"),
    (3, "Nuno Vidal", "16180339887", "nuno@terceiro.example.org", "41930003333", "4222222222222220", "Rua do Cais, 77, PR"),
    (4, "Eva Pinto", "14142135623", "eva@quarto.example.net", "51930004444", "4012888888881881", "Praça Velha, 1, RS"),
    (5, "Rui Lago", "17320508075", "rui@quinto.example.org", "61930005555", "5105105105105100", "Estrada Nova, 350, DF"),
]
SCHEMA = "id int, nome string, cpf string, email string, telefone string, pan string, endereco string"


@pytest.fixture(scope="module")
def five(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_literal_rows(five, keys):
    safe = M.protect(five, P.customer_policy, keys)
    assert safe.columns == five.columns
    rows = {r.id: r for r in safe.collect()}
    assert len(rows) == 5
    assert rows[1].pan == rows[4].pan and rows[2].pan == rows[5].pan != rows[1].pan
    assert all(len(r.cpf) == 11 and r.cpf.isdigit() for r in rows.values())
    assert rows[1].nome == "J**** S******" and rows[1].email == "j***@l****.example.org"
    raw = {v for row in ROWS for v in row[1:]}
    assert not raw & {v for r in rows.values() for v in r[1:]}


def test_nulls_and_blanks(texts, keys):
    df = texts(None, "", " \t\n").withColumnRenamed("v", "cpf")
    for c in ("email", "nome", "endereco", "dob", "cvv"):
        df = df.withColumn(c, F.col("cpf"))
    for r in M.protect(df, P.customer_policy, keys).collect():
        assert set(r[1:]) == {[None, "", " \t\n"][r.id]}


@pytest.mark.parametrize("on_error, seen", [("null", None), ("sentinel", "ERROR")])
def test_error_policy_is_per_value(five, keys, on_error, seen):
    bad = five.withColumn("cpf", F.when(F.col("id") == 3, F.lit("123")).otherwise(F.col("cpf")))
    rows = M.protect(bad, P.customer_policy, keys, on_error=on_error).orderBy("id").collect()
    assert [r.cpf == seen for r in rows] == [False, False, True, False, False]
    report = M.protection_report(bad, P.customer_policy).collect()
    assert {r["column"]: r.n_errors for r in report if r.n_errors} == {"cpf": 1}


def test_raising_does_not_show_the_value(five, keys):
    bad = five.withColumn("cpf", F.lit("987654"))
    with pytest.raises(Exception, match="does not fit the template of ff-cpf") as raised:
        M.protect(bad, P.customer_policy, keys).collect()
    assert "987654" not in str(raised.value)


def test_unknown_error_policy(five, keys):
    with pytest.raises(ValueError):
        M.protect(five, P.customer_policy, keys, on_error="ignore")


@pytest.mark.parametrize(
    "role, operation, name, allowed",
    [
        ("api-role", "encode", "ff-cpf", True),
        ("api-role", "encode", "ff-rg", False),
        ("api-role", "decode", "ff-cpf", False),
        ("core-role", "decode", "ff-rg", True),
        ("core-role", "decode", "tok-saude", True),
        ("core-role", "decode", "mask-email", False),
        ("db-role", "encode", "mask-email", False),
        ("pipeline-role", "encode", "mask-nome", False),
        ("support-role", "encode", "mask-nome", True),
        ("support-role", "encode", "ff-cpf", False),
    ],
)
def test_grants(role, operation, name, allowed):
    assert P.may(role, operation, name) is allowed


def test_missing_grant_fails_before_the_data(five, keys):
    with pytest.raises(P.GrantError, match="mask-nome"):
        M.protect(five, P.batch_policy, keys, role="pipeline-role")
    with pytest.raises(P.GrantError):
        reveal(five, {"cpf": "ff-cpf"}, keys, role="api-role")
    with pytest.raises(ValueError, match="unknown role"):
        P.may("nobody", "encode", "ff-cpf")


def test_policy_text_and_detection():
    policy = P.ProtectionPolicy.parse("cpf:ff-cpf, email:mask-email,")
    assert policy.resolve(["ID", "CPF", "email"]) == {"CPF": "ff-cpf", "email": "mask-email"}
    assert policy.resolve(["id"]) == {}
    for wrong in ("cpf", "cpf:", ":ff-cpf", "cpf:ff-unknown"):
        with pytest.raises(ValueError):
            P.ProtectionPolicy.parse(wrong)


def test_no_personal_column_leaves_the_frame_alone(spark, keys):
    df = spark.range(3)
    assert M.protect(df, P.customer_policy, keys).collect() == df.collect()


def test_keys_stay_out_of_plans_and_repr(spark, five, keys):
    safe = M.protect(five, P.customer_policy, keys)
    safe.collect()
    query = safe._jdf.queryExecution()
    shown = query.toString() + query.executedPlan().toString() + repr(keys)
    for pad in keys.token_pads("tok-endereco"):
        assert pad.hex().upper() not in shown.upper()
        assert pad.decode("latin1") not in shown
    assert keys.fpe("ff-cpf")[0].hex() not in shown


def test_cipher_runs_once_per_row_and_column(five, keys):
    safe = M.protect(five, P.ProtectionPolicy.of("cpf", "pan"), keys, pin=True)
    joined = safe.alias("a").join(safe.select(F.col("cpf").alias("k")), F.col("cpf") == F.col("k"))
    optimized = joined._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("ArrowEvalPython") == 2  # one per side, though the join adds a filter


def test_masks_cannot_be_revealed(five, keys):
    for column, name in (("email", "mask-email"), ("nome", "mask-nome")):
        with pytest.raises(IrreversibleError):
            reveal(five, {column: name}, keys)


def test_short_master_secret_and_bad_tweak():
    with pytest.raises(ValueError):
        Keyring(b"short")
    with pytest.raises(ValueError):
        from veladura.functions.ff3 import Ff3

        Ff3(bytes(16), bytes(8))


def test_known_keys_can_be_fixed(apply):
    known = Keyring(bytes(16), {"ff-cnh": (bytes.fromhex("2DE79D232DF5585D68CE47882AE256D6"), bytes(7))})
    derived = Keyring(bytes(16))
    value = "12345678901"
    a = apply(lambda c: M.protect_column(c, "ff-cnh", known), value)
    b = apply(lambda c: M.protect_column(c, "ff-cnh", derived), value)
    assert a != b


def test_search_by_encrypted_literal(spark, keys, tmp_path):
    people = sample_customers(spark, 300)
    safe = M.protect(people, P.customer_policy, keys, role="core-role")
    stored = safe.withColumnRenamed("cpf", "cpf_protected")
    stored.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    cpf = people.filter("id = 77").first().cpf
    found = find_by_cpf(stored, f"{cpf[:3]}.{cpf[3:6]}.{cpf[6:9]}-{cpf[9:]}", keys)
    assert [r.id for r in found.collect()] == [77]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(cpf_protected,{encrypted_literal(cpf, 'ff-cpf', keys)})" in plan
    assert cpf not in plan
    wanted = people.filter("id % 50 = 0").select("cpf")
    assert {r.id for r in find_many(stored, wanted, keys).collect()} == {50, 100, 150, 200, 250, 300}
    for wrong in ("123", "1234567890A", ""):
        with pytest.raises(ValueError):
            find_by_cpf(stored, wrong, keys)


def test_unknown_token(spark, keys, texts):
    values = texts("a", "b", "a", "", None)
    columns = {"v": "tok-conta"}
    tokens = build_token_map(values, columns, keys)
    assert tokens.count() == 2
    assert token_collisions(values, columns, keys).isEmpty()
    safe = M.protect(values, P.ProtectionPolicy(columns), keys)
    back = detokenize(safe, columns, tokens, keys).orderBy("id")
    assert [r.v for r in back.collect()] == ["a", "b", "a", "", None]
    stray = safe.withColumn("v", F.when(F.col("id") == 1, F.lit("TKN-x")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="not in the token map"):
        detokenize(stray, columns, tokens, keys).collect()
    shown = detokenize(stray, columns, tokens, keys, on_error="null").orderBy("id").collect()
    assert [r.v for r in shown] == ["a", None, "a", "", None]
    with pytest.raises(ValueError):
        build_token_map(values, {"v": "ff-cpf"}, keys)


def test_mixed_values(spark, keys):
    rows = [
        ("ff-cpf", "123.456.789-09"), ("mask-cvv", "123"), ("tok-raca", "grupo três"),
        ("ff-rg", "123456789"), ("no-such", "x"), ("ff-cpf", None),
    ]
    given = spark.createDataFrame(rows, "transformation string, value string")
    coded = M.encode_values(given, keys, on_error="sentinel").collect()
    by = {(r.transformation, r.value): r for r in coded}
    assert by["mask-cvv", "123"].encoded_value == "***" and not by["mask-cvv", "123"].reversible
    assert by["ff-rg", "123456789"].encoded_value == "ERROR"  # not granted to this role
    assert by["no-such", "x"].encoded_value == "ERROR"
    assert by["ff-cpf", None].encoded_value is None
    cpf = by["ff-cpf", "123.456.789-09"]
    assert cpf.original_length == 14 and cpf.reversible and cpf.encoded_value[3] == "."
    tokens = build_token_map(given.filter("value = 'grupo três'"), {"value": "tok-raca"}, keys)
    coded_frame = spark.createDataFrame(
        [("ff-cpf", cpf.encoded_value), ("tok-raca", by["tok-raca", "grupo três"].encoded_value)],
        given.schema,
    )
    back = {r.transformation: r.decoded_value for r in decode_values(coded_frame, keys, tokens).collect()}
    assert back == {"ff-cpf": "123.456.789-09", "tok-raca": "grupo três"}
    with pytest.raises(P.GrantError):
        decode_values(coded_frame, keys, tokens, role="api-role")


def test_leaks_and_formats_are_found(spark, keys):
    rows = [(1, "12345678909", "98765432100"), (2, "98765432100", "xx12345678909"), (3, "11122233344", "555")]
    df = spark.createDataFrame(rows, "id int, raw string, out string")
    assert leak_report(df, ["raw"], ["out"]).first().n_leaks == 0
    assert [r.value for r in leaked_values(df, ["raw"], ["out"]).collect()] == ["98765432100"]
    same = df.withColumn("out", F.col("raw"))
    assert leak_report(same, ["raw"], ["out"]).first().n_leaks == 3
    assert format_report(df, {"raw": ("out", "ff-cpf")}).first().n_bad_format == 2


def test_all_unicode_white_space_is_blank(texts):
    blanks = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    df = texts(*blanks, "".join(blanks), "​", " x ")
    got = [r.ok for r in df.select("id", M.has_value(F.col("v")).alias("ok")).orderBy("id").collect()]
    assert got == [False] * (len(blanks) + 1) + [True, True]
