"""The functions for SQL users give what the column functions give."""

import pytest
from pyspark.sql import functions as F

from suite.data import rough_people
from veladura import policy as P
from veladura.functions import masks, text
from veladura.functions.sql import register_protect_functions, register_text_functions
from veladura.operators.protect import normalized, protect_column

FUNCTIONS = {
    "normalize_cpf": (text.normalize_cpf, "cpf"),
    "normalize_cnpj": (text.normalize_cnpj, "cnpj"),
    "normalize_pan": (text.normalize_pan, "pan"),
    "normalize_phone_marks": (text.normalize_phone_marks, "telefone"),
    "keep_digits": (text.keep_digits, "telefone"),
    "format_cpf": (text.format_cpf, "cpf"),
    "format_cnpj": (text.format_cnpj, "cnpj"),
    "group_pan": (text.group_pan, "pan"),
    "display_cpf": (text.display_cpf, "cpf"),
    "display_phone": (text.display_phone, "telefone"),
    "display_pan": (text.display_pan, "pan"),
    "mask_all": (masks.mask_all, "cvv"),
    "mask_dob": (masks.mask_dob, "dob"),
    "mask_name": (masks.mask_name, "nome"),
}


@pytest.fixture(scope="module")
def rough(spark, sf_dir, keys):
    assert set(register_text_functions(spark)) == {*FUNCTIONS, "mask_email"}
    register_protect_functions(spark, keys, "core-role")
    return rough_people(spark, sf_dir).cache()


def test_text_functions(rough):
    pairs = [
        F.expr(f"{name}({column})").eqNullSafe(function(F.col(column))).alias(name)
        for name, (function, column) in FUNCTIONS.items()
    ]
    wrong = rough.select(*pairs).agg(*[F.count_if(~F.col(n)).alias(n) for n in FUNCTIONS]).first()
    assert not {n: wrong[n] for n in FUNCTIONS if wrong[n]}


@pytest.mark.parametrize("field", sorted(P.FIELD_TRANSFORMATIONS))
def test_protect_functions(rough, keys, field):
    name = P.FIELD_TRANSFORMATIONS[field]
    given = rough.filter(F.trim(field) != "")
    in_sql = F.expr(f"encode_{name.replace('-', '_')}(plain)")
    both = given.select(
        normalized(F.col(field), name).alias("plain"),
        protect_column(F.col(field), name, keys, "null").alias("ours"),
    ).withColumn("theirs", in_sql)
    assert both.filter(~F.col("ours").eqNullSafe(F.col("theirs"))).isEmpty()
    assert not both.isEmpty()


def test_only_granted_functions_are_made(spark, keys):
    made = register_protect_functions(spark, keys, role="support-role")
    assert made == ["encode_mask_email", "encode_mask_nome", "encode_mask_dob", "encode_mask_cvv"]


def test_keys_are_not_to_be_read(spark, keys):
    """No view, and no text of a function, from which a key could be read."""
    register_text_functions(spark)
    register_protect_functions(spark, keys, "core-role")
    views = [t.name for t in spark.catalog.listTables() if "veladura_keys" in t.name]
    assert views == []
    secrets = [p.hex() for n in ("tok-raca", "tok-conta") for p in (*keys.token_pads(n), keys.store(n))]
    for f in spark.catalog.listFunctions():
        if f.name.startswith(("encode_", "decode_", "_encode_", "_decode_")):
            told = spark.sql(f"DESCRIBE FUNCTION EXTENDED {f.name}").collect()
            text = " ".join(r[0] for r in told).lower()
            assert not any(s in text for s in secrets) and "veladura_keys" not in text
    with __import__("pytest").raises(TypeError):
        register_protect_functions(spark, keys)
