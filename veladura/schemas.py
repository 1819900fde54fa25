"""Schemas of raw, stored and staged customers."""

from __future__ import annotations

from pyspark.sql import types as T

from veladura.policy import RETROFIT_FIELDS, STORED_NAMES


def _text(*names: str, nullable: bool = True) -> list[T.StructField]:
    return [T.StructField(n, T.StringType(), nullable) for n in names]


RAW_FIELDS = (
    "nome", "cpf", "cnpj", "rg", "cnh", "email", "telefone", "pan", "cvv", "dob",
    "endereco", "conta", "saude", "raca", "religiao",
)
REQUIRED_FIELDS = ("nome", "cpf", "email", "telefone")

# Everything nullable: a missing required field is rejected with a reason, not lost.
RAW_CUSTOMER = T.StructType([T.StructField("id", T.LongType()), *_text(*RAW_FIELDS)])

# Columns of the stored customer table and their longest values.
STORED_LENGTHS = {
    "nome": 200,
    "cpf_protected": 11,
    "email_masked": 200,
    "telefone_protected": 11,
    "pan_protected": 16,
    "cvv_masked": 4,
    "dob_masked": 20,
    "endereco_token": 100,
    "conta_token": 100,
}
STORED_CUSTOMER = T.StructType(
    [
        T.StructField("id", T.LongType()),
        *_text(*STORED_LENGTHS),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

STAGING = T.StructType(
    [
        T.StructField("id", T.LongType()),
        *_text("nome"),
        *_text(*(f"{f}_raw" for f in RETROFIT_FIELDS)),
        *_text(*(STORED_NAMES[f] for f in RETROFIT_FIELDS)),
        T.StructField("protected", T.BooleanType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

# Longest values of the staging table.
STAGING_LENGTHS = {
    "nome": 200,
    "cpf_raw": 20,
    "email_raw": 200,
    "telefone_raw": 20,
    "pan_raw": 20,
    "dob_raw": 20,
    "endereco_raw": 200,
    "saude_raw": 200,
    "raca_raw": 100,
    "religiao_raw": 100,
    "cpf_protected": 11,
    "email_masked": 200,
    "telefone_protected": 11,
    "pan_protected": 16,
    "dob_masked": 20,
    "endereco_token": 100,
    "saude_token": 100,
    "raca_token": 100,
    "religiao_token": 100,
}


def all_text(*names: str) -> T.StructType:
    """An explicit schema for a text file: every column a string."""
    return T.StructType(_text(*names))
