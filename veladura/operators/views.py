"""Projections that different readers get to see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veladura.functions import text
from veladura.policy import STORED_NAMES


def stored_names(df: DataFrame) -> DataFrame:
    """Rename protected columns to the names they are stored under."""
    return df.withColumnsRenamed({c: n for c, n in STORED_NAMES.items() if c in df.columns})


def support_view(stored: DataFrame) -> DataFrame:
    """What support sees: partial displays of values that are already protected."""
    return stored.select(
        "id",
        "nome",
        text.display_cpf(F.col("cpf_protected")).alias("cpf_display"),
        "email_masked",
        text.display_phone(F.col("telefone_protected")).alias("telefone_display"),
        text.display_pan(F.col("pan_protected")).alias("pan_display"),
        "dob_masked",
        "endereco_token",
        "created_at",
    )


def display(stored: DataFrame) -> DataFrame:
    """The record as an application shows it: the support view's columns."""
    return support_view(stored)


def _present(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit("sim")).otherwise(F.lit("não"))


def audit_view(stored: DataFrame) -> DataFrame:
    """What an auditor sees: which data is there, none of it."""
    return stored.select(
        "id",
        _present(F.col("cpf_protected")).alias("tem_cpf"),
        _present(F.col("pan_protected")).alias("tem_pan"),
        _present(F.col("endereco_token")).alias("tem_endereco"),
        _present(F.col("conta_token")).alias("tem_conta"),
        "created_at",
        "updated_at",
    )


def before_view(staging: DataFrame, limit: int) -> DataFrame:
    """First staged rows in clear, as they were before protection."""
    return (
        staging.select(
            "id",
            "nome",
            text.format_cpf(F.col("cpf_raw")).alias("cpf"),
            F.col("email_raw").alias("email"),
            F.col("telefone_raw").alias("telefone"),
            text.group_pan(F.col("pan_raw")).alias("pan"),
            F.col("dob_raw").alias("dob"),
            F.col("saude_raw").alias("saude"),
            F.col("raca_raw").alias("raca"),
            F.col("religiao_raw").alias("religiao"),
        )
        .orderBy("id")
        .limit(limit)
    )


def after_view(staging: DataFrame, limit: int) -> DataFrame:
    """The same rows as stored now; tokens shortened for display."""
    return (
        staging.select(
            "id",
            "nome",
            text.format_cpf(F.col("cpf_protected")).alias("cpf"),
            F.col("email_masked").alias("email"),
            text.group_pan(F.col("pan_protected")).alias("pan"),
            text.shorten(F.col("saude_token"), 24).alias("saude"),
            text.shorten(F.col("raca_token"), 20).alias("raca"),
            text.shorten(F.col("religiao_token"), 20).alias("religiao"),
        )
        .orderBy("id")
        .limit(limit)
    )


def columns_of(stored: DataFrame, *names: str, limit: int | None = None) -> DataFrame:
    """An ad-hoc projection; with a limit, of the rows with the lowest ids."""
    if limit is None:
        return stored.select(*names)
    return stored.orderBy("id").limit(limit).select(*names)
