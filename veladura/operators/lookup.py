"""Point lookups, searches on encrypted keys, and short listings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veladura import policy as P
from veladura.functions.ff3 import Ff3
from veladura.keys import Keyring
from veladura.operators.protect import RAISE, named, protect_column


def by_id(df: DataFrame, key: int) -> DataFrame:
    return df.filter(F.col("id") == F.lit(key))


def encrypted_literal(digits: str, name: str, keyring: Keyring) -> str:
    """One search value, encoded on the driver so that it is a constant of the plan."""
    cipher = Ff3(*keyring.fpe(name))
    coded = cipher.run(np.array([int(digits)]), np.array([len(digits)]), decode=False)
    return str(coded[0]).zfill(len(digits))


def find_by_cpf(
    stored: DataFrame, cpf: str, keyring: Keyring, role: str = "api-role"
) -> DataFrame:
    """Search the stored table for a CPF, given formatted or plain.

    The search value is encrypted, not the column decrypted: the comparison is a
    plain equality that reaches the scan's statistics and bloom filters.
    """
    P.check_grants(role, "encode", ["ff-cpf"])
    digits = cpf.translate(str.maketrans("", "", "./-"))
    if not (len(digits) == 11 and digits.isascii() and digits.isdigit()):
        raise ValueError("a CPF has eleven digits")
    return stored.filter(F.col("cpf_protected") == encrypted_literal(digits, "ff-cpf", keyring))


def find_many(
    stored: DataFrame,
    searched: DataFrame,
    keyring: Keyring,
    role: str = "api-role",
    raw: str = "cpf",
    protected: str = "cpf_protected",
    name: str = "ff-cpf",
    on_error: str = RAISE,
) -> DataFrame:
    """Stored rows whose key is among the searched raw values.

    The list is protected and made distinct; Spark broadcasts it if it proves small.
    """
    P.check_grants(role, "encode", [name])
    wanted = searched.select(
        protect_column(named(raw), name, keyring, on_error, pin=True).alias(protected)
    ).distinct()
    return stored.join(wanted, protected, "left_semi")


def unprotected(staging: DataFrame) -> DataFrame:
    return staging.filter(~F.coalesce(F.col("protected"), F.lit(False)))


def already_protected(staging: DataFrame) -> DataFrame:
    return staging.filter(F.col("protected"))


def newest(df: DataFrame, limit: int = 20) -> DataFrame:
    """Newest rows first; equal times by id; rows without a time last.

    The first pass reads two narrow columns to find the oldest time that can still
    be listed.  With that time as a filter, the second reads only the row groups
    that reach it, however many columns are shown.
    """
    time, order = F.col("created_at"), [F.col("created_at").desc_nulls_last(), F.col("id")]
    listed = df.select("created_at", "id").orderBy(*order).limit(limit)
    oldest = listed.agg(F.min("created_at")).scalar()
    return df.filter((time >= oldest) | time.isNull()).orderBy(*order).limit(limit)


def first_by_id(df: DataFrame, limit: int = 1) -> DataFrame:
    return df.orderBy("id").limit(limit)
