"""Taking customers in: validate, protect, rename, store, display."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veladura import policy as P
from veladura.keys import Keyring
from veladura.operators.protect import RAISE, named, protect
from veladura.operators.validate import only_new, with_rejection
from veladura.operators.views import display, stored_names
from veladura.schemas import STORED_CUSTOMER
from veladura.sources.tables import append_rows, prepare_append, read_table


@dataclass(frozen=True)
class Intake:
    accepted: DataFrame  # protected, under stored names
    rejected: DataFrame  # key and reason only: raw data is not kept


def take_in(
    raw: DataFrame,
    keyring: Keyring,
    policy: P.ProtectionPolicy = P.keep_name_policy,
    role: str = "api-role",
    on_error: str = RAISE,
) -> Intake:
    """Split raw customers into protected ones and rejections.  Works on streams too."""
    checked = with_rejection(raw)
    good = checked.filter(F.col("rejected").isNull()).drop("rejected")
    bad = checked.filter(F.col("rejected").isNotNull()).select(
        "id", F.col("rejected").alias("reason")
    )
    return Intake(stored_names(protect(good, policy, keyring, role, on_error)), bad)


def create_customers(
    raw: DataFrame,
    stored_path: str,
    keyring: Keyring,
    policy: P.ProtectionPolicy = P.keep_name_policy,
    role: str = "api-role",
    on_error: str = RAISE,
) -> DataFrame:
    """Append the customers that are valid and not stored yet; show the whole table.

    Their own ids are replaced by new ones that follow the highest stored id.
    """
    spark = raw.sparkSession
    stored = read_table(spark, stored_path)
    accepted = take_in(raw, keyring, policy, role, on_error).accepted
    append_rows(prepare_append(stored, only_new(accepted, stored)), stored_path)
    return display(read_table(spark, stored_path))


def stored_projection(df: DataFrame, *extra: str) -> DataFrame:
    """The columns of the stored customer table that a frame has, in their order."""
    wanted = [f.name for f in STORED_CUSTOMER if f.name in df.columns]
    return df.select(*[named(c) for c in (*wanted, *extra)])
