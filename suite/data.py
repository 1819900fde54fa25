"""Inputs of the registered queries, derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veladura import policy as P
from veladura.keys import Keyring
from veladura.operators.protect import protect
from veladura.operators.token_map import build_token_map
from veladura.operators.views import stored_names
from veladura.plans.create import stored_projection
from veladura.plans.retrofit import protect_in_place, protect_rows
from veladura.session import fresh_path
from veladura.sources.layout import write_for_lookups
from veladura.sources.synthetic import customer_cpf, customers
from veladura.sources.tables import (
    staging_rows,
    write_clustered,
    write_parquet,
    write_token_map,
)

DEMO_SECRET = b"demonstration secret, never for real data"
DEMO_KEYS = Keyring(DEMO_SECRET)
TOKEN_FIELDS = {f: P.FIELD_TRANSFORMATIONS[f] for f in ("endereco", "conta", "saude", "raca", "religiao")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fictitious customer per row of the customer table."""
    return customers(table(spark, sf_dir, "customer"), "c_custkey")


def written_as_people_do(df: DataFrame) -> DataFrame:
    """The same customers with separators, gaps and mistakes in their data."""
    spaced = "regexp_replace(pan, '^(....)(....)(....)(....)$', '$1 $2 $3 $4')"
    return df.withColumns(
        {
            name: F.expr(rule)
            for name, rule in {
                "nome": "CASE WHEN id % 43 = 2 THEN NULL WHEN id % 47 = 6 THEN 'Érica  d\\'Ávila E' "
                "WHEN id % 47 = 7 THEN 'JOÃO' ELSE nome END",
                "cpf": "CASE WHEN id % 17 = 3 THEN '123' WHEN id % 19 = 5 THEN left(cpf, 10) || 'A' "
                "WHEN id % 23 = 7 THEN cpf || '0' WHEN id % 5 = 1 THEN "
                "regexp_replace(cpf, '^(...)(...)(...)(..)$', '$1.$2.$3-$4') ELSE cpf END",
                "email": "CASE WHEN id % 29 = 11 THEN translate(email, '@', '#') "
                "WHEN id % 41 = 9 THEN NULL ELSE email END",
                "telefone": "CASE WHEN id % 2 = 0 THEN "
                "regexp_replace(telefone, '^(..)(.....)(....)$', '($1) $2-$3') ELSE telefone END",
                "pan": f"CASE WHEN id % 37 = 4 THEN '12345' WHEN id % 3 = 1 THEN {spaced} "
                f"WHEN id % 3 = 2 THEN translate({spaced}, ' ', '-') "
                "WHEN id % 10 = 3 THEN left(pan, 13) ELSE pan END",
                "cvv": "CASE WHEN id % 2 = 1 THEN lpad(CAST(id % 10000 AS STRING), 4, '0') "
                "ELSE cvv END",
                "dob": "CASE WHEN id % 31 = 13 THEN '1985-03-15' ELSE dob END",
            }.items()
        }
    )


def rough_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_as_people_do(people(spark, sf_dir))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the CPF of their buyer, as another department would hold them."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        customer_cpf("o_custkey").alias("cpf"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
    )


def created_at(k: Column) -> Column:
    """A time that follows from the id; several customers share each."""
    return F.timestamp_seconds(F.lit(1577836800) + k * 7919 % 5000 * 60)


def to_store(raw: DataFrame) -> DataFrame:
    """Customers protected and named as in the stored table, times included."""
    protected = stored_names(protect(raw, P.keep_name_policy, DEMO_KEYS, role="core-role"))
    stamped = protected.withColumn("created_at", created_at(F.col("id")))
    return stored_projection(stamped.withColumn("updated_at", F.col("created_at")))


_written: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf_dir: str, label: str, write: Callable[[str], None]) -> DataFrame:
    """A table that several queries read: written on first use, then read."""
    key = (spark.conf.get("spark.app.id"), sf_dir, label)
    if key not in _written:
        path = fresh_path(spark, label)
        write(path)
        _written[key] = path
    return spark.read.parquet(_written[key])


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table of protected customers, clustered by encrypted CPF."""
    return _once(
        spark, sf_dir, "stored", lambda path: write_clustered(to_store(people(spark, sf_dir)), path)
    )


def stored_for_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table laid out for searches by encrypted CPF, id and time."""
    held, by = stored(spark, sf_dir), ("cpf_protected", "id", "created_at")
    return _once(
        spark, sf_dir, "laid-out", lambda path: write_for_lookups(held, path, by, exact=by[:2], files=8)
    )


def stored_token_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(
        spark,
        sf_dir,
        "token-map",
        lambda path: write_token_map(
            build_token_map(people(spark, sf_dir), TOKEN_FIELDS, DEMO_KEYS), path
        ),
    )


def rough_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rough customers as a table of their own, as a job would find them."""
    return _once(
        spark, sf_dir, "rough", lambda path: write_parquet(rough_people(spark, sf_dir), path)
    )


def staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table to retrofit; the rows of one category were protected earlier."""
    rows = staging_rows(people(spark, sf_dir)).withColumn("created_at", created_at(F.col("id")))
    earlier = F.col("raca_raw") == "grupo três"
    return rows.filter(~earlier).unionByName(protect_rows(rows.filter(earlier), DEMO_KEYS))


def stored_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(
        spark, sf_dir, "staging", lambda path: write_parquet(staging(spark, sf_dir), path)
    )


def retrofitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(
        spark,
        sf_dir,
        "retrofitted",
        lambda path: write_parquet(
            protect_in_place(stored_staging(spark, sf_dir), DEMO_KEYS), path
        ),
    )
