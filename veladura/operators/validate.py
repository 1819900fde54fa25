"""Checks on incoming values and on stored tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veladura import policy as P
from veladura.operators.protect import fits, has_value, named
from veladura.operators.skew import own_key
from veladura.schemas import REQUIRED_FIELDS


def valid_cpf(c: Column) -> Column:
    """Eleven digits once dots and hyphens are gone."""
    return F.translate(c, ".-", "").rlike(r"^[0-9]{11}\z")


def valid_pan(c: Column) -> Column:
    """Absent, or thirteen to sixteen digits once spaces and hyphens are gone."""
    return c.isNull() | F.translate(c, " -", "").rlike(r"^[0-9]{13,16}\z")


def fits_template(c: Column, name: str) -> Column:
    """Does the value match the transformation's template?  Null for null."""
    return F.when(c.isNotNull(), fits(c, name))


def reversible(transformation: Column) -> Column:
    names = [n for n, t in P.TRANSFORMATIONS.items() if t.reversible]
    return transformation.isin(names)


def template_report(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Per column: values present, values that fit their template, values that do not."""
    counts, entries = [], []
    for c, name in columns.items():
        given = has_value(named(c))
        counts.append(F.count_if(given & fits(named(c), name)).alias(f"{c}:fit"))
        counts.append(F.count_if(given & ~fits(named(c), name)).alias(f"{c}:misfit"))
        entries.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(name).alias("transformation"),
                named(f"{c}:fit").alias("n_fit"),
                named(f"{c}:misfit").alias("n_misfit"),
            )
        )
    return df.agg(*counts).select(F.inline(F.array(*entries)))


def rejection(df: DataFrame) -> Column:
    """Why a raw customer cannot be accepted; null if it can."""
    reason = F.lit(None).cast("string")
    tests = [(f"missing {f}", named(f).isNull()) for f in REQUIRED_FIELDS if f in df.columns]
    tests.append(("invalid cpf", ~valid_cpf(F.col("cpf"))))
    if "pan" in df.columns:
        tests.append(("invalid pan", ~valid_pan(F.col("pan"))))
    for text, failed in reversed(tests):
        reason = F.when(failed, F.lit(text)).otherwise(reason)
    return reason


def with_rejection(df: DataFrame) -> DataFrame:
    return df.withColumn("rejected", rejection(df))


def duplicate_keys(df: DataFrame, key: str = "cpf_protected") -> DataFrame:
    """Keys that occur more than once; must be empty for a unique column."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def only_new(incoming: DataFrame, stored: DataFrame, key: str = "cpf_protected") -> DataFrame:
    """Incoming rows whose key is neither stored nor repeated (lowest first column wins).

    Rows without a key are no repeats of each other: all of them stay.  Repeats go
    first: the aggregation keeps one row per key and task before the shuffle, so a key
    that fills a third of the input crowds no task, and the join with the stored keys
    finds the rows already partitioned by key.
    """
    columns = [key, *[c for c in incoming.columns if c != key]]
    first = F.min(F.struct(*[named(c) for c in columns])).alias("first")
    kept = incoming.withColumn("_own", own_key(named(key).cast("string"))).groupBy("_own").agg(first)
    known = stored.select(own_key(named(key).cast("string")).alias("_own"))
    # a made-up key of one side must not meet one of the other
    fresh = kept.join(known.filter(~F.startswith("_own", F.lit("\0"))), "_own", "left_anti")
    return fresh.select("first.*").select(*[named(c) for c in incoming.columns])


def length_report(df: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """Per limited column: the longest value and how many are too long."""
    present = {c: n for c, n in limits.items() if c in df.columns}
    counts, entries = [], []
    for c, limit in present.items():
        size = F.length(named(c))
        counts.append(F.max(size).alias(f"{c}:longest"))
        counts.append(F.count_if(size > limit).alias(f"{c}:over"))
        entries.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(limit).alias("max_length"),
                named(f"{c}:longest").alias("longest"),
                named(f"{c}:over").alias("n_too_long"),
            )
        )
    return df.agg(*counts).select(F.inline(F.array(*entries)))


def missing_report(df: DataFrame, fields: Iterable[str] = REQUIRED_FIELDS) -> DataFrame:
    """Per required field: rows where it is missing."""
    fields = [f for f in fields if f in df.columns]
    counts = [F.count_if(named(f).isNull()).alias(f) for f in fields]
    entries = [F.struct(F.lit(f).alias("column"), named(f).alias("n_missing")) for f in fields]
    return df.agg(*counts).select(F.inline(F.array(*entries)))
