"""Whole-table checks of protected data: round trip, convergence, leaks, formats.

Each report has one row per column.  All but the convergence and cross-row leak
checks are one pass with a single small aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veladura import policy as P
from veladura.functions import tokens
from veladura.keys import Keyring
from veladura.operators.protect import NULL, has_value, named, normalized
from veladura.operators.reveal import reveal_column
from veladura.operators.token_map import detokenize

# raw column -> (protected column, transformation)
Pairs = Mapping[str, tuple[str, str]]


def _report(df: DataFrame, checks: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """Count conditions: ``{column: {measure: condition}}`` to one row per column."""
    counts, entries = [], []
    for c, measures in checks.items():
        row = [F.lit(c).alias("column")]
        for measure, condition in measures.items():
            counts.append(F.count_if(condition).alias(f"{c}:{measure}"))
            row.append(named(f"{c}:{measure}").alias(measure))
        entries.append(F.struct(*row))
    return df.agg(*counts).select(F.inline(F.array(*entries)))


def round_trip_report(
    df: DataFrame,
    pairs: Pairs,
    keyring: Keyring,
    token_map: DataFrame | None = None,
    role: str = "core-role",
) -> DataFrame:
    """Decode every reversible protected column and compare it with the raw one."""
    P.check_grants(role, "decode", sorted({name for _, name in pairs.values()}))
    columns = {raw: protected for raw, (protected, _) in pairs.items()}
    work = df.select(
        *[named(raw).alias(f"{raw}:raw") for raw in columns],
        *[named(protected).alias(f"{raw}:back") for raw, protected in columns.items()],
    )
    checks, by_token = {}, {}
    for raw, (_, name) in pairs.items():
        if P.transformation(name).kind == P.FPE:
            back = reveal_column(named(f"{raw}:back"), name, keyring, NULL)
        else:
            by_token[f"{raw}:back"] = name
            back = named(f"{raw}:back")
        given = has_value(named(f"{raw}:raw"))
        same = back.eqNullSafe(normalized(named(f"{raw}:raw"), name))
        checks[raw] = {"n_values": given, "n_mismatch": given & ~same}
    if by_token:
        work = detokenize(work, by_token, token_map, keyring, role, NULL)
    return _report(work, checks)


def convergence_report(df: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """Same value, same output; different value, different output.

    ``pairs`` maps raw to protected columns.  Pairs are made distinct first, so a
    frequent value reaches the shuffle once per task.
    """
    entries = [
        F.struct(
            F.lit(raw).alias("column"),
            named(raw).alias("raw"),
            named(protected).alias("protected"),
        )
        for raw, protected in pairs.items()
    ]
    distinct = df.select(F.inline(F.array(*entries))).filter(has_value(F.col("raw"))).distinct()
    return (
        distinct.groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("n_pairs"),
            F.countDistinct("raw").alias("n_raw"),
            F.countDistinct("protected").alias("n_protected"),
        )
        .withColumn("deterministic", F.col("n_pairs") == F.col("n_raw"))
        .withColumn("injective", F.col("n_pairs") == F.col("n_protected"))
    )


def leak_report(df: DataFrame, raw: list[str], outputs: list[str]) -> DataFrame:
    """Per raw column: rows in which some output column contains the raw value."""
    checks = {}
    for c in raw:
        value = named(c)
        found = F.lit(False)
        for o in outputs:
            found = found | F.coalesce(named(o).contains(value), F.lit(False))
        checks[c] = {"n_values": has_value(value), "n_leaks": has_value(value) & found}
    return _report(df, checks)


def leaked_values(df: DataFrame, raw: list[str], outputs: list[str]) -> DataFrame:
    """Raw values that appear anywhere in the table as a whole output value."""

    def long_form(columns: list[str]) -> DataFrame:
        entries = [
            F.struct(F.lit(c).alias("column"), named(c).alias("value")) for c in columns
        ]
        return df.select(F.inline(F.array(*entries))).filter(has_value(F.col("value")))

    shown = long_form(outputs).select("value").distinct()
    return long_form(raw).distinct().join(shown, "value", "left_semi").select("column", "value")


def format_report(df: DataFrame, pairs: Pairs) -> DataFrame:
    """Does every protected value have the shape its transformation promises?"""
    checks = {}
    for raw, (protected, name) in pairs.items():
        before, after = named(raw), named(protected)
        digits = normalized(before, name)
        kind = P.transformation(name).kind
        if kind == P.FPE:
            good = after.rlike(r"^[0-9]+\z") & (F.length(after) == F.length(digits))
        elif kind == P.TOKENIZATION:
            good = after.rlike(tokens.PATTERN) & (after != before)
        else:
            good = F.length(after) == F.length(before)
            if name == "mask-dob":
                good = good & after.rlike(r"^\*\*/\*\*/[0-9]{4}\z")
                good = good & (F.right(after, F.lit(4)) == F.right(before, F.lit(4)))
            elif name == "mask-cvv":
                good = good & after.rlike(r"^\*+\z")
            else:
                good = good & after.contains("*")
        given = has_value(before)
        wrong = given & ~F.coalesce(good, F.lit(False))
        checks[raw] = {"n_values": given, "n_bad_format": wrong}
    return _report(df, checks)


def before_after_report(
    raw: DataFrame, protected: DataFrame, pairs: Mapping[str, str], key: str = "id"
) -> DataFrame:
    """Join the table before and after on its key: changed, unchanged, null and lost values.

    ``n_missing`` and ``n_added`` count whole rows that only one of the two has.
    """
    left = raw.select(
        key, F.lit(True).alias(":had"), *[named(c).alias(f"{c}:before") for c in pairs]
    )
    right = protected.select(
        key, F.lit(True).alias(":has"), *[named(p).alias(f"{c}:after") for c, p in pairs.items()]
    )
    missing, added = named(":has").isNull(), named(":had").isNull()
    stays = ~missing & ~added
    checks = {}
    for c in pairs:
        before, after = named(f"{c}:before"), named(f"{c}:after")
        both = before.isNotNull() & after.isNotNull()
        checks[c] = {
            "n_changed": both & (before != after),
            "n_unchanged": both & (before == after),
            "n_null": stays & before.isNull() & after.isNull(),
            "n_lost": stays & before.isNotNull() & after.isNull(),
            "n_missing": missing,
            "n_added": added,
        }
    return _report(left.join(right, key, "full"), checks)


def all_clear(report: DataFrame, measure: str) -> Column:
    """A scalar: does the measure count nothing in any row of a report?"""
    return report.agg((F.sum(measure) == 0).alias("clear")).scalar()
