"""Who did what to which data, without the data."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veladura import policy as P
from veladura.keys import Keyring
from veladura.operators.protect import RAISE, has_value, named, protection_report
from veladura.operators.reveal import STORED_REVERSIBLE, reveal_customers
from veladura.operators.sealed_trail import SealedTrail

ENTRIES_PER_TASK = 500_000


def reveal_trail(
    revealed: DataFrame,
    columns: Iterable[str],
    actor: str,
    role: str,
    operation: str = "decode",
    key: str = "id",
    at: Column | None = None,
) -> DataFrame:
    """One row per revealed value: actor, role, operation, column, key, time."""
    entries = [
        F.when(
            named(c).isNotNull(),
            F.struct(F.lit(c).alias("column"), named(key).alias("key")),
        )
        for c in columns
    ]
    rows = revealed.select(F.explode(F.array_compact(F.array(*entries))).alias("entry"))
    return rows.select(
        F.lit(actor).alias("actor"),
        F.lit(role).alias("role"),
        F.lit(operation).alias("operation"),
        "entry.*",
        (F.current_timestamp() if at is None else at).alias("at"),
    )


def append_trail(trail: DataFrame, where: str | SealedTrail) -> None:
    """Add entries to plain files at a path, or to a trail that shows tampering."""
    if isinstance(where, SealedTrail):
        where.append(trail)
    else:
        trail.write.mode("append").parquet(where)


def reveal_logged(
    protected: DataFrame,
    keyring: Keyring,
    token_map: DataFrame,
    actor: str,
    trail: str | SealedTrail,
    role: str = "core-role",
    on_error: str = RAISE,
    few: bool = False,
) -> DataFrame:
    """``reveal_customers`` that first writes down whose values are about to be shown.

    The entries follow from the protected columns, so nothing is decoded for them: that
    costs a narrow pass without any cipher or join.  A reveal that is refused leaves no
    entry; one that is never read does, as it could have been.
    """
    shown = reveal_customers(protected, keyring, token_map, role, on_error, few)
    fields = {p: f for f, p in P.STORED_NAMES.items() if p in STORED_REVERSIBLE}
    cells = protected.select("id", *[named(p).alias(f) for p, f in fields.items()])
    append_trail(reveal_trail(cells, fields.values(), actor, role), trail)
    return shown


def trail_summary(trail: DataFrame) -> DataFrame:
    """Entries, and rows they are about, per actor, role, operation and column.

    Entries hardly repeat, so counting distinct keys holds nearly all of them.  They are
    counted first and dealt by key to so many tasks that none holds more than about
    ``ENTRIES_PER_TASK``; entries without a key, which count for no row, go anywhere.
    """
    by = ["actor", "role", "operation", "column"]
    tasks = trail.count() // ENTRIES_PER_TASK + 1
    anywhere = F.when(named("key").isNull(), F.monotonically_increasing_id() % 1024).alias("_anywhere")
    dealt = trail.select(*by, "key", anywhere).repartition(tasks, *by, "key", "_anywhere")
    each = dealt.groupBy(*by, "key", "_anywhere").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(*by).agg(F.sum("n").alias("n_values"), F.count("key").alias("n_rows"))


def category_counts(protected: DataFrame, token: str) -> DataFrame:
    """Rows per category of a tokenised column: the histogram of the raw values."""
    return protected.groupBy(token).agg(F.count(F.lit(1)).alias("n_rows"))


def transformation_report(
    df: DataFrame, policy: P.ProtectionPolicy, seconds: float | None = None
) -> DataFrame:
    """Values per transformation.  One job does them all, so time is of the whole run."""
    rows = protection_report(df, policy)
    return rows.groupBy("transformation", "kind").agg(
        F.sum("n_values").alias("n_values"),
        F.sum("n_errors").alias("n_errors"),
        F.lit(seconds).cast("double").alias("total_seconds"),
    )


def legal_coverage(df: DataFrame) -> DataFrame:
    """Per personal-data column of a frame: its operation, legal article and values held."""
    policy = P.ProtectionPolicy(P.FIELD_TRANSFORMATIONS)
    columns = policy.resolve(df.columns)
    counts = df.agg(*[F.count_if(has_value(named(c))).alias(c) for c in columns])
    entries = [
        F.struct(F.lit(c.lower()).alias("field"), named(c).alias("n_values")) for c in columns
    ]
    held = counts.select(F.inline(F.array(*entries)))
    return held.join(F.broadcast(P.policy_frame(df.sparkSession)), "field").select(
        "field", "transformation", "kind", "reversible", "legal_article", "n_values"
    )


def grant_matrix(df: DataFrame) -> DataFrame:
    """Roles against the columns of a frame: how many values each may encode and decode.

    One row per field; both sides are as small as the policy.
    """
    coverage = legal_coverage(df).select("field", "transformation", "n_values")
    grants = P.grants_frame(df.sparkSession)
    roles = list(P.ENCODE_GRANTS)
    return (
        coverage.join(F.broadcast(grants), "transformation")
        .groupBy("field", "transformation", "n_values")
        .pivot("role", roles)
        .agg(
            F.first(
                F.when(F.col("can_decode"), "encode+decode")
                .when(F.col("can_encode"), "encode")
                .otherwise("-")
            )
        )
    )
