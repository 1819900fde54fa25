"""Protecting a table that already exists, without changing the application's schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veladura import policy as P
from veladura.keys import Keyring
from veladura.operators.lookup import unprotected
from veladura.operators.protect import RAISE, named, protect, protect_column
from veladura.operators.validate import duplicate_keys
from veladura.operators.verify import Pairs, format_report, round_trip_report
from veladura.policy import FIELD_TRANSFORMATIONS, RETROFIT_FIELDS, STORED_NAMES
from veladura.session import kept
from veladura.sources.versions import Version, VersionedTable

RAW_TO_PROTECTED = {f"{f}_raw": STORED_NAMES[f] for f in RETROFIT_FIELDS}
PAIRS: Pairs = {
    f"{f}_raw": (STORED_NAMES[f], FIELD_TRANSFORMATIONS[f]) for f in RETROFIT_FIELDS
}


def protect_rows(
    staging: DataFrame, keyring: Keyring, role: str = "api-role", on_error: str = RAISE
) -> DataFrame:
    """The rows not protected yet, with their protected columns filled in."""
    filled = protect(
        unprotected(staging), P.retrofit_policy, keyring, role, on_error, RAW_TO_PROTECTED
    )
    return filled.withColumn("protected", F.lit(True))


def protect_in_place(
    staging: DataFrame, keyring: Keyring, role: str = "api-role", on_error: str = RAISE
) -> DataFrame:
    """The whole table after protection: one narrow pass over one scan, no shuffle.

    Rows protected earlier are taken over as they are, so running it again changes
    nothing.  The cipher gets null for them, which costs nothing.
    """
    columns = P.retrofit_policy.resolve(staging.columns)
    P.check_grants(role, "encode", sorted(set(columns.values())))
    done = F.coalesce(F.col("protected"), F.lit(False))
    filled = {
        RAW_TO_PROTECTED[c]: F.when(done, named(RAW_TO_PROTECTED[c])).otherwise(
            protect_column(F.when(~done, named(c)), name, keyring, on_error)
        )
        for c, name in columns.items()
    }
    return staging.withColumns(filled | {"protected": F.lit(True)})


def write_version(table: DataFrame, path: str) -> None:
    """Write the table as a new version; readers keep the old one until it is committed.

    Plain files cannot be changed in place.  The new version goes to its own path,
    which must not exist, and the caller points its view or table there afterwards.
    """
    table.write.mode("errorifexists").parquet(path)


def retrofit(
    staging: DataFrame, path: str, keyring: Keyring, role: str = "api-role", on_error: str = RAISE
) -> DataFrame:
    write_version(protect_in_place(staging, keyring, role, on_error), path)
    return staging.sparkSession.read.parquet(path)


def retrofit_files(
    table: VersionedTable, keyring: Keyring, role: str = "api-role", on_error: str = RAISE
) -> Version:
    """Protect what is not protected yet; files without such rows stay as they are.

    One column is read to find those files.  Where nothing is to be done no version is made.
    """
    version = table.version()
    files = table.files_with(version, lambda rows: unprotected(rows.select("protected", "_file")))
    return table.rewrite(version, files, lambda rows: protect_in_place(rows, keyring, role, on_error))


def apply_updates(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Replace the rows of ``table`` whose key is in ``changes``.

    Changed rows get a new ``updated_at``.  Changes for keys that the table does not have
    are left out: this updates and never inserts.  Two changes for one key are refused.
    The result is the whole table; ``VersionedTable.update`` rewrites hit files only.
    """
    changes = kept(changes, "changes")  # its plan may hold a cipher, and it is needed three times
    if not duplicate_keys(changes, key).isEmpty():
        raise ValueError(f"several changes for the same {key}")
    others = table.join(changes.select(key), key, "left_anti")
    stamped = changes.join(table.select(key), key, "left_semi")
    if "updated_at" in table.columns:
        stamped = stamped.withColumn("updated_at", F.current_timestamp())
    return others.unionByName(stamped.select(*table.columns))


def verified(table: DataFrame, keyring: Keyring, token_map: DataFrame) -> bool:
    """Do all protected values decode to the raw ones and have the right shape?"""
    reversible = {r: p for r, p in PAIRS.items() if P.transformation(p[1]).reversible}
    trips = round_trip_report(table, reversible, keyring, token_map)
    shapes = format_report(table, PAIRS)
    wrong = trips.agg(F.sum("n_mismatch")).first()[0] + shapes.agg(F.sum("n_bad_format")).first()[0]
    return wrong == 0 and unprotected(table).isEmpty()


def drop_raw(table: DataFrame, keyring: Keyring, token_map: DataFrame) -> DataFrame:
    """The table without its raw columns; refused until the protected ones check out."""
    if not verified(table, keyring, token_map):
        raise ValueError("raw columns stay: some protected values do not check out")
    return table.drop(*RAW_TO_PROTECTED)


def clear_raw(table: DataFrame, keyring: Keyring, token_map: DataFrame) -> DataFrame:
    """Like ``drop_raw``, but keeps the columns and empties them."""
    if not verified(table, keyring, token_map):
        raise ValueError("raw columns stay: some protected values do not check out")
    return table.withColumns({c: F.lit(None).cast("string") for c in RAW_TO_PROTECTED})
