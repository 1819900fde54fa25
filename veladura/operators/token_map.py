"""The token map: what makes convergent tokens reversible."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veladura import policy as P
from veladura.functions import tokens
from veladura.keys import Keyring
from veladura.operators.protect import RAISE, failure, has_value, named
from veladura.operators.skew import lookup_join
from veladura.session import kept

FEW_TOKENS = 1000  # that many may stand in a filter


def _by_transformation(names: Iterable[str], build: Callable[[str], Column]) -> Column:
    """CASE over the transformation column, one branch per name."""
    chosen = F.when(F.lit(False), F.lit(None))
    for name in names:
        chosen = chosen.when(F.col("transformation") == name, build(name))
    return chosen


def _distinct_values(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """``(transformation, value)`` of all given columns; repeats go before the shuffle."""
    for name in columns.values():
        if P.transformation(name).kind != P.TOKENIZATION:
            raise ValueError(f"{name} makes no tokens")
    entries = [
        F.struct(F.lit(name).alias("transformation"), named(c).alias("value"))
        for c, name in columns.items()
    ]
    return df.select(F.inline(F.array(*entries))).filter(has_value(F.col("value"))).distinct()


def build_token_map(df: DataFrame, columns: Mapping[str, str], keyring: Keyring) -> DataFrame:
    """``(transformation, token, value_enc)``, one row per distinct value.

    ``columns`` maps raw columns to token transformations.  Values are made
    distinct first, so each is hashed and encrypted once however often it occurs.
    """
    names, value = sorted(set(columns.values())), F.col("value")
    return _distinct_values(df, columns).select(
        "transformation",
        _by_transformation(names, lambda n: tokens.token(value, n, keyring)).alias("token"),
        _by_transformation(names, lambda n: tokens.seal(value, n, keyring)).alias("value_enc"),
    )


def new_entries(candidate: DataFrame, stored: DataFrame) -> DataFrame:
    """The entries to append: those whose token the stored map does not have yet."""
    key = ["transformation", "token"]
    return candidate.join(stored.select(*key), key, "left_anti")


def token_collisions(df: DataFrame, columns: Mapping[str, str], keyring: Keyring) -> DataFrame:
    """Tokens that stand for more than one value; must be empty."""
    names, value = sorted(set(columns.values())), F.col("value")
    token = _by_transformation(names, lambda n: tokens.token(value, n, keyring))
    return (
        _distinct_values(df, columns)
        .groupBy("transformation", token.alias("token"))
        .agg(F.count(F.lit(1)).alias("n_values"))
        .filter("n_values > 1")
    )


def _open(entries: DataFrame, names: Iterable[str], keyring: Keyring) -> DataFrame:
    """Entries of the named transformations, decrypted, each once however often it is sought."""
    opened = F.when(F.lit(False), F.lit(None))
    for name in names:
        value = tokens.unseal(F.col("value_enc"), name, keyring)
        opened = opened.when(F.col("transformation") == name, value)
    return entries.filter(F.col("transformation").isin(list(names))).select(
        F.col("token").alias("_token"), F.col("transformation").alias("_name"), opened.alias("_value")
    )


def _original(c: Column, name: str, on_error: str) -> Column:
    missing = failure(on_error, f"a token of {name} is not in the token map")
    known = F.when(F.col("_name") == name, F.col("_value"))
    return F.when(~has_value(c), c).otherwise(F.coalesce(known, missing))


def only_tokens_of(df: DataFrame, columns: Iterable[str], token_map: DataFrame) -> DataFrame:
    """The entries that a few rows need, by a filter that reaches the scan of the map.

    For a customer or a handful.  More than ``FEW_TOKENS`` tokens are refused: then the
    whole map is the right input.
    """
    held = df.select(F.explode(F.array(*[named(c) for c in columns])).alias("token"))
    rows = held.filter(F.col("token").isNotNull()).take(FEW_TOKENS + 1)
    if len(rows) > FEW_TOKENS:
        raise ValueError(f"more than {FEW_TOKENS} tokens: pass the whole token map")
    return token_map.filter(F.col("token").isin(sorted({r.token for r in rows})))


def detokenize(
    df: DataFrame,
    columns: Mapping[str, str],
    token_map: DataFrame,
    keyring: Keyring,
    role: str = "core-role",
    on_error: str = RAISE,
    hint: str | None = None,
) -> DataFrame:
    """Replace tokens by the values they stand for; null and blank stay.

    One join per column, whatever the sizes: the input is read once and the plan grows
    with the number of columns.  A token that the stored map does not have is an error
    of that row.
    """
    P.check_grants(role, "decode", sorted(set(columns.values())))
    order = [named(c) for c in df.columns]
    for c, name in columns.items():
        keyed = df.withColumn("_token", F.when(has_value(named(c)), named(c)))
        found = lookup_join(keyed, _open(token_map, [name], keyring), "_token", hint)
        df = found.withColumn(c, _original(named(c), name, on_error)).select(*order)
    return df


def detokenize_by_address(
    df: DataFrame,
    columns: Mapping[str, str],
    token_map: DataFrame,
    keyring: Keyring,
    role: str = "core-role",
    on_error: str = RAISE,
    hint: str | None = None,
) -> DataFrame:
    """Like ``detokenize``, for wide rows with several token columns and a map too large to broadcast.

    The rows are stored once.  What meets the map is narrow: where a row stands (file and
    place in it), which column, and the token; all columns together in one join.  The originals
    come back to their rows by address, so the wide rows are shuffled once, whatever the
    number of columns, and by a key that no two rows share.
    """
    P.check_grants(role, "decode", sorted(set(columns.values())))
    stored = kept(df, "token-rows")
    place = F.struct("_metadata.file_path", "_metadata.row_index")
    entries = [
        F.struct(F.lit(i).alias("i"), F.lit(name).alias("transformation"), named(c).alias("value"))
        for i, (c, name) in enumerate(columns.items())
    ]
    long = stored.select(place.alias("place"), F.inline(F.array(*entries))).filter(has_value(F.col("value")))
    opened = detokenize_mixed(long, "original", set(columns.values()), token_map, keyring, on_error, hint)
    found = opened.groupBy("place").agg(
        F.map_from_entries(F.collect_list(F.struct("i", "original"))).alias("originals")
    )
    rows = stored.select(F.struct(*[named(c) for c in df.columns]).alias("row"), place.alias("of"))
    met = rows.join(found, F.col("of") == F.col("place"), "left")

    def shown(i: int, c: str) -> Column:
        own = F.col("row")[c]
        return F.when(has_value(own), F.col("originals")[F.lit(i)]).otherwise(own)

    place_of = {c: i for i, c in enumerate(columns)}
    return met.select(
        *[(shown(place_of[c], c) if c in place_of else F.col("row")[c]).alias(c) for c in df.columns]
    )


def detokenize_mixed(
    df: DataFrame,
    target: str,
    names: Iterable[str],
    token_map: DataFrame,
    keyring: Keyring,
    on_error: str = RAISE,
    hint: str | None = None,
) -> DataFrame:
    """Add ``target`` with the originals of a ``(transformation, value)`` frame.

    One join whatever the number of transformations; rows of others get null.
    """
    names, order = list(names), [named(c) for c in df.columns]
    kind, value = F.col("transformation"), F.col("value")
    keyed = df.withColumn("_token", F.when(kind.isin(names) & has_value(value), value))
    found = lookup_join(keyed, _open(token_map, names, keyring), "_token", hint)
    original = _by_transformation(names, lambda n: _original(value, n, on_error))
    return found.select(*order, original.alias(target))
