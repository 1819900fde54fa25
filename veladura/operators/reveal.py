"""Reveal protected columns: inverse FPE in the row, tokens through the token map."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veladura import policy as P
from veladura.functions import fpe, text
from veladura.keys import Keyring
from veladura.operators.protect import RAISE, failure, has_value, named, normalized
from veladura.operators.token_map import detokenize, detokenize_mixed, only_tokens_of


class IrreversibleError(ValueError):
    """The column is masked: there is nothing to bring back."""


def check_reversible(columns: Mapping[str, str]) -> None:
    masked = [c for c, name in columns.items() if not P.transformation(name).reversible]
    if masked:
        raise IrreversibleError(f"masked, cannot be revealed: {', '.join(masked)}")


def reveal_column(
    c: Column, name: str, keyring: Keyring, on_error: str = RAISE, keep_format: bool = False
) -> Column:
    """The digits behind an encrypted column; null and blank stay."""
    t = P.transformation(name)
    if t.kind != P.FPE:
        raise ValueError(f"{name} is not format-preserving encryption")
    decoded = fpe.fpe(normalized(c, name), name, keyring, decode=True)
    shown = fpe.like_original(decoded, c, name) if keep_format else decoded
    failed = failure(on_error, f"a value does not fit the template of {name}")
    return F.coalesce(shown, F.when(~has_value(c), c).otherwise(failed))


def reveal(
    df: DataFrame,
    columns: Mapping[str, str],
    keyring: Keyring,
    role: str = "core-role",
    token_map: DataFrame | None = None,
    on_error: str = RAISE,
) -> DataFrame:
    """Reveal ``columns`` (column -> transformation) in place.

    Masks and missing grants are refused while the plan is built.  Filter first:
    only the rows that remain are decoded.
    """
    check_reversible(columns)
    P.check_grants(role, "decode", sorted(set(columns.values())))
    encrypted = {c: n for c, n in columns.items() if P.transformation(n).kind == P.FPE}
    tokenized = {c: n for c, n in columns.items() if c not in encrypted}
    if encrypted:
        df = df.withColumns(
            {c: reveal_column(named(c), n, keyring, on_error) for c, n in encrypted.items()}
        )
    if tokenized:
        if token_map is None:
            raise ValueError(f"a token map is needed to reveal {', '.join(tokenized)}")
        df = detokenize(df, tokenized, token_map, keyring, role, on_error)
    return df


STORED_REVERSIBLE = {
    "cpf_protected": "ff-cpf",
    "telefone_protected": "ff-telefone",
    "pan_protected": "ff-pan",
    "endereco_token": "tok-endereco",
    "conta_token": "tok-conta",
}


def reveal_customers(
    protected: DataFrame,
    keyring: Keyring,
    token_map: DataFrame,
    role: str = "core-role",
    on_error: str = RAISE,
    few: bool = False,
) -> DataFrame:
    """Stored customers with their data revealed; the CPF formatted, mail still masked.

    ``few`` is for a customer or a handful: their tokens filter the scan of the map.
    """
    if few:
        by_token = [c for c in STORED_REVERSIBLE if c.endswith("_token")]
        token_map = only_tokens_of(protected, by_token, token_map)
    shown = reveal(protected, STORED_REVERSIBLE, keyring, role, token_map, on_error)
    return shown.select(
        "id",
        "nome",
        text.format_cpf(F.col("cpf_protected")).alias("cpf"),
        F.col("email_masked").alias("email"),
        F.col("telefone_protected").alias("telefone"),
        F.col("pan_protected").alias("pan"),
        F.col("endereco_token").alias("endereco"),
        F.col("conta_token").alias("conta"),
    )


def decode_values(
    df: DataFrame,
    keyring: Keyring,
    token_map: DataFrame,
    role: str = "core-role",
    on_error: str = RAISE,
) -> DataFrame:
    """Ad-hoc decode of a ``(transformation, value)`` frame, any mix of transformations."""
    kind, value = F.col("transformation"), F.col("value")
    allowed = [n for n in P.TRANSFORMATIONS if P.may(role, "decode", n)]
    if not allowed:
        raise P.GrantError(f"{role} may not decode")
    decoded = F.when(value.isNull(), F.lit(None).cast("string"))
    for name in (n for n in allowed if P.transformation(n).kind == P.FPE):
        mine = F.when(kind == name, value)
        shown = reveal_column(mine, name, keyring, on_error, keep_format=True)
        decoded = decoded.when(kind == name, shown)
    tokenized = [n for n in allowed if P.transformation(n).kind == P.TOKENIZATION]
    out = detokenize_mixed(df, "_original", tokenized, token_map, keyring, on_error)
    decoded = decoded.when(kind.isin(tokenized), F.col("_original"))
    refused = failure(on_error, f"{role} may not decode this transformation")
    return out.select(
        *[named(c) for c in df.columns], decoded.otherwise(refused).alias("decoded_value")
    )
