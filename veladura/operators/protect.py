"""Protect columns: one narrow projection, whatever the number of columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from veladura import policy as P
from veladura.functions import fpe, masks, text, tokens
from veladura.keys import Keyring

RAISE, NULL, SENTINEL = "raise", "null", "sentinel"
SENTINEL_VALUE = "ERROR"
# The characters that Unicode calls white space, and the four separators
# U+001C to U+001F, which count as blank too.
WHITESPACE = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

NORMALIZERS: dict[str, Callable[[Column], Column]] = {
    "ff-cpf": text.normalize_cpf,
    "ff-cnpj": text.normalize_cnpj,
    "ff-rg": text.keep_digits,
    "ff-cnh": text.keep_digits,
    "ff-pan": text.normalize_pan,
    "ff-telefone": text.keep_digits,
}


def named(column: str) -> Column:
    return F.col(f"`{column}`")


def has_value(c: Column) -> Column:
    """Neither null nor blank: only such values are transformed."""
    return F.coalesce(F.ltrim(c, F.lit(WHITESPACE)) != "", F.lit(False))


def normalized(c: Column, name: str) -> Column:
    return NORMALIZERS.get(name, text.as_text)(c)


def fits(c: Column, name: str) -> Column:
    """Does the value, once normalised, match the transformation's template?"""
    template = P.transformation(name).template
    if template is None:
        return F.lit(True)
    return normalized(c, name).rlike(template)


def protectable(columns: Mapping[str, str]) -> Column:
    """Can every one of these values of a row be transformed?"""
    answer = F.lit(True)
    for c, name in columns.items():
        if P.transformation(name).template is not None:
            answer = answer & (~has_value(named(c)) | fits(named(c), name))
    return answer


def failure(on_error: str, what: str) -> Column:
    """What stands in for a value that cannot be transformed.  Never shows the value."""
    if on_error == RAISE:
        return F.raise_error(F.lit(what)).cast("string")
    if on_error == NULL:
        return F.lit(None).cast("string")
    if on_error == SENTINEL:
        return F.lit(SENTINEL_VALUE)
    raise ValueError(f"on_error must be raise, null or sentinel, not '{on_error}'")


def protect_column(
    c: Column,
    name: str,
    keyring: Keyring,
    on_error: str = RAISE,
    keep_format: bool = False,
    pin: bool = False,
) -> Column:
    """The protected form of a text column.

    Null stays null, blank stays as it is.  ``keep_format`` leaves the separators
    of CPF and CNPJ numbers in place instead of returning digits only.  ``pin``
    is for columns that are joined on or filtered by next; see ``fpe``.
    """
    kind = P.transformation(name).kind
    failed = failure(on_error, f"a value does not fit the template of {name}")
    if kind == P.FPE:
        coded = fpe.fpe(normalized(c, name), name, keyring, pin=pin)
        shown = fpe.like_original(coded, c, name) if keep_format else coded
        # null means that the template did not fit: no need to test it again
        return F.coalesce(shown, F.when(~has_value(c), c).otherwise(failed))
    if kind == P.MASKING:
        shown = masks.MASKS[name](c)
    else:
        shown = tokens.token(c, name, keyring)
    return F.when(~has_value(c), c).when(fits(c, name), shown).otherwise(failed)


def protect(
    df: DataFrame,
    policy: P.ProtectionPolicy,
    keyring: Keyring,
    role: str = "api-role",
    on_error: str = RAISE,
    names: Mapping[str, str] | None = None,
    pin: bool = False,
) -> DataFrame:
    """Protect the columns a policy lists, in place.

    Other columns, column order and row count stay.  ``names`` gives new columns
    to write to instead (raw column -> protected column).  A missing grant fails
    here, before any data is read.
    """
    columns = policy.resolve(df.columns)
    P.check_grants(role, "encode", sorted(set(columns.values())))
    target = names or {}
    return df.withColumns(
        {
            target.get(c, c): protect_column(named(c), name, keyring, on_error, pin=pin)
            for c, name in columns.items()
        }
    )


def _tallies(columns: Mapping[str, str], refused: Mapping[str, str] = {}) -> list[Column]:
    """Per protected column: values to transform, and those that do not fit or may not be."""
    out = []
    for c, name in columns.items():
        given = has_value(named(c))
        out.append(F.count_if(given).alias(f"{c}:values"))
        wrong = given if c in refused else given & ~fits(named(c), name)
        out.append(F.count_if(wrong).alias(f"{c}:errors"))
    return out


def protect_observed(
    df: DataFrame,
    policy: P.ProtectionPolicy,
    keyring: Keyring,
    role: str = "pipeline-role",
    on_error: str = SENTINEL,
    refused_as_errors: bool = False,
) -> tuple[DataFrame, Observation]:
    """``protect`` that also counts, in the same job, records, values and errors.

    With ``refused_as_errors`` the values of columns that the role may not encode count
    as errors and are replaced like those (never passed on in clear), so that a job can
    finish; else a missing grant fails while the plan is built.
    """
    columns = policy.resolve(df.columns)
    refused = {
        c: n
        for c, n in columns.items()
        if refused_as_errors and on_error != RAISE and not P.may(role, "encode", n)
    }
    counts = Observation("protect")
    tallies = _tallies(columns, refused)
    observed = df.observe(counts, F.count(F.lit(1)).alias("records"), *tallies)
    allowed = P.ProtectionPolicy({c: n for c, n in columns.items() if c not in refused})
    safe = protect(observed, allowed, keyring, role, on_error)
    hidden = {
        c: F.when(~has_value(named(c)), named(c)).otherwise(
            failure(on_error, f"{role} may not encode with {n}")
        )
        for c, n in refused.items()
    }
    return safe.withColumns(hidden) if hidden else safe, counts


def summarize(counts: Mapping[str, int]) -> dict[str, int]:
    """Totals of an observed run."""
    values = [n for key, n in counts.items() if key.endswith(":values")]
    errors = [n for key, n in counts.items() if key.endswith(":errors")]
    return {
        "records": counts["records"],
        "fields_protected": len(values),
        "values": sum(values),
        "errors": sum(errors),
    }


def protection_report(df: DataFrame, policy: P.ProtectionPolicy) -> DataFrame:
    """One row per protected column: values and errors, from one pass."""
    columns = policy.resolve(df.columns)
    totals = df.agg(F.count(F.lit(1)).alias("records"), *_tallies(columns))
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(name).alias("transformation"),
            F.lit(P.transformation(name).kind).alias("kind"),
            named(f"{c}:values").alias("n_values"),
            named(f"{c}:errors").alias("n_errors"),
        )
        for c, name in columns.items()
    ]
    return totals.select("records", F.inline(F.array(*entries)))


def encode_values(
    df: DataFrame, keyring: Keyring, role: str = "api-role", on_error: str = RAISE
) -> DataFrame:
    """Ad-hoc encode of a ``(transformation, value)`` frame, any mix of transformations.

    The values are taken as given: separators of CPF and CNPJ stay where they are.
    A transformation that the role may not use counts as an error of that row.
    """
    kind, value = F.col("transformation"), F.col("value")
    encoded = F.when(value.isNull(), F.lit(None).cast("string"))
    for name in P.TRANSFORMATIONS:
        if P.may(role, "encode", name):
            mine = F.when(kind == name, value)
            shown = protect_column(mine, name, keyring, on_error, keep_format=True)
            encoded = encoded.when(kind == name, shown)
    refused = failure(on_error, f"{role} may not encode with this transformation")
    reversible = [n for n, t in P.TRANSFORMATIONS.items() if t.reversible]
    return df.withColumns(
        {
            "original_length": text.original_length(value),
            "encoded_value": encoded.otherwise(refused),
            "reversible": kind.isin(reversible),
        }
    )
