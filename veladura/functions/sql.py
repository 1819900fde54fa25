"""The same functions for SQL users, as temporary functions of a session."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from veladura import policy as P
from veladura.functions import tokens
from veladura.functions.fpe import cipher_udf
from veladura.keys import Keyring


def function_name(operation: str, name: str) -> str:
    """``encode`` and ``ff-cpf`` give ``encode_ff_cpf``."""
    return f"{operation}_{name.replace('-', '_')}"


def _define(spark: SparkSession, name: str, arguments: str, body: str) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS STRING RETURN {body}")


# One text argument v each; a function may call those above it.
_TEXT_FUNCTIONS = {
    "normalize_cpf": "translate(v, './-', '')",
    "normalize_cnpj": "translate(v, './-', '')",
    "normalize_pan": "translate(v, ' -', '')",
    "normalize_phone_marks": "translate(v, '() -', '')",
    "keep_digits": "regexp_replace(v, '[^0-9]', '')",
    "format_cpf": """CASE WHEN length(normalize_cpf(v)) = 11 THEN concat(
        substr(normalize_cpf(v), 1, 3), '.', substr(normalize_cpf(v), 4, 3), '.',
        substr(normalize_cpf(v), 7, 3), '-', substr(normalize_cpf(v), 10, 2)) ELSE v END""",
    "format_cnpj": """CASE WHEN length(normalize_cnpj(v)) = 14 THEN concat(
        substr(normalize_cnpj(v), 1, 2), '.', substr(normalize_cnpj(v), 3, 3), '.',
        substr(normalize_cnpj(v), 6, 3), '/', substr(normalize_cnpj(v), 9, 4), '-',
        substr(normalize_cnpj(v), 13, 2)) ELSE v END""",
    "group_pan": """CASE WHEN length(v) = 16 THEN concat_ws(' ', substr(v, 1, 4),
        substr(v, 5, 4), substr(v, 9, 4), substr(v, 13, 4)) ELSE v END""",
    "display_cpf": """CASE WHEN length(v) = 11 THEN concat('***.***.', substr(v, 7, 3), '-',
        substr(v, 10, 2)) ELSE repeat('*', length(v)) END""",
    "display_phone": """CASE WHEN length(v) = 11 THEN concat('(', substr(v, 1, 2), ') *****-',
        substr(v, 8, 4)) ELSE repeat('*', length(v)) END""",
    "display_pan": """CASE WHEN length(v) = 16 THEN concat('**** **** **** ', right(v, 4))
        WHEN length(v) >= 13 THEN concat(repeat('*', length(v) - 4), right(v, 4))
        ELSE repeat('*', length(v)) END""",
    "mask_all": "repeat('*', length(v))",
    "mask_dob": "concat('**/**/', right(v, 4))",
    "mask_name": r"regexp_replace(v, '(?<=[^ ])[^ ]|(?<![^ ])[^ \\p{Lu}]', '*')",
    "mask_email": """concat(left(v, 1), repeat('*', instr(v, '@') - 2), '@',
        left(substr(v, instr(v, '@') + 1), 1),
        repeat('*', instr(substr(v, instr(v, '@') + 1), '.') - 2),
        substr(substr(v, instr(v, '@') + 1), instr(substr(v, instr(v, '@') + 1), '.')))""",
}
_MASK_FUNCTIONS = {
    "mask-email": "mask_email",
    "mask-nome": "mask_name",
    "mask-dob": "mask_dob",
    "mask-cvv": "mask_all",
}


def register_text_functions(spark: SparkSession) -> list[str]:
    """Normalising, formatting, displaying and masking functions; they need no key."""
    for name, body in _TEXT_FUNCTIONS.items():
        _define(spark, name, "v STRING", body)
    return list(_TEXT_FUNCTIONS)


def register_protect_functions(
    spark: SparkSession, keyring: Keyring, role: str, names: Iterable[str] | None = None
) -> list[str]:
    """``encode_*`` for what the role may encode, ``decode_*`` for the FPE it may decode.

    Keys stay out of SQL: ciphers and tokens are functions that carry their own, and no
    view or function text holds one.  A value that does not fit its template gives null; FPE takes
    digits only.  Masks need ``register_text_functions`` first.
    """
    chosen = [n for n in (names or P.TRANSFORMATIONS) if P.may(role, "encode", n)]
    made = []
    for name in chosen:
        t = P.transformation(name)
        if t.kind == P.FPE:
            for operation in ("encode", "decode"):
                if not P.may(role, operation, name):
                    continue
                inner = "_" + function_name(operation, name)
                spark.udf.register(inner, cipher_udf(name, keyring, None, operation == "decode"))
                template = t.template.replace("\\", "\\\\")
                body = (
                    f"lpad(CAST({inner}(CASE WHEN v RLIKE '{template}' THEN CAST(v AS BIGINT) END, "
                    "length(v)) AS STRING), length(v), '0')"
                )
                _define(spark, function_name(operation, name), "v STRING", body)
                made.append(function_name(operation, name))
        elif t.kind == P.MASKING:
            template = t.template.replace("\\", "\\\\")
            body = f"CASE WHEN v RLIKE '{template}' THEN {_MASK_FUNCTIONS[name]}(v) END"
            _define(spark, function_name("encode", name), "v STRING", body)
            made.append(function_name("encode", name))
        else:
            # the function carries its key, as the cipher does: SQL sees neither view nor text of it
            inner = "_" + function_name("encode", name)
            spark.udf.register(inner, tokens.token_udf(name, keyring))
            _define(spark, function_name("encode", name), "v STRING", f"{inner}(v)")
            made.append(function_name("encode", name))
    return made
