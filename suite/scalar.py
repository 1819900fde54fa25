"""Column functions over whole tables: normalise, format, display, mask, token, cipher."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import expected as X
from suite.data import DEMO_KEYS, people, rough_people, stored
from suite.registry import query
from veladura import policy as P
from veladura.functions import fpe as fpe_functions
from veladura.functions import masks, text, tokens
from veladura.operators import validate, views
from veladura.operators.protect import has_value, normalized, protect_column
from veladura.operators.reveal import reveal_column


@query("H1", X.rough("SELECT id, translate(cpf, './-', '') AS cpf FROM rough"))
def normalize_cpf(spark, sf_dir):
    return rough_people(spark, sf_dir).select("id", text.normalize_cpf(F.col("cpf")).alias("cpf"))


@query("H2", X.rough("SELECT id, translate(cnpj, './-', '') AS cnpj FROM rough"))
def normalize_cnpj(spark, sf_dir):
    return rough_people(spark, sf_dir).select("id", text.normalize_cnpj(F.col("cnpj")).alias("cnpj"))


@query("H3", X.rough("SELECT id, regexp_replace(telefone, '[^0-9]', '', 'g') AS telefone FROM rough"))
def normalize_phone(spark, sf_dir):
    return rough_people(spark, sf_dir).select("id", text.keep_digits(F.col("telefone")).alias("telefone"))


@query("H4", X.rough("SELECT id, translate(pan, ' -', '') AS pan FROM rough"))
def normalize_pan(spark, sf_dir):
    return rough_people(spark, sf_dir).select("id", text.normalize_pan(F.col("pan")).alias("pan"))


@query(
    "H5",
    X.rough(
        "SELECT id, regexp_replace('RG ' || rg, '[^0-9]', '', 'g') AS rg, "
        "regexp_replace(cnh || ' SP', '[^0-9]', '', 'g') AS cnh FROM rough"
    ),
)
def normalize_documents(spark, sf_dir):
    return rough_people(spark, sf_dir).select(
        "id",
        text.keep_digits(F.concat(F.lit("RG "), "rg")).alias("rg"),
        text.keep_digits(F.concat("cnh", F.lit(" SP"))).alias("cnh"),
    )


@query("H6", X.rough("SELECT id, translate(telefone, '() -', '') AS telefone FROM rough"))
def normalize_phone_marks(spark, sf_dir):
    return rough_people(spark, sf_dir).select(
        "id", text.normalize_phone_marks(F.col("telefone")).alias("telefone")
    )


@query("H7", X.people("SELECT CAST(id AS VARCHAR) AS id, nome FROM people"))
def as_text(spark, sf_dir):
    return people(spark, sf_dir).select(
        text.as_text(F.col("id")).alias("id"), text.as_text(F.col("nome")).alias("nome")
    )


_PLAIN = "translate(cpf, './-', '')"


@query(
    "H8",
    X.rough(
        f"SELECT id, CASE WHEN length({_PLAIN}) = 11 THEN {X.CPF_FORMATTED.format(c=_PLAIN)} "
        "ELSE cpf END AS cpf FROM rough"
    ),
)
def format_cpf(spark, sf_dir):
    return rough_people(spark, sf_dir).select("id", text.format_cpf(F.col("cpf")).alias("cpf"))


@query(
    "H9",
    X.people(
        "SELECT id, cnpj, right(translate(cnpj, './-', ''), 13) AS short FROM people"
    ),
)
def format_cnpj(spark, sf_dir):
    plain = text.normalize_cnpj(F.col("cnpj"))
    return people(spark, sf_dir).select(
        "id",
        text.format_cnpj(plain).alias("cnpj"),
        text.format_cnpj(F.right(plain, F.lit(13))).alias("short"),
    )


@query(
    "H10",
    X.people(
        "SELECT id, substr(pan, 1, 4) || ' ' || substr(pan, 5, 4) || ' ' || substr(pan, 9, 4) || ' ' "
        "|| substr(pan, 13, 4) AS pan, left(pan, 13) AS short FROM people"
    ),
)
def group_pan(spark, sf_dir):
    return people(spark, sf_dir).select(
        "id",
        text.group_pan(F.col("pan")).alias("pan"),
        text.group_pan(F.left("pan", F.lit(13))).alias("short"),
    )


@query(
    "H11",
    X.rough(
        "SELECT id, CASE WHEN length(cpf) = 11 THEN '***.***.' || substr(cpf, 7, 3) || '-' "
        "|| substr(cpf, 10, 2) ELSE repeat('*', length(cpf)) END AS shown FROM rough"
    ),
)
def display_cpf(spark, sf_dir):
    return rough_people(spark, sf_dir).select("id", text.display_cpf(F.col("cpf")).alias("shown"))


@query(
    "H12",
    X.rough(
        "SELECT id, CASE WHEN length(telefone) = 11 THEN '(' || left(telefone, 2) || ') *****-' "
        "|| right(telefone, 4) ELSE repeat('*', length(telefone)) END AS shown FROM rough"
    ),
)
def display_phone(spark, sf_dir):
    return rough_people(spark, sf_dir).select(
        "id", text.display_phone(F.col("telefone")).alias("shown")
    )


@query(
    "H13",
    X.rough(
        "SELECT id, CASE WHEN pan IS NULL THEN NULL WHEN length(pan) = 16 "
        "THEN '**** **** **** ' || right(pan, 4) WHEN length(pan) >= 13 "
        "THEN repeat('*', length(pan) - 4) || right(pan, 4) ELSE repeat('*', length(pan)) END "
        "AS shown FROM rough"
    ),
)
def display_pan(spark, sf_dir):
    return rough_people(spark, sf_dir).select("id", text.display_pan(F.col("pan")).alias("shown"))


@query(
    "H14",
    X.people("SELECT id, right(cpf, 2) AS digits, cpf, CAST(NULL AS VARCHAR) AS bad FROM people"),
)
def cpf_check_digits(spark, sf_dir):
    nine = F.left("cpf", F.lit(9))
    return people(spark, sf_dir).select(
        "id",
        text.cpf_check_digits(nine).alias("digits"),
        text.cpf_from_base(nine).alias("cpf"),
        text.cpf_check_digits(F.left("cpf", F.lit(8))).alias("bad"),
    )


@query(
    "H15",
    X.people(
        "SELECT id, pan, telefone, regexp_matches(pan, '^4[0-9]{15}$') AS pan_shape, "
        "regexp_matches(telefone, '^119[0-9]{8}$') AS telefone_shape FROM people"
    ),
)
def made_up_numbers(spark, sf_dir):
    return people(spark, sf_dir).select(
        "id",
        "pan",
        "telefone",
        F.col("pan").rlike("^4[0-9]{15}$").alias("pan_shape"),
        F.col("telefone").rlike("^119[0-9]{8}$").alias("telefone_shape"),
    )


@query("H16 M6", X.people(f"SELECT id, {X.mask_email('email')} AS email FROM people"))
def mask_email(spark, sf_dir):
    return people(spark, sf_dir).select("id", masks.mask_email(F.col("email")).alias("email"))


@query("H17 M6", X.rough(f"SELECT id, {X.mask_name('nome')} AS nome FROM rough"))
def mask_name(spark, sf_dir):
    return rough_people(spark, sf_dir).select("id", masks.mask_name(F.col("nome")).alias("nome"))


@query("H18 M6", X.people(f"SELECT id, {X.mask_dob('dob')} AS dob FROM people"))
def mask_dob(spark, sf_dir):
    return people(spark, sf_dir).select("id", masks.mask_dob(F.col("dob")).alias("dob"))


@query("H19 M6", X.rough(f"SELECT id, {X.mask_cvv('cvv')} AS cvv FROM rough"))
def mask_cvv(spark, sf_dir):
    return rough_people(spark, sf_dir).select("id", masks.mask_all(F.col("cvv")).alias("cvv"))


@query(
    "H20",
    X.people(
        "SELECT id, repeat('#', length(nome)) AS nome, left(dob, 6) || 'XXXX' AS dob, "
        "repeat('#', length(cvv)) AS cvv FROM people"
    ),
)
def mask_with_character(spark, sf_dir):
    return people(spark, sf_dir).select(
        "id",
        masks.mask_all(F.col("nome"), "#").alias("nome"),
        masks.mask_groups(F.col("dob"), r"^(\d{2}/\d{2}/)(\d{4})\z", {2}, 2, "X").alias("dob"),
        masks.mask_all(F.col("cvv"), "#").alias("cvv"),
    )


_CNPJ_VALUES = (
    "v AS (SELECT id, 'ff-cnpj' AS name, CAST(translate(cnpj, './-', '') AS BIGINT) AS x, 14 AS n "
    "FROM people UNION ALL SELECT id, 'ff-cpf', CAST(cpf AS BIGINT), 11 FROM people)"
)


@query(
    "H21",
    f"WITH RECURSIVE {X.PEOPLE},\n{_CNPJ_VALUES},\n"
    f"{X.ff3_ctes(DEMO_KEYS, ['ff-cnpj', 'ff-cpf'], 'v', 'e')}\n"
    "SELECT a.id, substr(a.y, 1, 2) || '.' || substr(a.y, 3, 3) || '.' || substr(a.y, 6, 3) || '/' "
    "|| substr(a.y, 9, 4) || '-' || substr(a.y, 13, 2) AS cnpj, "
    f"{X.CPF_FORMATTED.format(c='b.y')} AS cpf, b.y AS plain "
    "FROM e a JOIN e b ON a.id = b.id AND a.name = 'ff-cnpj' AND b.name = 'ff-cpf'",
)
def encode_keeping_format(spark, sf_dir):
    def kept(c, name):
        return protect_column(c, name, DEMO_KEYS, keep_format=True)

    return people(spark, sf_dir).select(
        "id",
        kept(F.col("cnpj"), "ff-cnpj").alias("cnpj"),
        kept(text.format_cpf(F.col("cpf")), "ff-cpf").alias("cpf"),
        kept(F.col("cpf"), "ff-cpf").alias("plain"),
    )


@query(
    "H22",
    X.people(
        f"SELECT id, left({X.token('saude', 'tok-saude')}, 24) AS saude, "
        f"left({X.token('raca', 'tok-raca')}, 20) AS raca FROM people"
    ),
)
def shorten_tokens(spark, sf_dir):
    return people(spark, sf_dir).select(
        "id",
        text.shorten(tokens.token(F.col("saude"), "tok-saude", DEMO_KEYS), 24).alias("saude"),
        text.shorten(tokens.token(F.col("raca"), "tok-raca", DEMO_KEYS), 20).alias("raca"),
    )


@query("H23", X.rough("SELECT id, CAST(length(cpf) AS INTEGER) AS original_length FROM rough"))
def original_length(spark, sf_dir):
    return rough_people(spark, sf_dir).select(
        "id", text.original_length(F.col("cpf")).alias("original_length")
    )


# ---- predicates ------------------------------------------------------------


@query(
    "C1 C2",
    X.people(
        "SELECT id, coalesce(trim(endereco) <> '', FALSE) AS endereco, "
        "coalesce(trim(pan) <> '', FALSE) AS pan, CASE WHEN coalesce(trim(endereco) <> '', FALSE) "
        f"THEN {X.token('endereco', 'tok-endereco')} ELSE replace(endereco, ' ', chr(160)) END "
        "AS guarded FROM people"
    ),
)
def value_guard(spark, sf_dir):
    """Blank addresses are written with no-break spaces, which are blank too."""
    address = F.when(F.trim("endereco") == "", F.replace("endereco", F.lit(" "), F.lit("\u00a0")))
    address = F.coalesce(address, F.col("endereco"))
    return people(spark, sf_dir).select(
        "id",
        has_value(address).alias("endereco"),
        has_value(F.col("pan")).alias("pan"),
        protect_column(address, "tok-endereco", DEMO_KEYS).alias("guarded"),
    )


@query("C3", X.people("SELECT id, nullif(endereco, '') AS endereco, pan FROM people"))
def empty_to_null(spark, sf_dir):
    return people(spark, sf_dir).select(
        "id", F.nullif("endereco", F.lit("")).alias("endereco"), "pan"
    )


@query(
    "C9",
    X.rough("SELECT id, regexp_matches(translate(cpf, '.-', ''), '^[0-9]{11}$') AS valid FROM rough"),
)
def valid_cpf(spark, sf_dir):
    return rough_people(spark, sf_dir).select("id", validate.valid_cpf(F.col("cpf")).alias("valid"))


@query(
    "C10",
    X.rough(
        "SELECT id, pan IS NULL OR regexp_matches(translate(pan, ' -', ''), '^[0-9]{13,16}$') "
        "AS valid FROM rough"
    ),
)
def valid_pan(spark, sf_dir):
    return rough_people(spark, sf_dir).select("id", validate.valid_pan(F.col("pan")).alias("valid"))


_FIELD_BY_ID = ", ".join(f"'{n}'" for n in P.TRANSFORMATIONS)


@query(
    "C11",
    X.people(
        f"SELECT id, t, t NOT LIKE 'mask-%' AS reversible FROM "
        f"(SELECT id, [{_FIELD_BY_ID}][1 + id % {len(P.TRANSFORMATIONS)}] AS t FROM people)"
    ),
)
def reversible_transformation(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in P.TRANSFORMATIONS])
    place = (F.col("id") % len(P.TRANSFORMATIONS)).cast("int") + 1
    chosen = people(spark, sf_dir).select("id", F.element_at(names, place).alias("t"))
    return chosen.withColumn("reversible", validate.reversible(F.col("t")))


_CHECKED = X.columns("cpf", "cnpj", "rg", "cnh", "pan", "telefone", "email", "nome", "dob", "cvv")


@query(
    "C12",
    X.rough(
        "SELECT id, "
        + ", ".join(
            f"CASE WHEN {c} IS NOT NULL THEN {X.fits(c, n)} END AS {c}" for c, n in _CHECKED.items()
        )
        + " FROM rough"
    ),
)
def template_match(spark, sf_dir):
    return rough_people(spark, sf_dir).select(
        "id", *[validate.fits_template(F.col(c), n).alias(c) for c, n in _CHECKED.items()]
    )


# ---- cipher and tokens -----------------------------------------------------

_FPE = X.columns("cpf", "cnpj", "rg", "cnh", "pan", "telefone")


@query(
    "M1",
    f"WITH RECURSIVE {X.PEOPLE},\n{X.protected('people', _FPE, 'p')}\n"
    f"SELECT id, {', '.join(_FPE)} FROM p",
)
def fpe_encode(spark, sf_dir):
    return people(spark, sf_dir).select(
        "id",
        *[
            fpe_functions.fpe(normalized(F.col(c), n), n, DEMO_KEYS).alias(c)
            for c, n in _FPE.items()
        ],
    )


@query(
    "M2",
    X.people(
        "SELECT id, "
        + ", ".join(f"{X.normalized(c, n)} AS {c}" for c, n in _FPE.items())
        + " FROM people"
    ),
)
def fpe_decode(spark, sf_dir):
    coded = fpe_encode(spark, sf_dir)
    return coded.select("id", *[reveal_column(F.col(c), n, DEMO_KEYS).alias(c) for c, n in _FPE.items()])


_TOK = X.columns("endereco", "conta", "saude", "raca", "religiao")


@query(
    "M3",
    X.people(
        "SELECT id, " + ", ".join(f"{X.token(c, n)} AS {c}" for c, n in _TOK.items()) + " FROM people"
    ),
)
def token_encode(spark, sf_dir):
    return people(spark, sf_dir).select(
        "id", *[tokens.token(F.col(c), n, DEMO_KEYS).alias(c) for c, n in _TOK.items()]
    )


_MASKED = X.columns("email", "nome", "dob", "cvv")


@query(
    "M6",
    f"WITH {X.PEOPLE},\n{X.ROUGH},\n{X.protected('rough', _MASKED, 'p')}\n"
    "SELECT id, email, nome, dob, cvv FROM p",
)
def masks_with_guard(spark, sf_dir):
    return rough_people(spark, sf_dir).select(
        "id",
        *[protect_column(F.col(c), n, DEMO_KEYS, "sentinel").alias(c) for c, n in _MASKED.items()],
    )


@query(
    "B7",
    X.stored(
        "SELECT id, nome, '***.***.' || substr(cpf_protected, 7, 3) || '-' || "
        "substr(cpf_protected, 10, 2) AS cpf_display, email_masked, "
        "'(' || left(telefone_protected, 2) || ') *****-' || right(telefone_protected, 4) "
        "AS telefone_display, CASE WHEN pan_protected IS NOT NULL THEN '**** **** **** ' || "
        "right(pan_protected, 4) END AS pan_display, dob_masked, endereco_token, "
        "CAST(epoch(created_at) AS BIGINT) AS created_at FROM stored"
    ),
)
def support_view(spark, sf_dir):
    shown = views.support_view(stored(spark, sf_dir))
    return shown.withColumn("created_at", F.unix_timestamp("created_at"))
