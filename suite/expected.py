"""Building blocks of the checking SQL (DuckDB): the same data and rules, written again."""

from __future__ import annotations

from suite.data import DEMO_KEYS
from suite.ff3_sql import ff3_ctes
from veladura import policy as P
from veladura.sources import synthetic as S


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def pick(pool, number: str) -> str:
    return f"[{', '.join(quoted(p) for p in pool)}][1 + {number} % {len(pool)}]"


def digits(number: str, width: int) -> str:
    return f"lpad(CAST(({number}) % {10**width} AS VARCHAR), {width}, '0')"


def cpf_of(k: str) -> str:
    """CPF of a key: nine digits, then two check digits by the branching rule."""
    nine = digits(f"{k} * 7919 + 123456789", 9)
    d = [f"CAST(substr({nine}, {i}, 1) AS BIGINT)" for i in range(1, 10)]
    s1 = " + ".join(f"{10 - i} * {x}" for i, x in enumerate(d))
    first = f"(CASE WHEN ({s1}) % 11 < 2 THEN 0 ELSE 11 - ({s1}) % 11 END)"
    s2 = " + ".join(f"{11 - i} * {x}" for i, x in enumerate([*d, first]))
    second = f"(CASE WHEN ({s2}) % 11 < 2 THEN 0 ELSE 11 - ({s2}) % 11 END)"
    return f"({nine} || CAST({first} AS VARCHAR) || CAST({second} AS VARCHAR))"


_CNPJ = f"({digits('k * 6700417 + 19131876', 8)} || '0001' || {digits('k', 2)})"

PEOPLE = f"""people AS (
  SELECT k AS id,
    {pick(S.NAMES, 'k')} AS nome,
    {cpf_of('k')} AS cpf,
    substr({_CNPJ}, 1, 2) || '.' || substr({_CNPJ}, 3, 3) || '.' || substr({_CNPJ}, 6, 3) || '/'
      || substr({_CNPJ}, 9, 4) || '-' || substr({_CNPJ}, 13, 2) AS cnpj,
    {digits('k * 48271 + 314159', 9)} AS rg,
    {digits('k * 2750159 + 1618033', 11)} AS cnh,
    'cliente.' || lpad(CAST(k AS VARCHAR), 6, '0') || {pick(S.HOSTS, 'k')} AS email,
    '119' || {digits('k * 15485863 + 1234567', 8)} AS telefone,
    CASE WHEN k % 7 <> 0 THEN '4' || {digits('k * 104729 + 987654321', 15)} END AS pan,
    {digits('k', 3)} AS cvv,
    {digits('k % 28 + 1', 2)} || '/' || {digits('k % 12 + 1', 2)} || '/'
      || CAST(1960 + k % 41 AS VARCHAR) AS dob,
    CASE WHEN k % 11 = 0 THEN '' WHEN k % 13 = 0 THEN ' '
      ELSE 'Rua ' || {pick(S.STREETS, 'k')} || ', ' || CAST(k % 200 + 1 AS VARCHAR)
      || ', São Paulo, SP' END AS endereco,
    'BR' || lpad({digits('k * 179424673 + 271828', 15)}, 25, '0') || 'P1' AS conta,
    {pick(S.HEALTH, 'k')} AS saude,
    {pick(S.RACES, 'k')} AS raca,
    {pick(S.RELIGIONS, '(k // 8)')} AS religiao
  FROM (SELECT c_custkey AS k FROM customer)
)"""

_SPACED = (
    "(CASE WHEN length(pan) = 16 THEN substr(pan, 1, 4) || ' ' || substr(pan, 5, 4) || ' ' || "
    "substr(pan, 9, 4) || ' ' || substr(pan, 13, 4) ELSE pan END)"
)
CPF_FORMATTED = (
    "(substr({c}, 1, 3) || '.' || substr({c}, 4, 3) || '.' || substr({c}, 7, 3) || '-' "
    "|| substr({c}, 10, 2))"
)
ROUGH = f"""rough AS (
  SELECT id,
    CASE WHEN id % 43 = 2 THEN NULL WHEN id % 47 = 6 THEN 'Érica  d''Ávila E'
      WHEN id % 47 = 7 THEN 'JOÃO' ELSE nome END AS nome,
    CASE WHEN id % 17 = 3 THEN '123' WHEN id % 19 = 5 THEN substr(cpf, 1, 10) || 'A'
      WHEN id % 23 = 7 THEN cpf || '0'
      WHEN id % 5 = 1 THEN {CPF_FORMATTED.format(c='cpf')} ELSE cpf END AS cpf,
    cnpj, rg, cnh,
    CASE WHEN id % 29 = 11 THEN replace(email, '@', '#') WHEN id % 41 = 9 THEN NULL
      ELSE email END AS email,
    CASE WHEN id % 2 = 0 THEN '(' || substr(telefone, 1, 2) || ') ' || substr(telefone, 3, 5)
      || '-' || substr(telefone, 8, 4) ELSE telefone END AS telefone,
    CASE WHEN id % 37 = 4 THEN '12345' WHEN id % 3 = 1 THEN {_SPACED}
      WHEN id % 3 = 2 THEN replace({_SPACED}, ' ', '-')
      WHEN id % 10 = 3 THEN substr(pan, 1, 13) ELSE pan END AS pan,
    CASE WHEN id % 2 = 1 THEN {digits('id', 4)} ELSE cvv END AS cvv,
    CASE WHEN id % 31 = 13 THEN '1985-03-15' ELSE dob END AS dob,
    endereco, conta, saude, raca, religiao
  FROM people
)"""


# ---- rules -----------------------------------------------------------------


def has_value(c: str) -> str:
    return f"coalesce(trim({c}) <> '', FALSE)"


def normalized(c: str, name: str) -> str:
    if name in ("ff-cpf", "ff-cnpj"):
        return f"translate({c}, './-', '')"
    if name == "ff-pan":
        return f"translate({c}, ' -', '')"
    if name in ("ff-rg", "ff-cnh", "ff-telefone"):
        return f"regexp_replace({c}, '[^0-9]', '', 'g')"
    return c


# written out here, so that a changed template in the library shows
TEMPLATES = {
    "ff-cpf": "^[0-9]{11}$",
    "ff-cnpj": "^[0-9]{14}$",
    "ff-rg": "^[0-9]{9}$",
    "ff-cnh": "^[0-9]{11}$",
    "ff-pan": "^[0-9]{13,16}$",
    "ff-telefone": "^[0-9]{11}$",
    "mask-email": "^([0-9A-Za-z_])([^@]*)(@)([0-9A-Za-z_])([^.]*)([.].*)$",
    "mask-nome": "(?s)^.+$",
    "mask-dob": "^[0-9]{2}/[0-9]{2}/[0-9]{4}$",
    "mask-cvv": "^[0-9]{3,4}$",
}


def fits(c: str, name: str) -> str:
    if name not in TEMPLATES:
        return "TRUE"
    return f"regexp_matches({normalized(c, name)}, '{TEMPLATES[name]}')"


def token(c: str, name: str) -> str:
    inner, outer = (pad.hex() for pad in DEMO_KEYS.token_pads(name))
    hashed = f"unhex(sha256(unhex('{inner}') || encode({c})))"
    return f"('TKN-' || substr(sha256(unhex('{outer}') || {hashed}), 1, 32))"


def mask_email(c: str) -> str:
    p = TEMPLATES["mask-email"]
    g = [f"regexp_extract({c}, '{p}', {i})" for i in range(7)]
    return (
        f"({g[1]} || repeat('*', length({g[2]})) || {g[3]} || {g[4]} "
        f"|| repeat('*', length({g[5]})) || {g[6]})"
    )


def mask_name(c: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({c}, ' '), lambda w: "
        "CASE WHEN w = '' THEN '' WHEN substr(w, 1, 1) <> lower(substr(w, 1, 1)) "
        "THEN substr(w, 1, 1) || repeat('*', length(w) - 1) ELSE repeat('*', length(w)) END), ' ')"
    )


def mask_dob(c: str) -> str:
    return f"('**/**/' || right({c}, 4))"


def mask_cvv(c: str) -> str:
    return f"repeat('*', length({c}))"


MASKS = {
    "mask-email": mask_email,
    "mask-nome": mask_name,
    "mask-dob": mask_dob,
    "mask-cvv": mask_cvv,
}


def protected(
    source: str, columns: dict[str, str], result: str, otherwise: str = "'ERROR'", keep: str = ""
) -> str:
    """CTEs that protect the columns of ``source`` into ``result``, cipher included.

    Columns that are not protected are taken over if listed in ``keep``.
    """
    fpe = {c: n for c, n in columns.items() if P.transformation(n).kind == P.FPE}
    parts, joins, shown = [], [], ["s.id"]
    if fpe:
        values = " UNION ALL ".join(
            f"SELECT id, '{n}' AS name, CAST({normalized(c, n)} AS BIGINT) AS x, "
            f"length({normalized(c, n)}) AS n FROM {source} WHERE {fits(c, n)}"
            for c, n in fpe.items()
        )
        parts.append(f"{result}_values AS MATERIALIZED ({values})")
        parts.append(ff3_ctes(DEMO_KEYS, sorted(set(fpe.values())), f"{result}_values", f"{result}_enc"))
    for c, n in columns.items():
        if c in fpe:
            joins.append(f"LEFT JOIN {result}_enc e_{c} ON e_{c}.id = s.id AND e_{c}.name = '{n}'")
            good = f"WHEN e_{c}.y IS NOT NULL THEN e_{c}.y"
        else:
            made = MASKS[n](f"s.{c}") if n in MASKS else token(f"s.{c}", n)
            good = f"WHEN {fits(f's.{c}', n)} THEN {made}"
        shown.append(
            f"CASE WHEN NOT {has_value(f's.{c}')} THEN s.{c} {good} ELSE {otherwise} END AS {c}"
        )
    extra = f", {keep}" if keep else ""
    parts.append(f"{result} AS (SELECT {', '.join(shown)}{extra} FROM {source} s {' '.join(joins)})")
    return ",\n".join(parts)


def columns(*fields: str) -> dict[str, str]:
    return {f: P.FIELD_TRANSFORMATIONS[f] for f in fields}


CREATED = "(TIMESTAMP '2020-01-01 00:00:00' + to_seconds(s.id * 7919 % 5000 * 60))"
_STORED_FIELDS = ("cpf", "email", "telefone", "pan", "cvv", "dob", "endereco", "conta")
STORED = f"""{PEOPLE},
{protected('people', columns(*_STORED_FIELDS), 'safe', keep=f's.nome, {CREATED} AS created_at')},
stored AS (
  SELECT id, nome, cpf AS cpf_protected, email AS email_masked, telefone AS telefone_protected,
    pan AS pan_protected, cvv AS cvv_masked, dob AS dob_masked, endereco AS endereco_token,
    conta AS conta_token, created_at, created_at AS updated_at FROM safe
)"""


def stored(select: str) -> str:
    return f"WITH RECURSIVE {STORED}\n{select}"


def people(select: str) -> str:
    return f"WITH {PEOPLE}\n{select}"


def rough(select: str) -> str:
    return f"WITH {PEOPLE},\n{ROUGH}\n{select}"


_RETROFIT = columns(*P.RETROFIT_FIELDS)
_RAW = ", ".join(f"s.{f} AS {f}_raw" for f in P.RETROFIT_FIELDS)
RETROFITTED = f"""{PEOPLE},
{protected('people', _RETROFIT, 'safe', keep=f's.nome, {_RAW}, {CREATED} AS created_at')},
retrofitted AS (
  SELECT id, nome, {', '.join(f'{f}_raw' for f in P.RETROFIT_FIELDS)},
    {', '.join(f'{f} AS {P.STORED_NAMES[f]}' for f in P.RETROFIT_FIELDS)},
    TRUE AS protected, created_at FROM safe
)"""


def retrofitted(select: str) -> str:
    return f"WITH RECURSIVE {RETROFITTED}\n{select}"
