"""Fictitious customers, computed from a key: the same key gives the same person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Made up: what names, hosts, streets and categories are drawn from.
NAMES = ("Teresa de Azevedo Prado", "Vicente Brandão", "Olívia dos Reis Tavares", "Caetano Fontoura e Sá")
HOSTS = ("@correio.example.org", "@caixa.example.net", "@posta.example.com.br", "@carta.example.com.br")
STREETS = ("da Figueira", "dos Oleiros", "Nova do Moinho")
RACES = ("grupo um", "grupo dois", "grupo três", "grupo quatro", "grupo cinco")
HEALTH = (
    "Enxaqueca",
    "Rinite sazonal",
    "Miopia",
    "Gastrite leve",
    "Tendinite no ombro",
    "Anemia",
    "Insônia",
    "Sem queixas",
)
RELIGIONS = (
    "Taoísta",
    "Xintoísta",
    "Jainista",
    "Sikh",
    "Zoroastrista",
    "Luterana",
    "Metodista",
    "Agnóstica",
)


def _pick(pool: tuple[str, ...], number: str) -> str:
    options = ", ".join("'" + p.replace("'", "\\'") + "'" for p in pool)
    return f"element_at(array({options}), CAST({number} % {len(pool)} + 1 AS INT))"


def _digits(number: str, width: int) -> str:
    return f"lpad(CAST(({number}) % {10**width} AS STRING), {width}, '0')"


def _with_check_digits(nine: str) -> str:
    """A CPF as a number, from its first nine digits; see ``functions.text.cpf_number``."""
    digits = [f"{nine} div {10 ** (8 - i)} % 10" for i in range(9)]
    first = " + ".join(f"{10 - i} * ({d})" for i, d in enumerate(digits))
    first = f"(({first}) * 10 % 11 % 10)"
    second = " + ".join(f"{11 - i} * ({d})" for i, d in enumerate([*digits, first]))
    return f"{nine} * 100 + {first} * 10 + ({second}) * 10 % 11 % 10"


def _cpf(k: str) -> str:
    number = _with_check_digits(f"(({k} * 7919 + 123456789) % 1000000000)")
    return f"lpad(CAST({number} AS STRING), 11, '0')"


def _pan(k: str) -> str:
    return f"concat('4', {_digits(f'{k} * 104729 + 987654321', 15)})"


def customer_cpf(key: str) -> Column:
    """The CPF of the customer whose key is in a bigint column."""
    return F.expr(_cpf(key))


def customer_pan(key: str) -> Column:
    return F.expr(_pan(key))


def _cnpj(k: str) -> str:
    root = _digits(f"{k} * 6700417 + 19131876", 8)
    plain = f"concat({root}, '0001', {_digits(k, 2)})"
    return rf"regexp_replace({plain}, '^(..)(...)(...)(....)(..)$', '$1.$2.$3/$4-$5')"


def customer_fields(k: str) -> dict[str, str]:
    """All raw fields of customer ``k`` (a non-negative bigint), as SQL text."""
    return {
        "id": k,
        "nome": _pick(NAMES, k),
        "cpf": _cpf(k),
        "cnpj": _cnpj(k),
        "rg": _digits(f"{k} * 48271 + 314159", 9),
        "cnh": _digits(f"{k} * 2750159 + 1618033", 11),
        "email": f"concat('cliente.', lpad(CAST({k} AS STRING), 6, '0'), {_pick(HOSTS, k)})",
        "telefone": f"concat('119', {_digits(f'{k} * 15485863 + 1234567', 8)})",
        "pan": f"CASE WHEN {k} % 7 <> 0 THEN {_pan(k)} END",
        "cvv": _digits(k, 3),
        "dob": f"concat_ws('/', {_digits(f'{k} % 28 + 1', 2)}, {_digits(f'{k} % 12 + 1', 2)}, "
        f"CAST(1960 + {k} % 41 AS STRING))",
        "endereco": f"CASE WHEN {k} % 11 = 0 THEN '' WHEN {k} % 13 = 0 THEN ' ' ELSE concat('Rua ', "
        f"{_pick(STREETS, k)}, ', ', CAST({k} % 200 + 1 AS STRING), ', São Paulo, SP') END",
        "conta": f"concat('BR', lpad({_digits(f'{k} * 179424673 + 271828', 15)}, 25, '0'), 'P1')",
        "saude": _pick(HEALTH, k),
        "raca": _pick(RACES, k),
        "religiao": _pick(RELIGIONS, f"{k} div 8"),
    }


def customers(keys: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One fictitious customer per row of a frame with a bigint key."""
    fields = [f"{value} AS {name}" for name, value in customer_fields(key).items()]
    return keys.selectExpr(*fields, *keep)


def sample_customers(spark: SparkSession, n: int = 200) -> DataFrame:
    """``n`` customers numbered from one, for demonstrations and tests."""
    return customers(spark.range(1, n + 1), "id")
