"""What is protected how, and who may do it: transformations, field maps, grants."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

FPE, MASKING, TOKENIZATION = "fpe", "masking", "tokenization"


@dataclass(frozen=True)
class Transformation:
    name: str
    kind: str
    template: str | None  # what a normalised value must look like; None takes any text
    digits: int | None = None  # how many, where the template fixes it

    @property
    def reversible(self) -> bool:
        return self.kind in (FPE, TOKENIZATION)


# The transformations, their kinds and templates.
TRANSFORMATIONS: dict[str, Transformation] = {
    t.name: t
    for t in (
        Transformation("ff-cpf", FPE, r"^[0-9]{11}\z", 11),
        Transformation("ff-cnpj", FPE, r"^[0-9]{14}\z", 14),
        Transformation("ff-rg", FPE, r"^[0-9]{9}\z", 9),
        Transformation("ff-cnh", FPE, r"^[0-9]{11}\z", 11),
        Transformation("ff-pan", FPE, r"^[0-9]{13,16}\z"),
        Transformation("ff-telefone", FPE, r"^[0-9]{11}\z", 11),
        Transformation("mask-email", MASKING, r"^(\w)([^@]*)(@)(\w)([^.]*)(\..*)\z"),
        Transformation("mask-nome", MASKING, r"(?s)^.+\z"),
        Transformation("mask-dob", MASKING, r"^[0-9]{2}/[0-9]{2}/[0-9]{4}\z"),
        Transformation("mask-cvv", MASKING, r"^[0-9]{3,4}\z"),
        Transformation("tok-endereco", TOKENIZATION, None),
        Transformation("tok-conta", TOKENIZATION, None),
        Transformation("tok-saude", TOKENIZATION, None),
        Transformation("tok-raca", TOKENIZATION, None),
        Transformation("tok-religiao", TOKENIZATION, None),
    )
}

# Which transformation a customer field gets, and the name the
# protected value is stored under.
FIELD_TRANSFORMATIONS = {
    "cpf": "ff-cpf",
    "cnpj": "ff-cnpj",
    "rg": "ff-rg",
    "cnh": "ff-cnh",
    "pan": "ff-pan",
    "telefone": "ff-telefone",
    "email": "mask-email",
    "nome": "mask-nome",
    "dob": "mask-dob",
    "cvv": "mask-cvv",
    "endereco": "tok-endereco",
    "conta": "tok-conta",
    "saude": "tok-saude",
    "raca": "tok-raca",
    "religiao": "tok-religiao",
}
STORED_NAMES = {
    "cpf": "cpf_protected",
    "cnpj": "cnpj_protected",
    "rg": "rg_protected",
    "cnh": "cnh_protected",
    "pan": "pan_protected",
    "telefone": "telefone_protected",
    "email": "email_masked",
    "dob": "dob_masked",
    "cvv": "cvv_masked",
    "endereco": "endereco_token",
    "conta": "conta_token",
    "saude": "saude_token",
    "raca": "raca_token",
    "religiao": "religiao_token",
}

CUSTOMER_FIELDS = (
    "cpf", "cnpj", "rg", "cnh", "pan", "telefone",
    "email", "nome", "dob", "cvv", "endereco", "conta",
)
BATCH_FIELDS = ("cpf", "pan", "telefone", "email", "nome", "dob", "endereco", "conta")
RETROFIT_FIELDS = (
    "cpf", "email", "telefone", "pan", "dob", "endereco", "saude", "raca", "religiao",
)

# Legal articles that ask for each field's protection.
LEGAL_ARTICLES = {
    "cpf": "Art. 46, 48",
    "pan": "Art. 46, 48",
    "telefone": "Art. 46",
    "email": "Art. 47",
    "nome": "Art. 47",
    "dob": "Art. 46, 47",
    "cvv": "Art. 46, 48",
    "endereco": "Art. 46, 48",
    "conta": "Art. 46, 48",
    "saude": "Art. 11, 46, 48",
    "raca": "Art. 11, 46, 48",
    "religiao": "Art. 11, 46, 48",
}

# The transformations each role may encode; decode is core-role's alone.
ENCODE_GRANTS = {
    "api-role": (
        "ff-cpf", "ff-cnpj", "ff-pan", "ff-telefone",
        "mask-email", "mask-nome", "mask-dob", "mask-cvv",
        "tok-endereco", "tok-conta", "tok-saude", "tok-raca", "tok-religiao",
    ),
    "core-role": (
        "ff-cpf", "ff-cnpj", "ff-rg", "ff-cnh", "ff-pan", "ff-telefone",
        "mask-email", "mask-nome", "mask-dob", "mask-cvv",
        "tok-endereco", "tok-conta", "tok-saude", "tok-raca", "tok-religiao",
    ),
    "db-role": (
        "ff-cpf", "ff-cnpj", "ff-rg", "ff-cnh", "ff-pan", "ff-telefone",
        "tok-endereco", "tok-conta", "tok-saude", "tok-raca", "tok-religiao",
    ),
    "pipeline-role": (
        "ff-cpf", "ff-cnpj", "ff-pan", "ff-telefone", "mask-email", "mask-dob",
        "tok-endereco", "tok-conta", "tok-saude", "tok-raca", "tok-religiao",
    ),
    "support-role": ("mask-email", "mask-nome", "mask-dob", "mask-cvv"),
    "dpo-role": (),
}
DECODE_ROLES = ("core-role",)


class GrantError(PermissionError):
    """The role may not perform this operation on this transformation."""


def transformation(name: str) -> Transformation:
    try:
        return TRANSFORMATIONS[name]
    except KeyError:
        raise ValueError(f"unknown transformation '{name}'") from None


def may(role: str, operation: str, name: str) -> bool:
    t = transformation(name)
    if role not in ENCODE_GRANTS:
        raise ValueError(f"unknown role '{role}'")
    listed = name in ENCODE_GRANTS[role]
    if operation == "encode":
        return listed
    if operation == "decode":
        return listed and t.reversible and role in DECODE_ROLES
    raise ValueError(f"unknown operation '{operation}'")


def check_grants(role: str, operation: str, names: Iterable[str]) -> None:
    """Fail while the plan is being built, never on some row of the data."""
    refused = [n for n in names if not may(role, operation, n)]
    if refused:
        raise GrantError(f"{role} may not {operation} {', '.join(refused)}")


@dataclass(frozen=True)
class ProtectionPolicy:
    """Which column is protected by which transformation.

    Names match without regard to case; columns that a frame does not have are
    left out, columns that are not listed pass through.
    """

    fields: Mapping[str, str]

    def __post_init__(self):
        for name in self.fields.values():
            transformation(name)

    @classmethod
    def of(cls, *fields: str) -> "ProtectionPolicy":
        return cls({f: FIELD_TRANSFORMATIONS[f] for f in fields})

    @classmethod
    def parse(cls, text: str) -> "ProtectionPolicy":
        """Read ``column:transformation,column:transformation``."""
        fields = {}
        for item in filter(None, (part.strip() for part in text.split(","))):
            column, colon, name = (piece.strip() for piece in item.partition(":"))
            if not (column and colon and name):
                raise ValueError(f"expected column:transformation, got '{item}'")
            fields[column] = name
        return cls(fields)

    def without(self, *fields: str) -> "ProtectionPolicy":
        return ProtectionPolicy({f: t for f, t in self.fields.items() if f not in fields})

    def resolve(self, columns: Iterable[str]) -> dict[str, str]:
        """The columns of a frame that are protected, as spelled there."""
        known = {f.lower(): t for f, t in self.fields.items()}
        return {c: known[c.lower()] for c in columns if c.lower() in known}


customer_policy = ProtectionPolicy.of(*CUSTOMER_FIELDS)
keep_name_policy = customer_policy.without("nome")
batch_policy = ProtectionPolicy.of(*BATCH_FIELDS)
retrofit_policy = ProtectionPolicy({f"{f}_raw": FIELD_TRANSFORMATIONS[f] for f in RETROFIT_FIELDS})


def policy_frame(spark: SparkSession) -> DataFrame:
    """field, transformation, kind, reversible, legal_article."""
    rows = [
        (f, t, transformation(t).kind, transformation(t).reversible, LEGAL_ARTICLES.get(f))
        for f, t in FIELD_TRANSFORMATIONS.items()
    ]
    return spark.createDataFrame(
        rows,
        "field string, transformation string, kind string, reversible boolean, "
        "legal_article string",
    )


def grants_frame(spark: SparkSession) -> DataFrame:
    """role, transformation, can_encode, can_decode: one row per pair."""
    rows = [
        (role, name, may(role, "encode", name), may(role, "decode", name))
        for role in ENCODE_GRANTS
        for name in TRANSFORMATIONS
    ]
    return spark.createDataFrame(
        rows, "role string, transformation string, can_encode boolean, can_decode boolean"
    )
