"""Normalisers, formats, displays, masks and tokens on the values of the blueprint."""

import hashlib
import hmac

import pytest

from veladura.functions import masks, text, tokens
from veladura.operators import validate

CASES = [
    (text.normalize_cpf, {"123.456.789-09": "12345678909", "12345678909": "12345678909", None: None}),
    (text.normalize_cnpj, {"12.345.678/0001-90": "12345678000190"}),
    (text.normalize_pan, {"4111 1111 1111 1111": "4111111111111111", "4111-1111": "41111111"}),
    (text.keep_digits, {"(11) 99876-5432": "11998765432", "RG 1.2": "12", "": ""}),
    (text.normalize_phone_marks, {"(11) 99876-5432": "11998765432", "+55 (11)": "+5511"}),
    (text.format_cpf, {"12345678909": "123.456.789-09", "123": "123", "123.456.789-09": "123.456.789-09"}),
    (text.format_cnpj, {"12345678000190": "12.345.678/0001-90", "1": "1"}),
    (text.group_pan, {"4823761493025817": "4823 7614 9302 5817", "42": "42", None: None}),
    (text.display_cpf, {"12345678909": "***.***.789-09", "123": "***", None: None}),
    (text.display_phone, {"11998765432": "(11) *****-5432", "1199": "****", None: None}),
    (
        text.display_pan,
        {
            "4823761493025817": "**** **** **** 5817",
            "4823761493025": "*********3025",
            "123": "***",
            None: None,
        },
    ),
    (text.cpf_from_base, {"123456789": "12345678909", "000000000": "00000000000", "12": None, "12345678x": None}),
    (masks.mask_name, {
        "João Carlos da Silva": "J*** C***** ** S****",
        "Érica  d'Ávila E": "É****  ******* E",
        "JOÃO": "J***",
        "a": "*",
        " x Y ": " * Y ",
    }),
    (masks.mask_email, {
        "joao.silva@empresa.com": "j*********@e******.com",
        "maria.costa@gmail.com.br": "m**********@g****.com.br",
        "a@b.c": "a@b.c",
        "x@yz@w.com": "x@y***.com",
    }),
    (masks.mask_dob, {"15/03/1985": "**/**/1985"}),
    (masks.mask_all, {"123": "***", "1234": "****"}),
    (validate.valid_cpf, {"123.456.789-09": True, "123": False, "1234567890A": False, None: None}),
    (validate.valid_pan, {"4111 1111 1111 1111": True, None: True, "4111": False, "4" * 17: False}),
]


@pytest.mark.parametrize("function, cases", CASES, ids=lambda x: getattr(x, "__name__", ""))
def test_values(apply, function, cases):
    assert apply(function, *cases) == list(cases.values())


def test_check_digits_by_the_branching_rule(spark):
    """The branch-free formula against the usual one, for many bases."""
    from pyspark.sql import functions as F

    def digits(base):
        d = [int(x) for x in base]
        for first in (10, 11):
            rest = sum((first - i) * x for i, x in enumerate(d)) % 11
            d.append(0 if rest < 2 else 11 - rest)
        return "".join(map(str, d))

    frame = spark.range(0, 10**9, 999_983).select(F.lpad(F.col("id").cast("string"), 9, "0").alias("b"))
    rows = frame.select("b", text.cpf_from_base(F.col("b")).alias("cpf")).collect()
    assert len(rows) > 1000
    assert all(r.cpf == digits(r.b) for r in rows)


def test_token_is_an_hmac(apply, keys):
    value = "Rua das Flores, 123, São Paulo, SP"
    inner, _ = keys.token_pads("tok-endereco")
    key = bytes(b ^ 0x36 for b in inner)
    expected = "TKN-" + hmac.new(key, value.encode(), hashlib.sha256).hexdigest()[:32]
    assert apply(lambda c: tokens.token(c, "tok-endereco", keys), value, value) == [expected] * 2
    assert apply(lambda c: tokens.token(c, "tok-conta", keys), value) != [expected]
