"""The cipher: known answers, an independent AES, a plain re-statement, and properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veladura.functions.ff3 import BlockCipher, Ff3
from veladura.functions.fpe import fpe
from veladura.operators.protect import normalized, protect_column
from veladura.operators.reveal import reveal_column

KNOWN = [
    ("2DE79D232DF5585D68CE47882AE256D6", "CBD09280979564", "3992520240", "8901801106"),
    (
        "EF4359D8D580AA4F7F036D6F04FC6A94",
        "D8E7920AFA330A",
        "890121234567890000",
        "477064185124354662",
    ),
]


def cipher_of(key, tweak):
    return Ff3(bytes.fromhex(key), bytes.fromhex(tweak))


def words(block):
    return [np.frombuffer(block, dtype="<u4")[i : i + 1] for i in range(4)]


def plain_ff3(cipher: Ff3, text: str, decode: bool) -> str:
    """FF3-1 one value at a time with Python integers, as the specification puts it."""
    n = len(text)
    u = (n + 1) // 2
    a, b = text[:u], text[u:]
    for i in reversed(range(8)) if decode else range(8):
        m = u if i % 2 == 0 else n - u
        other = a if decode else b
        block = int(other[::-1]).to_bytes(12, "little") + cipher.tweak_words[i].to_bytes(4, "little")
        out = b"".join(w.tobytes() for w in cipher.cipher.encrypt(words(block)))
        y = int.from_bytes(out, "little")
        mine = int((b if decode else a)[::-1])
        c = str((mine - y if decode else mine + y) % 10**m).zfill(m)[::-1]
        a, b = (c, a) if decode else (b, c)
    return a + b


@pytest.mark.parametrize("key, tweak, plain, secret", KNOWN)
def test_known_answers(key, tweak, plain, secret):
    c, n = cipher_of(key, tweak), len(plain)
    assert c.run(np.array([int(plain)]), n, False).tolist() == [int(secret)]
    assert c.run(np.array([int(secret)]), n, True).tolist() == [int(plain)]
    assert plain_ff3(c, plain, False) == secret
    assert plain_ff3(c, secret, True) == plain


@pytest.mark.parametrize("size", [16, 24, 32])
def test_block_cipher_against_the_engine(spark, size):
    """Another AES: the first block of what Spark encrypts in ECB mode."""
    rng = np.random.default_rng(size)
    key, blocks = rng.bytes(size), [rng.bytes(16) for _ in range(50)]
    frame = spark.createDataFrame([(bytearray(b),) for b in blocks], "b binary")
    theirs = [
        bytes(r[0])
        for r in frame.select(
            F.substring(F.aes_encrypt("b", F.lit(key), F.lit("ECB"), F.lit("PKCS")), 1, 16)
        ).collect()
    ]
    state = np.frombuffer(b"".join(blocks), dtype="<u4").reshape(-1, 4)
    out = BlockCipher(key).encrypt([state[:, i].copy() for i in range(4)])
    ours = np.stack(out, axis=1).astype("<u4").tobytes()
    assert [ours[16 * i : 16 * i + 16] for i in range(50)] == theirs


@settings(max_examples=60, deadline=None)
@given(
    st.binary(min_size=16, max_size=16),
    st.binary(min_size=7, max_size=7),
    st.lists(st.text("0123456789", min_size=6, max_size=18), min_size=1, max_size=30),
)
def test_batches_of_any_length_match_the_plain_form(key, tweak, values):
    c = Ff3(key, tweak)
    numbers = np.array([int(v) for v in values], dtype=np.int64)
    widths = np.array([len(v) for v in values])
    coded = c.run(numbers, widths, False)
    assert [str(x).zfill(n) for x, n in zip(coded, widths)] == [plain_ff3(c, v, False) for v in values]
    assert c.run(coded, widths, True).tolist() == numbers.tolist()


def test_one_to_one_on_a_whole_domain():
    c = cipher_of(*KNOWN[0][:2])
    coded = c.run(np.arange(10**6), 6, False)
    assert np.array_equal(np.sort(coded), np.arange(10**6))


@pytest.mark.parametrize(
    "name, good, bad",
    [
        ("ff-cpf", ["123.456.789-09", "00000000000"], ["123", "1234567890A", "123456789012", "12345678909\n"]),
        ("ff-cnpj", ["12.345.678/0001-90"], ["12345678", "1234567800019X"]),
        ("ff-rg", ["12.345.678-9"], ["12345678"]),
        ("ff-cnh", ["01234567891"], ["0123456789"]),
        ("ff-pan", ["4111 1111 1111 1111", "4111-1111-1111-1", "4111111111111", "9" * 16], ["411111111111", "4" * 17]),
        ("ff-telefone", ["(11) 99876-5432"], ["+55 11 99876-5432"]),
    ],
)
def test_shape_and_round_trip(apply, keys, name, good, bad):
    plain = apply(lambda c: normalized(c, name), *good)
    coded = apply(lambda c: protect_column(c, name, keys), *good)
    assert all(len(x) == len(p) and x.isdigit() and x != p for x, p in zip(coded, plain))
    assert apply(lambda c: reveal_column(c, name, keys), *coded) == plain
    assert apply(lambda c: fpe(normalized(c, name), name, keys), *bad) == [None] * len(bad)


def test_deterministic_and_keyed_per_transformation(apply, keys):
    same = apply(lambda c: protect_column(c, "ff-cpf", keys), "12345678909", "123.456.789-09")
    assert same[0] == same[1]
    assert apply(lambda c: protect_column(c, "ff-cnh", keys), "12345678909")[0] != same[0]


def test_format_is_kept_on_request(apply, keys):
    plain, kept = "123.456.789-09", lambda c: protect_column(c, "ff-cpf", keys, keep_format=True)
    (shown,) = apply(kept, plain)
    (digits,) = apply(lambda c: protect_column(c, "ff-cpf", keys), plain)
    assert shown == f"{digits[:3]}.{digits[3:6]}.{digits[6:9]}-{digits[9:]}"
    back = lambda c: reveal_column(c, "ff-cpf", keys, keep_format=True)
    assert apply(back, shown) == [plain]
