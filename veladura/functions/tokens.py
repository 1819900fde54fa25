"""Convergent tokens: a keyed hash of the value, as built-in expressions only."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from veladura.keys import Keyring

PREFIX = "TKN-"
HEX_DIGITS = 32  # 128 bits: no collisions expected among billions of values
PATTERN = r"^TKN-[0-9a-f]{32}\z"


def token_udf(transformation: str, keyring: Keyring):
    """The same token as a function of Arrow batches that holds its key, for use in SQL."""
    inner, outer = keyring.token_pads(transformation)
    prefix, size = PREFIX, HEX_DIGITS

    def one(value: str) -> str:
        within = hashlib.sha256(inner + value.encode()).digest()
        return prefix + hashlib.sha256(outer + within).hexdigest()[:size]

    def run(values: pa.Array) -> pa.Array:
        held = values.dictionary_encode()  # repeats within the batch are hashed once
        made = pa.array([one(v) for v in held.dictionary.to_pylist()], pa.string())
        return made.take(held.indices)

    run.__name__ = f"encode_{transformation.replace('-', '_')}"
    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")


def token(c: Column, transformation: str, keyring: Keyring) -> Column:
    """HMAC-SHA256 of the text: same value, same token; one key per transformation."""
    key = keyring.column(transformation)
    inner = F.unhex(F.sha2(F.concat(key["inner"], F.encode(c, "UTF-8")), 256))
    outer = F.sha2(F.concat(key["outer"], inner), 256)
    return F.concat(F.lit(PREFIX), F.substring(outer, 1, HEX_DIGITS))


def seal(c: Column, transformation: str, keyring: Keyring) -> Column:
    """The value encrypted for the token map (AES-GCM, fresh nonce per row)."""
    return F.aes_encrypt(F.encode(c, "UTF-8"), keyring.column(transformation)["store"], F.lit("GCM"))


def unseal(c: Column, transformation: str, keyring: Keyring) -> Column:
    key = keyring.column(transformation)["store"]
    return F.decode(F.aes_decrypt(c, key, F.lit("GCM")), "UTF-8")
