"""Key material.

Every transformation has its own key, derived from one master secret.  Keys never
appear in a plan: Spark expressions read them through a one-row scalar subquery
(printed as ``scalar-subquery#n``), and the FF3-1 kernel carries its key inside
the serialised function.
"""

from __future__ import annotations

import hashlib
import hmac
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_HASH_BLOCK = 64  # SHA-256 works on 64-byte blocks, so HMAC pads its key to that


class Keyring:
    """Derives the keys of all transformations from one master secret.

    ``fpe_keys`` fixes the key and tweak of chosen transformations instead, for
    data that was already encrypted under known ones.
    """

    def __init__(self, master: bytes, fpe_keys: dict[str, tuple[bytes, bytes]] | None = None):
        if len(master) < 16:
            raise ValueError("the master secret needs at least 16 bytes")
        self._master = master
        self._fpe_keys = dict(fpe_keys or {})

    @classmethod
    def from_env(cls, variable: str = "VELADURA_MASTER_KEY") -> "Keyring":
        """Read the master secret, in hex, from the driver's environment."""
        return cls(bytes.fromhex(os.environ[variable]))

    def __repr__(self) -> str:
        return "Keyring(<hidden>)"

    def _derive(self, purpose: str, transformation: str) -> bytes:
        label = f"{purpose}:{transformation}".encode()
        return hmac.new(self._master, label, hashlib.sha256).digest()

    def fpe(self, transformation: str) -> tuple[bytes, bytes]:
        """AES key and seven-byte tweak."""
        if transformation in self._fpe_keys:
            return self._fpe_keys[transformation]
        return (
            self._derive("fpe-key", transformation)[:16],
            self._derive("fpe-tweak", transformation)[:7],
        )

    def token_pads(self, transformation: str) -> tuple[bytes, bytes]:
        """Inner and outer padded HMAC-SHA256 key."""
        key = self._derive("token", transformation).ljust(_HASH_BLOCK, b"\0")
        return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)

    def store(self, transformation: str) -> bytes:
        """AES key that encrypts the values kept in the token map."""
        return self._derive("store", transformation)

    def frame(self, spark: SparkSession, transformation: str) -> DataFrame:
        """One row ``(key struct<inner, outer, store>)`` for a token transformation."""
        inner, outer = self.token_pads(transformation)
        row = pa.table(
            {
                "inner": pa.array([inner], pa.binary()),
                "outer": pa.array([outer], pa.binary()),
                "store": pa.array([self.store(transformation)], pa.binary()),
            }
        )
        return spark.createDataFrame(row).select(F.struct("inner", "outer", "store").alias("key"))

    def column(self, transformation: str) -> Column:
        """The key struct as a scalar subquery, usable in any expression."""
        return self.frame(SparkSession.active(), transformation).scalar()
