"""Password hashing by a hasher of the caller's choice.

bcrypt isn't available here, and no weaker hash is passed off as it: without a hasher, writing a password fails.
A hasher has hash(password) -> text, salted, and matches(password, text) -> bool, and is shipped to the executors.
"""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Hasher(Protocol):
    def hash(self, password: str) -> str: ...

    def matches(self, password: str, hashed: str) -> bool: ...


class Pbkdf2Hasher:
    """PBKDF2 with SHA-256 from the standard library; its texts say so. Not bcrypt, and not compatible with it."""

    def __init__(self, rounds: int = 120_000) -> None:
        self.rounds = rounds

    def _digest(self, password: str, salt: bytes, rounds: int) -> str:
        import hashlib

        return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds).hex()

    def hash(self, password: str) -> str:
        import os

        salt = os.urandom(16)
        return f"pbkdf2-sha256${self.rounds}${salt.hex()}${self._digest(password, salt, self.rounds)}"

    def matches(self, password: str, hashed: str) -> bool:
        import hmac

        kind, _, rest = hashed.partition("$")
        if kind != "pbkdf2-sha256" or rest.count("$") != 2:
            return False
        rounds, salt, digest = rest.split("$")
        return hmac.compare_digest(self._digest(password, bytes.fromhex(salt), int(rounds)), digest)


def hash_column(password: Column, hasher: Hasher) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda p: None if p is None else hasher.hash(p))

    return run.asNondeterministic()(password)


def matches_column(password: Column, hashed: Column, hasher: Hasher) -> Column:
    """False where either is null."""

    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([p is not None and h is not None and hasher.matches(p, h) for p, h in zip(x, y, strict=True)], dtype=bool)

    return run(password, hashed)
