"""Password verifiers: scrypt, salted, in whole batches.

A verifier is ``scrypt$n$r$p$salt$hash`` (salt and hash in base64), so that its cost can be raised later:
:func:`needs_rehash` tells which are below the present one. Defined results: NULL passwords have no verifier,
and nothing is verified by a NULL or malformed verifier; such a check costs as much as any other.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import secrets

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cost of new verifiers: 2 ** 14 blocks of 8, one lane (16 MB each).
N, R, P = 2**14, 8, 1
_SALT, _LENGTH = 16, 32


def _derive(password: str, salt: bytes, n: int, r: int, p: int) -> bytes:
    return hashlib.scrypt(password.encode(), salt=salt, n=n, r=r, p=p, maxmem=256 * n * r, dklen=_LENGTH)


def make(password: str, n: int = N, r: int = R, p: int = P) -> str:
    salt = secrets.token_bytes(_SALT)
    return f"scrypt${n}${r}${p}${base64.b64encode(salt).decode()}${base64.b64encode(_derive(password, salt, n, r, p)).decode()}"


def _parts(verifier: str | None) -> tuple[int, int, int, bytes, bytes] | None:
    try:
        kind, n, r, p, salt, digest = (verifier or "").split("$")
        return (int(n), int(r), int(p), base64.b64decode(salt, validate=True), base64.b64decode(digest, validate=True)) if kind == "scrypt" else None
    except ValueError:
        return None


def matches(password: str | None, verifier: str | None) -> bool:
    """Whether a password is the verifier's; an unknown account takes as long as a known one."""
    parts = _parts(verifier)
    n, r, p, salt, digest = parts or (N, R, P, b"\0" * _SALT, b"")
    return hmac.compare_digest(_derive(password or "", salt, n, r, p), digest) and parts is not None and password is not None


def needs_rehash(verifier: str | None) -> bool:
    parts = _parts(verifier)
    return parts is None or parts[:3] < (N, R, P)


def verifier(password: Column) -> Column:
    """A new verifier of every password; salts are random, so write the result once and read that."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else make(v) for v in values], dtype=object)

    return run.asNondeterministic()(password)


def verified(password: Column, stored: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(values: pd.Series, verifiers: pd.Series) -> pd.Series:
        return pd.Series([matches(v, s) for v, s in zip(values, verifiers)], dtype=bool)

    return run(password, stored)
