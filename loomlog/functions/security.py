"""Digests with keys, key derivation, encryption and encodings."""

from __future__ import annotations

import hashlib
import hmac
import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _each(f, kind: str):
    @F.pandas_udf(kind)
    def values(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else f(bytes(v)))

    return values


def hmac_hex(data: Column, secret: bytes, kind: str = "sha256") -> Column:
    """HMAC by a digest of hashlib, in hexadecimal digits."""
    return _each(lambda v: hmac.new(secret, v, kind).hexdigest(), "string")(data.cast("binary"))


def hmac_sha256(data: Column, secret: bytes, block: int = 64) -> Column:
    """HMAC-SHA-256 without Python: two nested digests."""
    key = (hashlib.sha256(secret).digest() if len(secret) > block else secret).ljust(block, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in key).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, data.cast("binary")), 256))), 256)


def blake2b_hex(data: Column, size: int = 64) -> Column:
    return _each(lambda v: hashlib.blake2b(v, digest_size=size).hexdigest(), "string")(data.cast("binary"))


def sha512_hex(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 512)


def pbkdf2_hex(password: Column, salt: bytes, rounds: int, size: int = 32, kind: str = "sha256") -> Column:
    return _each(lambda v: hashlib.pbkdf2_hmac(kind, v, salt, rounds, size).hex(), "string")(password.cast("binary"))


def password_hash(password: str, rounds: int = 100_000, salt: bytes | None = None) -> str:
    """rounds$salt$digest of a password."""
    salt = os.urandom(16) if salt is None else salt
    return f"{rounds}${salt.hex()}${hashlib.pbkdf2_hmac('sha256', password.encode(), salt, rounds).hex()}"


def password_fits(password: str, kept: str) -> bool:
    rounds, salt, _ = kept.split("$")
    return hmac.compare_digest(password_hash(password, int(rounds), bytes.fromhex(salt)), kept)


def encrypted(data: Column, key: Column, mode: str = "GCM") -> Column:
    """AES (GCM, CBC or ECB; keys of 16, 24 or 32 bytes); the initial vector stands in front."""
    return F.aes_encrypt(data, key, F.lit(mode))


def decrypted(data: Column, key: Column, mode: str = "GCM") -> Column:
    return F.aes_decrypt(data, key, F.lit(mode))


def from_base64(text: Column) -> Column:
    """The bytes of a text in base64; null if it isn't such."""
    return F.try_to_binary(text, F.lit("base64"))
