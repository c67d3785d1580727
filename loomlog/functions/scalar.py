"""Scalar functions as Column expressions: hashes, strings, times, enums."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = "decimal(20,0)"
MASK32 = 0xFFFFFFFF


def sha64(key: Column) -> Column:
    """First 8 bytes of SHA-256, big-endian, unsigned."""
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 16), 16, 10).cast(U64)


def md5_64(key: Column) -> Column:
    """First 8 bytes of MD5, big-endian, unsigned."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 16), 16, 10).cast(U64)


def sha64_hex(key: Column) -> Column:
    """sha64 as 16 hexadecimal digits, which order as the numbers do."""
    return F.substring(F.sha2(key.cast("binary"), 256), 1, 16)


def key_bytes(key: Column) -> Column:
    """The bytes of key as an array of numbers: each is a character of the Latin-1 reading."""
    chars = F.split(F.decode(key.cast("binary"), "ISO-8859-1"), "")
    return F.when(F.octet_length(key) > 0, F.transform(chars, lambda c: F.ascii(c).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def folded(key: Column, start: int, step) -> Column:
    """A 32-bit hash folded over the bytes of key."""
    return F.aggregate(key_bytes(key), F.lit(start).cast("long"), lambda h, b: step(h, b).bitwiseAND(F.lit(MASK32)))


def fnv1a(key: Column) -> Column:
    return folded(key, 2166136261, lambda h, b: h.bitwiseXOR(b) * 16777619)


def djb2(key: Column) -> Column:
    return folded(key, 5381, lambda h, b: h * 33 + b)


def sdbm(key: Column) -> Column:
    return folded(key, 0, lambda h, b: b + h * 65599)


def shard_of(h: Column, shards: int) -> Column:
    return F.pmod(h, F.lit(shards))


def trimmed(s: Column) -> Column:
    """Without white space (space, tab to carriage return) at both ends."""
    return F.regexp_replace(s, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")


def split_parts(s: Column, delimiter: str, most: int = -1) -> Column:
    """Parts of a string; empty ones inside stay, one at the end goes."""
    parts = F.split(s, "\\Q" + delimiter + "\\E", most)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"\.([^.]*)$", 1)


def in_hash_range(h: Column, start: Column, end: Column) -> Column:
    """start <= h < end, around the end of the ring if start > end."""
    return F.when(start <= end, (h >= start) & (h < end)).otherwise((h >= start) | (h < end))


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """Bits and hash functions of a Bloom filter for n entries at the false-positive rate p."""
    import math

    bits = math.ceil(-n * math.log(p) / math.log(2) ** 2)
    return bits, max(1, round(bits / max(n, 1) * math.log(2)))


def next_power_of_two(n: Column) -> Column:
    return F.when(n <= 1, F.lit(1)).otherwise(F.pow(F.lit(2), F.ceil(F.log2(n)))).cast("long")


def left_trimmed(s: Column) -> Column:
    return F.regexp_replace(s, r"^[ \t\n\x0B\f\r]+", "")


def right_trimmed(s: Column) -> Column:
    return F.regexp_replace(s, r"[ \t\n\x0B\f\r]+$", "")


#: Letters of strftime patterns, as Spark's patterns have them.
TIME_LETTERS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%%": "%"}


def time_pattern(pattern: str) -> str:
    """Spark's pattern of a strftime one; other letters are quoted."""
    parts = re.split(r"(%.)", pattern)
    if unknown := [p for p in parts[1::2] if p not in TIME_LETTERS]:
        raise ValueError(f"no counterpart of {unknown[0]}")
    return "".join(TIME_LETTERS[p] if i % 2 else re.sub(r"([A-Za-z]+)", r"'\1'", p) for i, p in enumerate(parts))


def parsed_time(s: Column, pattern: str) -> Column:
    """A time of a text in a strftime pattern; null if it doesn't fit."""
    return F.try_to_timestamp(s, F.lit(time_pattern(pattern))).cast("timestamp_ntz")


def elapsed_ms(start: Column, end: Column) -> Column:
    return F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))


def enum_name(value: Column, names: list[str], other: str = "Unknown") -> Column:
    """The name of a number from 0."""
    out = F.when(value == 0, names[0])
    for i, name in enumerate(names[1:], 1):
        out = out.when(value == i, name)
    return out.otherwise(other)


def random_int(low: int, high: int, seed: int | None = None) -> Column:
    """From low to high, both in the range."""
    return (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("long")


def random_float(low: float, high: float, seed: int | None = None) -> Column:
    return F.rand(seed) * (high - low) + low


def random_string(length: int, seed: int | None = None) -> Column:
    """ASCII letters and digits."""
    return F.randstr(F.lit(length), F.lit(seed)) if seed is not None else F.randstr(F.lit(length))


def random_bytes(length: int, seed: int | None = None) -> Column:
    """Bytes from a seeded digest chain of a random number."""
    digests = [F.unhex(F.sha2(F.concat_ws(":", F.rand(seed).cast("string"), F.lit(str(i))).cast("binary"), 256)) for i in range(-(-length // 32))]
    return F.substring(F.concat(*digests), 1, length)
