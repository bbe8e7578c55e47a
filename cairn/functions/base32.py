"""Base-32 spelling of digests, as an Arrow-batched kernel."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed value: the alphabet leaves out e, o, t and u
ALPHABET = "0123456789abcdfghijklmnpqrsvwxyz"


def encode(data: bytes) -> str:
    """The digest as a number, least byte first, in base 32, greatest digit first."""
    size = (len(data) * 8 + 4) // 5
    number = int.from_bytes(data, "little")
    return "".join(ALPHABET[(number >> (5 * i)) & 31] for i in reversed(range(size)))


def decode(text: str, size: int) -> bytes | None:
    if len(text) != (size * 8 + 4) // 5 or any(c not in ALPHABET for c in text):
        return None
    number = 0
    for c in text:
        number = number << 5 | ALPHABET.index(c)
    return number.to_bytes(size, "little") if number < 1 << (8 * size) else None


@F.pandas_udf(StringType())
def hex_to_base32(h: pd.Series) -> pd.Series:
    return h.map(lambda x: None if x is None else encode(bytes.fromhex(x)))


@F.pandas_udf(StringType())
def base32_to_hex(s: pd.Series) -> pd.Series:
    def one(x):
        d = None if x is None else decode(x, 32)
        return None if d is None else d.hex()

    return s.map(one)
