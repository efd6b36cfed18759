"""Byte codecs that need unbounded integers or sponges: Arrow-batched functions over BINARY columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ACCOUNT = T.StructType([T.StructField("balance", T.BinaryType()), T.StructField("nonce", T.LongType()), T.StructField("code", T.BinaryType())])


def var_int(number: Column) -> Column:
    """Length byte and big-endian bytes without leading zeros of a non-negative LONG, as hex."""
    text = F.regexp_replace(F.lower(F.lpad(F.hex(number), 16, "0")), "^(00)+", "")
    return F.concat(F.lpad(F.lower(F.hex(F.length(text) / 2)), 2, "0"), text)


def read_var_int(encoded: Column) -> Column:
    """The number of such bytes (hex) again, up to 2^63 - 1; a length byte that is not the bytes' is an error."""
    digits = F.substring(encoded, 3, 1 << 20)
    sound = F.conv(F.substring(encoded, 1, 2), 16, 10).cast("int") * 2 == F.length(digits)
    number = F.coalesce(F.conv(digits, 16, 10).cast("bigint"), F.lit(0).cast("bigint"))
    return F.when(sound, number).otherwise(F.raise_error(F.concat(F.lit("short variable-length number "), encoded)).cast("bigint"))


def put_var(number: int) -> bytes:
    data = number.to_bytes((number.bit_length() + 7) // 8, "big")
    return bytes([len(data)]) + data


def get_var(data: bytes, at: int) -> tuple[int, int]:
    size = data[at]
    if at + 1 + size > len(data):
        raise ValueError("short variable-length number")
    return int.from_bytes(data[at + 1 : at + 1 + size], "big"), at + 1 + size


def _encode(balance: pd.Series, nonce: pd.Series, code: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else put_var(int.from_bytes(b, "big")) + put_var(int(n)) + (c or b"") for b, n, c in zip(balance, nonce, code, strict=True)])


def _decode(data: pd.Series) -> pd.DataFrame:
    rows = []
    for d in data:
        if d is None:
            rows.append((None, None, None))
            continue
        balance, at = get_var(d, 0)
        nonce, at = get_var(d, at)
        if len(d) - at not in (0, 20, 32):
            raise ValueError("a code reference has 0, 20 or 32 bytes")
        rows.append((balance.to_bytes(32, "big"), nonce, d[at:]))
    return pd.DataFrame(rows, columns=["balance", "nonce", "code"])


def _sum(values: pd.Series) -> bytes:
    return (sum(int.from_bytes(v, "big") for v in values if v is not None) % (1 << 256)).to_bytes(32, "big")


def _round_constants() -> list[int]:
    """Bits of the 24 rounds from the shift register x^8 + x^6 + x^5 + x^4 + 1."""
    state, bits = 1, []
    for _ in range(7 * 24):
        bits.append(state & 1)
        state <<= 1
        if state & 0x100:
            state ^= 0x171
    return [sum(bits[7 * r + j] << (2**j - 1) for j in range(7)) for r in range(24)]


def _rotations() -> dict[tuple[int, int], int]:
    x, y, out = 1, 0, {(0, 0): 0}
    for t in range(24):
        out[x, y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return out


_CONSTANTS, _TURNS, _ONES = _round_constants(), _rotations(), (1 << 64) - 1


def keccak256(data: bytes) -> bytes:
    """The original Keccak padding (not that of SHA-3)."""
    rate, lanes = 136, {(x, y): 0 for x in range(5) for y in range(5)}
    padded = bytearray(data + b"\x01" + b"\0" * (-(len(data) + 1) % rate))
    padded[-1] |= 0x80
    turn = lambda v, n: (v << n | v >> (64 - n)) & _ONES if n else v
    for start in range(0, len(padded), rate):
        for k in range(rate // 8):
            lanes[k % 5, k // 5] ^= int.from_bytes(padded[start + 8 * k : start + 8 * k + 8], "little")
        for constant in _CONSTANTS:
            parity = [lanes[x, 0] ^ lanes[x, 1] ^ lanes[x, 2] ^ lanes[x, 3] ^ lanes[x, 4] for x in range(5)]
            spread = [parity[x - 1] ^ turn(parity[(x + 1) % 5], 1) for x in range(5)]
            moved = {(y, (2 * x + 3 * y) % 5): turn(lanes[x, y] ^ spread[x], _TURNS[x, y]) for x, y in lanes}
            lanes = {(x, y): moved[x, y] ^ (~moved[(x + 1) % 5, y] & _ONES & moved[(x + 2) % 5, y]) for x, y in moved}
            lanes[0, 0] ^= constant
    return b"".join(lanes[k % 5, k // 5].to_bytes(8, "little") for k in range(4))


def _slot(address: pd.Series) -> pd.Series:
    return pd.Series([None if a is None else keccak256(a.rjust(32, b"\0") + b"\0" * 32) for a in address])


def encode_account(balance: Column, nonce: Column, code: Column) -> Column:
    """Big-endian balance of up to 32 bytes, nonce, and nothing or 20 or 32 bytes of code reference, as one BINARY."""
    return F.pandas_udf(_encode, "binary")(balance, nonce, code)


def decode_account(data: Column) -> Column:
    """A struct of balance (32 bytes), nonce and code reference."""
    return F.pandas_udf(_decode, _ACCOUNT)(data)


def sum_wide(values: Column) -> Column:
    """An aggregate: the sum of big-endian numbers, modulo 2^256, as 32 bytes."""
    return F.pandas_udf(_sum, "binary")(values)


def token_slot(address: Column) -> Column:
    """The storage slot of an address in a token's balance map: the hash of two padded words, address and zero."""
    return F.pandas_udf(_slot, "binary")(address)
