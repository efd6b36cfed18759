"""Hash columns. Hashes are lower-case hex strings, bytes are BINARY; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_int(hex_column: Column) -> Column:
    """The unsigned number of up to 15 hex digits."""
    return F.conv(hex_column, 16, 10).cast("bigint")


def level_byte(level: Column | int) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return F.unhex(F.lpad(F.hex(level.cast("bigint")), 2, "0"))


def hash_one(level: Column | int, a: Column) -> Column:
    return F.sha2(F.concat(level_byte(level), a), 256)


def hash_pair(level: Column | int, a: Column, b: Column) -> Column:
    return F.sha2(F.concat(level_byte(level), a, b), 256)


def hash_pair_swapped(level: Column | int, a: Column, b: Column, swap: Column) -> Column:
    return F.when(swap, hash_pair(level, b, a)).otherwise(hash_pair(level, a, b))


def shard(key_hash: Column) -> Column:
    """One of 16 shards: the first byte times 16 over 256."""
    return F.floor(hex_int(F.substring(key_hash, 1, 2)) / 16).cast("int")


def short_hash(value: Column) -> Column:
    """The first ten bytes of the hash, as hex."""
    return F.substring(F.sha2(value, 256), 1, 20)


def entry_key_hash(key: Column, value: Column) -> Column:
    """Zeros for an empty key; the key's first two bytes and zeros for an empty value; else the key's hash. Both BINARY."""
    return (
        F.when(F.octet_length(key) == 0, F.lit("0" * 64))
        .when(F.octet_length(value) == 0, F.rpad(F.lower(F.hex(F.substring(key, 1, 2))), 64, "0"))
        .otherwise(F.sha2(key, 256))
    )


def little_endian(number: Column, size: int = 8) -> Column:
    """The ``size`` lowest bytes of a LONG, least significant first, as BINARY."""
    text = F.lpad(F.hex(number.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*[F.substring(text, 15 - 2 * k, 2) for k in range(size)]))


def from_little_endian(data: Column, size: int) -> Column:
    """The unsigned number of up to seven little-endian bytes."""
    text = F.hex(data)
    return hex_int(F.concat(*[F.substring(text, 2 * k + 1, 2) for k in range(size - 1, -1, -1)]))


def swap_bytes(hex_column: Column, size: int) -> Column:
    return F.concat(*[F.substring(hex_column, 2 * k + 1, 2) for k in range(size - 1, -1, -1)])
