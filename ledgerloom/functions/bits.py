"""Bit arithmetic of task numbers, Bloom slices, dust and tree levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import hex_int

#: Bits of the index in a task number, flag of a block's last task, Bloom functions and bits of one.
TASK_BITS, END_FLAG, PROBES, PROBE_BITS = 24, 1 << 63, 5, 11
#: Leaves of a twig and the level of twig roots.
TWIG_SHIFT, TWIG_LEVEL = 11, 12


def task_id(height: Column, index: Column) -> Column:
    return F.shiftleft(height.cast("bigint"), TASK_BITS) + index


def task_height(task: Column) -> Column:
    return F.shiftright(task, TASK_BITS)


def task_index(task: Column) -> Column:
    return task.bitwiseAND(F.lit((1 << TASK_BITS) - 1))


def probes(short: Column) -> list[Column]:
    """Bit positions of the Bloom functions: successive 11-bit slices, from the lowest, of the hash's first eight bytes."""
    high, low = hex_int(F.substring(short, 1, 8)), hex_int(F.substring(short, 9, 8))
    mask = F.lit((1 << PROBE_BITS) - 1)
    out = []
    for k in range(PROBES):
        shift = PROBE_BITS * k
        if shift + PROBE_BITS <= 32:
            bits = F.shiftright(low, shift)
        elif shift >= 32:
            bits = F.shiftright(high, shift - 32)
        else:
            bits = F.shiftright(low, shift).bitwiseOR(F.shiftleft(high, 32 - shift))
        out.append(bits.bitwiseAND(mask))
    return out


def bit_length(number: Column) -> Column:
    return F.when(number == 0, F.lit(0)).otherwise(F.length(F.bin(number)))


def dust_shift(dust: Column) -> Column:
    """How far a dust amount is shifted so that 48 bits are left."""
    return F.greatest(F.lit(0), bit_length(dust) - 48)


def max_level(youngest_twig: Column) -> Column:
    return F.lit(TWIG_LEVEL) + bit_length(youngest_twig)


def compactible(active: Column, sn_start: Column, sn_end: Column, threshold: int, ratio: int, div: int) -> Column:
    """Enough active entries, and not so many that they exceed ratio/div of all."""
    return (active >= threshold) & ~((sn_end - sn_start) * ratio < active * div)
