"""Hash functions as column expressions: they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kvlake.model import SLOTS

# The reflected Castagnoli polynomial, and offset and prime of FNV-1a 64.
_CASTAGNOLI = 0x82F63B78
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def crc32c_table() -> list[int]:
    """The byte table of the reflected Castagnoli polynomial."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (_CASTAGNOLI if i & 1 else 0)
        table.append(i)
    return table


def crc32c(key: Column) -> Column:
    """CRC-32C of a binary column, as BIGINT; null for null."""
    table = F.array(*map(F.lit, crc32c_table())).cast("array<bigint>")
    chars = F.split(F.decode(key, "ISO-8859-1"), "")
    ones = F.lit(0xFFFFFFFF).cast("bigint")

    def step(crc: Column, char: Column) -> Column:
        at = crc.bitwiseXOR(F.ascii(char).cast("bigint")).bitwiseAND(F.lit(255).cast("bigint")).cast("int")
        return F.shiftrightunsigned(crc, 8).bitwiseXOR(F.element_at(table, at + 1))

    folded = F.aggregate(chars, ones, step, lambda crc: crc.bitwiseXOR(ones))
    return F.when(F.octet_length(key) == 0, F.lit(0).cast("bigint")).otherwise(folded)


def slot(key: Column) -> Column:
    """Hash slot of a binary key, 0 to 255."""
    return (crc32c(key) % SLOTS).cast("int")


def literal_slot(key: bytes) -> int:
    """Slot of a key known to the driver: lets a point read name its partition."""
    table, crc = crc32c_table(), 0xFFFFFFFF
    for b in key:
        crc = crc >> 8 ^ table[(crc ^ b) & 255]
    return (crc ^ 0xFFFFFFFF) % SLOTS


def fnv1a64(number: Column) -> Column:
    """FNV-1a 64 over the eight little-endian bytes of a BIGINT, as an unsigned DECIMAL(20,0).

    The hash is held in a BIGINT and multiplied in 32-bit halves, so no product overflows: the prime
    is 2**40 + 435.
    """
    long = lambda x: F.lit(x).cast("bigint")
    mask, factor = long(0xFFFFFFFF), long(FNV_PRIME - (1 << 40))

    def step(h: Column, shift: Column) -> Column:
        mixed = h.bitwiseXOR(F.call_function("shiftrightunsigned", number, shift).bitwiseAND(long(255)))
        low = mixed.bitwiseAND(mask)
        product = low * factor
        high = F.shiftrightunsigned(mixed, 32) * factor + F.shiftrightunsigned(product, 32) + F.shiftleft(low, 8)
        return F.shiftleft(high.bitwiseAND(mask), 32).bitwiseOR(product.bitwiseAND(mask))

    start = long(FNV_OFFSET - (1 << 64))
    signed = F.aggregate(F.array(*[F.lit(8 * i) for i in range(8)]), start, step)
    wide = signed.cast("decimal(20,0)")
    return F.when(signed < 0, (wide + F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(wide)


def user_key(number: Column) -> Column:
    """Scrambled workload key: ``user`` and the decimal hash of the record number."""
    return F.concat(F.lit("user"), fnv1a64(number).cast("string"))
