"""Byte and bit layouts as columns: fields as hex digits, bit codes as strings of 0 and 1, and streams built from pieces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def be(value: Column | int, n: int) -> Column:
    """``n`` bytes, highest first, of a number that isn't negative, as hex digits."""
    value = F.lit(value) if isinstance(value, int) else value
    return F.lpad(F.hex(value.cast("long")), 2 * n, "0")


def le(value: Column | int, n: int) -> Column:
    """``n`` bytes, lowest first."""
    value = F.lit(value).cast("long") if isinstance(value, int) else value.cast("long")
    return F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(value, 8 * k).bitwiseAND(255) if 8 * k < 64 else F.lit(0)), 2, "0") for k in range(n)])


def stream(df: DataFrame, keys: Sequence[str], order: Sequence[str], piece: Column, head: str | Column = "", name: str = "data") -> DataFrame:
    """One binary a key: the head, then the pieces (hex digits) in order."""
    pieces = F.transform(F.array_sort(F.collect_list(F.struct(*order, piece.alias("_piece")))), lambda x: x["_piece"])
    head = F.lit(head) if isinstance(head, str) else head
    return df.groupBy(*keys).agg(F.unhex(F.concat(head, F.array_join(pieces, ""))).alias(name))


def binary(value: Column | int, n: int) -> Column:
    """``n`` bits, highest first."""
    value = F.lit(value) if isinstance(value, int) else value
    return F.lpad(F.bin(value.cast("long")), n, "0")


def exp_golomb(value: Column | int) -> Column:
    """The unsigned exponential code: as many zeros as bits follow the leading one of value + 1."""
    value = F.lit(value) if isinstance(value, int) else value
    bits = F.bin(value.cast("long") + 1)
    return F.concat(F.repeat(F.lit("0"), F.length(bits) - 1), bits)


def signed_exp_golomb(value: Column) -> Column:
    return exp_golomb(F.when(value > 0, value * 2 - 1).otherwise(value * -2))


def bytes_of_bits(bits: Column) -> Column:
    """The bits as a binary, filled up with zeros to whole bytes. Their expression is evaluated once: a lambda names its value."""

    def packed(b: Column) -> Column:
        words = F.greatest(F.ceil(F.length(b) / 64), F.lit(1)).cast("int")
        piece = lambda k: F.rpad(F.substr(b, k * 64 + 1, F.lit(64)), 64, F.lit("0"))
        digits = F.transform(F.sequence(F.lit(0), words - 1), lambda k: F.lpad(F.conv(piece(k), 2, 16), 16, F.lit("0")))
        return F.substring(F.unhex(F.array_join(digits, "")), F.lit(1), F.floor((F.length(b) + 7) / 8).cast("int"))

    return F.get(F.transform(F.array(bits), packed), 0)


def field(bits: Column, at: Column | int, n: Column | int) -> Column:
    """``n`` bits from ``at`` (from 0) of a string of bits, as a number; null where the string ends before."""
    lit = lambda v: F.lit(v) if isinstance(v, int) else v
    at, n = lit(at), lit(n)
    return F.when(F.length(bits) >= at + n, F.conv(F.substr(bits, at + 1, n), 2, 10).cast("long"))


def bits_of(data: Column, n_bytes: int) -> Column:
    """The first bytes, at most seven, as bits; fewer if there are fewer."""
    piece = F.substring(data, 1, n_bytes)
    return F.lpad(F.conv(F.hex(piece), 16, 2), F.octet_length(piece) * 8, F.lit("0"))
