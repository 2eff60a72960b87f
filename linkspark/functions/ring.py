"""Arithmetic modulo 2^64 and 2^n on BIGINT columns, without overflow errors.

A BIGINT is read as its two's-complement bits. Sums are made of 32-bit halves,
so no intermediate leaves the range; shifts drop what passes the top. Products
are decimals of 38 digits, one factor in two halves. No Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW = 0xFFFFFFFF


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _low(x: Column) -> Column:
    return x.bitwiseAND(_long(LOW))


def _left(x: Column, n: int) -> Column:
    return F.shiftleft(x, n)


def add(a: Column, b: Column) -> Column:
    low = _low(a) + _low(b)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftright(low, 32)
    return _left(high, 32).bitwiseOR(_low(low))


def negate(a: Column) -> Column:
    return add(F.bitwise_not(a), _long(1))


def subtract(a: Column, b: Column) -> Column:
    low = _low(a) - _low(b)
    high = F.shiftrightunsigned(a, 32) - F.shiftrightunsigned(b, 32) + F.shiftright(low, 32)
    return _left(high, 32).bitwiseOR(_low(low))


def _whole(x: int | Column) -> Column:
    return (F.lit(str(x)) if isinstance(x, int) else x).cast("decimal(38,0)")


def unsigned(x: Column) -> Column:
    """The number from 0 that has x's bits, as a decimal."""
    return F.when(x < 0, _whole(x) + _whole(1 << 64)).otherwise(_whole(x))


def signed(u: Column) -> Column:
    return F.when(u >= _whole(1 << 63), u - _whole(1 << 64)).otherwise(u).cast("long")


def _product(a: Column, b: Column) -> Column:
    """Of unsigned decimals, modulo 2^64: no part has more than 31 digits."""
    half, ring = _whole(1 << 32), _whole(1 << 64)
    low, high = _whole(b % half), _whole(F.call_function("div", b, half))
    return _whole((_whole(a * low) + _whole(_whole(a * high) % half) * half) % ring)


def multiply(a: Column, b: Column) -> Column:
    return signed(_product(unsigned(a), unsigned(b)))


def mask(bits: int) -> Column:
    return _long((1 << bits) - 1 if bits < 64 else -1)


def narrow(x: Column, bits: int) -> Column:
    """x mod 2^bits."""
    return x.bitwiseAND(mask(bits))


def inverse(a: Column) -> Column:
    """a^-1 mod 2^64 of odd numbers by Newton's steps; null for even ones."""
    u = unsigned(a)
    ring = _whole(1 << 64)

    def step(x: Column, _: Column) -> Column:
        return _product(x, _whole((_whole(2) + ring - _product(u, x)) % ring))

    # a is right in 3 bits; each step doubles that: 6, 12, 24, 48, 96
    found = F.aggregate(F.sequence(F.lit(1), F.lit(5)), u, step, signed)
    return F.when(a.bitwiseAND(_long(1)) == 1, found)


def share(value: Column, *key: Column, seed: int = 7) -> tuple[Column, Column]:
    """Two columns that add up to ``value``: a hash of seed and key, and the rest."""
    r = F.xxhash64(F.lit(seed), *key)
    return r, subtract(value, r)


def xor_share(value: Column, *key: Column, seed: int = 7) -> tuple[Column, Column]:
    r = F.xxhash64(F.lit(seed), *key)
    return r, value.bitwiseXOR(r)
