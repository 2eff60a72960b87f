"""Fixed-point and integer functions of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

D38 = "decimal(38,0)"


def to_fixed(x: Column, bits: int = 8) -> Column:
    """Whole units of 2^-bits, the magnitude floored."""
    return (x * float(1 << bits)).cast("bigint")


def from_fixed(x: Column, bits: int = 8) -> Column:
    return x.cast("double") / float(1 << bits)


def truncate(x: Column, bits: int = 8) -> Column:
    """Arithmetic shift: the floor of x / 2^bits."""
    return F.shiftright(x, bits)


def fixed_product(a: Column, b: Column, bits: int = 8) -> Column:
    """The product of two fixed-point numbers, rounded toward zero."""
    p = a * b
    return F.when(p < 0, -F.shiftright(-p, bits)).otherwise(F.shiftright(p, bits))


def normalise(a: Column, b: Column, bits: int = 8) -> Column:
    """floor(a / b * 2^bits) / 2^bits of whole numbers; null for b = 0."""
    return F.floor(F.try_divide(a.cast("double") * float(1 << bits), b.cast("double"))) / float(1 << bits)


def mersenne_mod(k: Column, bits: int) -> Column:
    """k mod 2^bits - 1 by one fold, for 0 <= k < 2^(2 bits)."""
    p = (1 << bits) - 1
    folded = k.bitwiseAND(F.lit(p).cast("long")) + F.shiftrightunsigned(k, bits)
    return F.when(folded >= p, folded - p).otherwise(folded)


def product_mod(x: Column, y: Column, m: Column) -> Column:
    """x * y mod m without overflow, with the sign of the product, as ``%`` has it.

    x, y: whole numbers of up to 38 digits; they are reduced before they are multiplied.
    """
    m = m.cast("decimal(19,0)")
    return ((x.cast(D38) % m) * (y.cast(D38) % m) % m).cast("bigint")


def inverse_mod(a: Column, m: Column, steps: int = 93) -> Column:
    """a^-1 mod m by Euclid's steps; null where there is none.

    steps: the most that two 64-bit numbers need.
    """
    start = F.struct(m.cast("bigint").alias("r0"), F.pmod(a, m).cast("bigint").alias("r1"), F.lit(0).cast("bigint").alias("t0"), F.lit(1).cast("bigint").alias("t1"))

    def step(s: Column, _: Column) -> Column:
        q = F.call_function("div", s["r0"], s["r1"])
        moved = F.struct(s["r1"].alias("r0"), (s["r0"] - q * s["r1"]).alias("r1"), s["t1"].alias("t0"), (s["t0"] - q * s["t1"]).alias("t1"))
        return F.when(s["r1"] == 0, s).otherwise(moved)

    def finish(s: Column) -> Column:
        return F.when(s["r0"] == 1, F.pmod(s["t0"], m).cast("bigint"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, finish)


def factorial(n: Column) -> Column:
    """n!, and 0 for 0; n up to 20."""
    return F.when(n == 0, F.lit(0).cast("bigint")).otherwise(F.factorial(n.cast("int")))


def bit_at(x: Column, i: Column) -> Column:
    return F.getbit(x, i).cast("long")


def unpack_bits(x: Column, n: int) -> Column:
    """The n lowest bits, lowest first."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit(x, i).cast("long"))


def pack_bits(bits: Column) -> Column:
    """The number with these bits, lowest first."""
    terms = F.transform(bits, lambda b, i: F.call_function("shiftleft", b.cast("long"), i))
    return F.aggregate(terms, F.lit(0).cast("long"), lambda acc, t: acc.bitwiseOR(t))


def sign_bit(x: Column) -> Column:
    return (x < 0).cast("long")


def multiplex(x: Column, y: Column, b: Column) -> Column:
    """x where b is 0, y where it is 1."""
    return F.when(b == 0, x).otherwise(y)
