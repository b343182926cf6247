"""The decoder language's operators as Spark columns, equal to the bit: doubles throughout, bits on unsigned 64-bit numbers.

Everything stays in generated JVM code; ANSI mode changes nothing.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockstrata.plans.program import Expr, Num, Op, Var, expression

_TWO63, _TWO64 = 9223372036854775808.0, 18446744073709551616.0


def _double(x: Column) -> Column:
    return x.cast("double")


def truth(x: Column) -> Column:
    """1.0 or 0.0."""
    return F.when(x, F.lit(1.0)).otherwise(F.lit(0.0))


def divide(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(_double(b) == 0, F.lit(0.0)).otherwise(F.try_divide(_double(a), _double(b)))


def to_u64(x: Column) -> Column:
    """The bits of an unsigned number as a long: below 0 and NaN are 0, beyond the range is the largest."""
    x = _double(x)
    low = F.isnan(x) | (x <= 0)
    return F.when(low, F.lit(0)).when(x >= _TWO64, F.lit(-1)).when(x >= _TWO63, (x - _TWO63).cast("long").bitwiseXOR(F.lit(-(1 << 63)))).otherwise(F.when(x < _TWO63, x).otherwise(F.lit(0.0)).cast("long"))


def from_u64(bits: Column) -> Column:
    """A long's bits as an unsigned number, rounded as a double is."""
    high = F.shiftrightunsigned(bits, 1).bitwiseOR(bits.bitwiseAND(F.lit(1)))
    return F.when(bits >= 0, bits.cast("double")).otherwise(high.cast("double") * 2.0)


def bit_and(a: Column, b: Column) -> Column:
    return from_u64(to_u64(a).bitwiseAND(to_u64(b)))


def bit_or(a: Column, b: Column) -> Column:
    return from_u64(to_u64(a).bitwiseOR(to_u64(b)))


def _by(b: Column) -> Column:
    bits = to_u64(b)
    return F.when((bits < 0) | (bits > 63), F.lit(63)).otherwise(bits).cast("int")


def shift_left(a: Column, b: Column) -> Column:
    return from_u64(F.call_function("shiftleft", to_u64(a), _by(b)))


def shift_right(a: Column, b: Column) -> Column:
    return from_u64(F.call_function("shiftrightunsigned", to_u64(a), _by(b)))


_BINARY = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide, "&": bit_and, "|": bit_or, "<<": shift_left, ">>": shift_right,
    "<": lambda a, b: truth(_less(a, b)), "<=": lambda a, b: truth(_less(a, b) | _same(a, b)), ">": lambda a, b: truth(_less(b, a)), ">=": lambda a, b: truth(_less(b, a) | _same(a, b)),
    "==": lambda a, b: truth(_same(a, b)), "!=": lambda a, b: truth(~_same(a, b)), "&&": lambda a, b: truth((a != 0) & (b != 0)), "||": lambda a, b: truth((a != 0) | (b != 0)),
}


def _less(a: Column, b: Column) -> Column:
    return (a < b) & ~F.isnan(a) & ~F.isnan(b)


def _same(a: Column, b: Column) -> Column:
    return (a == b) & ~F.isnan(a) & ~F.isnan(b)


def column(e: Expr | str, variables: Mapping[str, Column]) -> Column:
    """An expression of the decoder language, ``{$a * 2}`` say, over named columns; unknown names are 0."""
    e = expression(e) if isinstance(e, str) else e
    if isinstance(e, Num):
        return F.lit(e.value)
    if isinstance(e, Var):
        return _double(variables[e.name]) if e.name in variables else F.lit(0.0)
    assert isinstance(e, Op)
    args = [column(a, variables) for a in e.args]
    return truth(args[0] == 0) if e.op == "!" else _BINARY[e.op](*args)
