"""Counter-based noise as column expressions.

A draw belongs to its counter (seed, row, epoch, expert) and to nothing else, so
it does not depend on partitioning or on re-execution, and any engine with
64-bit bit operations can reproduce it.  The generator is the splitmix64
finaliser.  Products modulo 2^64 are taken over 16-bit limbs: every partial sum
fits a bigint, so nothing overflows under ANSI arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The odd constants of the generator and of its counters.
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB
SEED_STEP = 0x9E3779B97F4A7C15
EPOCH_STEP = 0xD1B54A32D192ED03
ROW_STEP = 0x8CB92BA72F3D8DD7
EXPERT_STEP = 0xABC98388FB8FAC03
EPS = 1e-8  # fixed value: Gumbel epsilon

_ALL = (1 << 64) - 1


def _signed(value: int) -> int:
    value &= _ALL
    return value - (1 << 64) if value >> 63 else value


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mul64(x: Column, c: int) -> Column:
    """``x * c`` modulo 2^64."""
    low = F.lit(0xFFFF).cast("bigint")
    limb = [F.shiftrightunsigned(x, 16 * i).bitwiseAND(low) for i in range(4)]
    by = [F.lit((c >> 16 * i) & 0xFFFF).cast("bigint") for i in range(4)]
    out, carry = None, None
    for k in range(4):
        column = sum((limb[i] * by[k - i] for i in range(1, k + 1)), limb[0] * by[k])
        if carry is not None:
            column = column + F.shiftrightunsigned(carry, 16)
        part = F.shiftleft(column.bitwiseAND(low), 16 * k)
        out = part if out is None else out.bitwiseOR(part)
        carry = column
    return out


def add64(x: Column, y: Column) -> Column:
    """``x + y`` modulo 2^64."""
    low = F.lit(0xFFFFFFFF).cast("bigint")
    first = x.bitwiseAND(low) + y.bitwiseAND(low)
    upper = F.shiftrightunsigned(x, 32) + F.shiftrightunsigned(y, 32) + F.shiftrightunsigned(first, 32)
    return F.shiftleft(upper, 32).bitwiseOR(first.bitwiseAND(low))


def mix64(x: Column) -> Column:
    step = lambda shift, c: lambda z: mul64(z.bitwiseXOR(F.shiftrightunsigned(z, shift)), c)
    return _let(_let(_let(x, step(30, MIX_1)), step(27, MIX_2)), lambda z: z.bitwiseXOR(F.shiftrightunsigned(z, 31)))


def uniform(seed: int | Column, row_id: Column, epoch: int, n_experts: Column) -> Column:
    """Array of draws in [0, 1), one per expert 0..n_experts-1 of a row."""
    start = (
        F.lit(_signed(seed * SEED_STEP + (epoch + 1) * EPOCH_STEP)) if isinstance(seed, int)
        else add64(mul64(seed.cast("bigint"), SEED_STEP), F.lit(_signed((epoch + 1) * EPOCH_STEP)))
    ).cast("bigint")
    row = mix64(add64(start, mul64(row_id.cast("bigint"), ROW_STEP)))
    draw = lambda of_row: lambda k: F.shiftrightunsigned(mix64(add64(of_row, mul64(k.cast("bigint"), EXPERT_STEP))), 11).cast("double") / F.lit(float(1 << 53))
    return _let(row, lambda z: F.transform(F.sequence(F.lit(0), n_experts - 1), draw(z)))


def gumbel(u: Column) -> Column:
    return -F.log(-F.log(u + F.lit(EPS)) + F.lit(EPS))
