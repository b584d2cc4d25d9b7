"""Seeded random numbers as column expressions.

Each number is taken from the md5 of its own key (seed, row id, …), so it does not depend on partitioning, task
retries or row order, and any engine with md5 can repeat it. One digest holds four independent 32-bit words.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = 2.0**32
# A rejected attempt has probability below 0.05 for every shape above 1: twelve in a row, below 1e-15.
ATTEMPTS = 12


def digest(*parts) -> Column:
    """md5 of the parts joined by a colon; plain values are taken as literals."""
    columns = [part if isinstance(part, Column) else F.lit(part) for part in parts]
    return F.md5(F.concat_ws(":", *[column.cast("string") for column in columns]))


def uniform(hashed: Column, word: int = 0) -> Column:
    """A number strictly between 0 and 1 from one word of a digest."""
    number = F.conv(F.substring(hashed, 8 * word + 1, 8), 16, 10).cast("double")
    return (number + 0.5) / F.lit(WORDS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def normal(hashed: Column) -> Column:
    """Standard normal by Box–Muller from words 0 and 1."""
    radius = F.sqrt(-2.0 * F.log(uniform(hashed, 0)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(hashed, 1))


def log_gamma_draw(shape: Column, *key) -> Column:
    """Logarithm of a Gamma(shape, 1) draw for any shape above zero.

    Marsaglia and Tsang's method (2000) for shape + 1, then the power-of-uniform boost, kept in log space because
    tiny shapes underflow otherwise. Attempts after the accepted one are not evaluated.
    """

    def attempt(number: Column, d: Column) -> Column:
        def accepted(hashed: Column, x: Column, v: Column) -> Column:
            bound = 0.5 * x * x + d - d * v + d * F.log(v)
            drawn = F.log(d) + F.log(v) + F.log(uniform(hashed, 3)) / shape
            return F.when((v > 0) & (F.log(uniform(hashed, 2)) < bound), drawn)

        return let(
            digest(*key, number),
            lambda hashed: let(
                normal(hashed),
                lambda x: let(F.pow(1.0 + x / F.sqrt(9.0 * d), F.lit(3.0)), lambda v: accepted(hashed, x, v)),
            ),
        )

    def first_accepted(d: Column) -> Column:
        numbers = F.array(*[F.lit(number) for number in range(ATTEMPTS)])
        nothing = F.lit(None).cast("double")
        found = F.aggregate(numbers, nothing, lambda found, number: F.coalesce(found, attempt(number, d)))
        return F.coalesce(found, F.raise_error(F.lit("no gamma attempt was accepted")).cast("double"))

    return let(shape + F.lit(1.0 - 1.0 / 3.0), first_accepted)


# P(X <= k) of a Poisson variable of mean 1; what lies beyond is less likely than one step of a 32-bit word.
POISSON_ONE = [sum(1 / math.factorial(i) for i in range(k + 1)) / math.e for k in range(12)]


def poisson_one(number: Column) -> Column:
    """A Poisson count of mean 1 from a uniform number, by inversion."""
    return let(number, lambda u: sum((F.when(u > limit, 1).otherwise(0) for limit in POISSON_ONE), F.lit(0)))
