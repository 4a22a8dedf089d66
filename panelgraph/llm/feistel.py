"""Keyed permutations of [0, n) as Spark column expressions.

A number below a*b is split into digits (l, r) of the mixed radix (a, b). Every round adds a
keyed hash of one digit to the other one, modulo that one's radix, so each round and hence the
whole is a bijection on [0, a*b). Numbers that land at n or above walk on along their cycle
until they are below n, which keeps the map a bijection on [0, n).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelgraph.llm.common import hash_long

ROUNDS = 6
#: Steps a number may walk. A cycle leaves [0, n) at most a*b - n < a times, so for n up to
#: WALK**2 this always suffices; beyond, a step fails with probability below 1/WALK.
WALK = 64


def permute(x: Column, a: Column, b: Column, key: str) -> Column:
    """A keyed bijection on [0, a*b); x, a and b are bigint. Null in, null out.

    The rounds run inside aggregate(), which keeps the expression as long as one round.
    """
    state = F.struct(((x - x % b) / b).cast("long").alias("l"), (x % b).alias("r"))

    def one(s: Column, k: Column) -> Column:
        even = k % 2 == 0
        return F.struct(
            F.when(even, (s["l"] + hash_long(key, k, s["r"])) % a).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise((s["r"] + hash_long(key, k, s["l"])) % b).alias("r"),
        )

    return F.aggregate(F.array(*[F.lit(k) for k in range(ROUNDS)]), state, one, lambda s: s["l"] * b + s["r"])


def permute_below(x: Column, n: Column, a: Column, b: Column, key: str) -> Column:
    """A keyed bijection on [0, n) by cycle walking; a*b >= n. Raises if a walk is too long."""
    first = permute(x, a, b, key)
    walk = F.aggregate(
        F.array_repeat(F.lit(0), WALK),
        first,
        lambda s, _: F.when(s < n, s).otherwise(permute(s, a, b, key)),
        lambda s: F.when(s < n, s).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long")),
    )
    return F.when(x < n, walk)


def sides(n: int) -> tuple[int, int]:
    """Radices a <= b with a*b >= n and a*b - n < b, as near to square as that allows."""
    b = max(1, int(n**0.5))
    while b * b < n:
        b += 1
    return max(1, -(-n // b)), b
