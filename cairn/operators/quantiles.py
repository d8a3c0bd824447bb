"""Exact quantiles by selection: a sketch brackets each wanted rank, a second scan looks inside the brackets.

The first scan makes a mergeable sketch for each key and takes, around every share, two values whose
ranks certainly lie on either side. The second counts what is below and at the ends of a bracket and
gathers what is inside, some thousandths of a key's rows. Brackets that would hold more than ``LIMIT`` values are
narrowed by another sketch of their inside first. No scan shuffles values: tasks send sketches, counts
and the inside of brackets. So one key may hold all rows, and equal values, however many, are one count.

Quantiles are interpolated between the two rows around (n - 1) * share. Nulls don't count; a key without values is absent.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cairn.runtime import materialize

ACCURACY, MARGIN = 10_000, 3.0
LIMIT = 100_000
#: Cuts of a bracket that is narrowed.
CUTS = 200


def _joined(x: DataFrame, told: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``x`` with what is told of its keys (a row for each); Spark broadcasts a small table by its size."""
    own = told.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return x.join(own, same).drop(*(f"_of_{k}" for k in keys))


def _inside(i: int) -> Column:
    return (F.col("_x") > F.get("low", F.lit(i))) & (F.col("_x") < F.get("high", F.lit(i)))


def _counts(i: int) -> dict[str, Column]:
    low, high, x = F.get("low", F.lit(i)), F.get("high", F.lit(i)), F.col("_x")
    return {
        "below": F.count_if(x < low), "at_low": F.count_if(x == low), "at_high": F.count_if((x == high) & (high > low)),
        "under": F.max(F.when(x < low, x)), "over": F.min(F.when(x > high, x)),
    }


def _slack(accuracy: int) -> int:
    return 2 + math.ceil(CUTS * MARGIN / accuracy)


def _narrowed(x: DataFrame, brackets: DataFrame, keys: Sequence[str], shares: Sequence[float], accuracy: int) -> DataFrame:
    """Brackets around the same ranks, with ``_slack`` cuts of their inside to either side."""
    spare = _slack(accuracy)
    grid = F.array(*(F.lit(j / CUTS) for j in range(CUTS + 1)))
    made = {}
    for i in range(len(shares)):
        inner = F.when(_inside(i), F.col("_x"))
        made |= {f"s{i}": F.percentile_approx(inner, grid, accuracy), f"c{i}": F.count(inner), f"b{i}": F.count_if(F.col("_x") <= F.get("low", F.lit(i)))}
    got = _joined(x, brackets, keys).groupBy(*keys, "n", "low", "high").agg(*(c.alias(n) for n, c in made.items()))
    low, high = [], []
    for i, p in enumerate(shares):
        cut, many = F.col(f"s{i}"), F.col(f"c{i}") > CUTS
        at = (F.col("n") - 1) * p - F.col(f"b{i}")
        step = F.try_divide(at, F.col(f"c{i}")) * CUTS
        one, two = (F.floor(step) - spare).cast("int"), (F.ceil(step) + spare).cast("int")
        low.append(F.when(many & (one >= 0) & (one <= CUTS), F.get(cut, one)).otherwise(F.get("low", F.lit(i))))
        high.append(F.when(many & (two >= 0) & (two <= CUTS), F.get(cut, two)).otherwise(F.get("high", F.lit(i))))
    return materialize(got.select(*keys, "n", F.array(*low).alias("low"), F.array(*high).alias("high")), "brackets")


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], accuracy: int = ACCURACY, limit: int = LIMIT, margin: float = MARGIN) -> DataFrame:
    """(keys..., n, q): for each key its values' number and the quantiles at ``shares``, as an array."""
    alone = not keys
    x = rows.where(F.col(value).isNotNull()).select(*(keys or [F.lit(0).alias("_all")]), F.col(value).cast("double").alias("_x"))
    keys = list(keys) or ["_all"]
    reach = margin / accuracy
    marks = [max(p - reach, 0.0) for p in shares] + [min(p + reach, 1.0) for p in shares]
    sketch = x.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("_x", F.array(*map(F.lit, marks)), accuracy).alias("e"), F.min("_x").alias("least"), F.max("_x").alias("most"))
    end = lambda i, mark, out: F.col(out) if mark in (0.0, 1.0) else F.get("e", F.lit(i))
    k = len(shares)
    low = F.array(*(end(i, marks[i], "least") for i in range(k)))
    high = F.array(*(end(k + i, marks[k + i], "most") for i in range(k)))
    brackets = materialize(sketch.select(*keys, "n", low.alias("low"), high.alias("high")), "brackets")
    largest = brackets.agg(F.max("n")).first()[0] or 0
    inside = largest * min(1.0, 2 * (reach + 1 / accuracy))
    while inside > limit:
        brackets = _narrowed(x, brackets, keys, shares, accuracy)
        inside *= min(0.9, (2 * _slack(accuracy) + 2) / CUTS)
    made = {}
    for i in range(k):
        made |= {f"{n}{i}": c for n, c in _counts(i).items()} | {f"inner{i}": F.array_sort(F.collect_list(F.when(_inside(i), F.col("_x"))))}
    found = _joined(x, brackets, keys).groupBy(*keys, "n", "low", "high").agg(*(c.alias(n) for n, c in made.items()))

    def ranked(i: int, r: Column) -> Column:
        below, at_low, at_high = (F.col(f"{n}{i}") for n in ("below", "at_low", "at_high"))
        inner = F.col(f"inner{i}")
        first = below + at_low
        last = first + F.size(inner)
        return (
            F.when(r == below - 1, F.col(f"under{i}")).when(r < below - 1, F.lit(None))
            .when(r < first, F.get("low", F.lit(i))).when(r < last, F.get(inner, (r - first).cast("int")))
            .when(r < last + at_high, F.get("high", F.lit(i))).when(r == last + at_high, F.col(f"over{i}"))
        )

    out = []
    for i, p in enumerate(shares):
        at = (F.col("n") - 1) * F.lit(float(p))
        a, b = ranked(i, F.floor(at)), ranked(i, F.ceil(at))
        out.append(F.when(a == b, a).otherwise((F.ceil(at) - at) * a + (at - F.floor(at)) * b))
    result = materialize(found.select(*keys, "n", F.array(*out).alias("q")), "quantiles")
    if limit < 2**62 and result.where(F.exists("q", F.isnull)).limit(1).count():  # a sketch was farther off than it promises
        result = exact_quantiles(x, keys, "_x", shares, accuracy, limit if margin < accuracy else 2**62, min(max(margin, 1) * 16, accuracy))
    return result.drop("_all") if alone else result
