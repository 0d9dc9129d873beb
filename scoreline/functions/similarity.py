"""Fuzzy equality of names."""

from __future__ import annotations

import difflib
import functools
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreline.functions.text import normalize_name

#: Fixed value: the least ratio of two names that count as one.
RATIO = 0.92


@functools.lru_cache(1 << 16)
def similar(a: str | None, b: str | None) -> bool:
    """Equal letters and digits, or a matching-blocks ratio of RATIO at least; the order of a and b can matter."""
    if a is None or b is None:
        return False
    x, y = (re.sub("[^A-Z0-9]", "", s.upper()) for s in (a, b))
    if x == y:
        return True
    # No ratio can exceed twice the shorter length over the sum of both, nor that of the letters that they share.
    match = difflib.SequenceMatcher(None, x, y)
    return 2 * min(len(x), len(y)) >= RATIO * (len(x) + len(y)) and match.quick_ratio() >= RATIO and match.ratio() >= RATIO


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def near_length(x: Column, y: Column) -> Column:
    """Whether no bound by the lengths alone keeps two normalized names apart."""
    return 2 * F.least(F.length(x), F.length(y)) >= F.lit(RATIO) * (F.length(x) + F.length(y))


def undecided(x: Column, y: Column) -> Column:
    """Whether two different normalized names could still reach the ratio, by their lengths and by the letters they share."""
    total = F.length(x) + F.length(y)
    held = lambda name, letter: F.length(name) - F.length(F.replace(name, F.lit(letter), F.lit("")))
    shared = reduce(lambda a, b: a + b, [F.least(held(x, c), held(y, c)) for c in _LETTERS])
    # A matching can't hold more of a letter than either name has.
    return F.when(x.isNull() | y.isNull() | (x == y) | ~near_length(x, y), False).otherwise(2 * shared >= F.lit(RATIO) * total)


def open_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(x, y): the distinct ordered pairs of normalized names in these columns that neither equality nor the bounds settle."""
    each = [df.select(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in pairs]
    return reduce(DataFrame.union, each).distinct().filter(undecided(F.col("x"), F.col("y")))


def with_similar(df: DataFrame, names: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Adds a boolean column for each pair of names: whether they are similar, in this order.

    Equal names and those that their lengths keep apart are settled in the JVM; the others go to Python beside their row, so
    nothing is shuffled by names, of which a few can be those of most rows. A worker remembers the pairs that it met last.
    """

    @F.pandas_udf("boolean")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([similar(x, y) for x, y in zip(left, right)], dtype="bool")

    ratio = ratio.asNondeterministic()  # asked once a row, in no filter again
    pairs = {out: (f"_{k}_x", f"_{k}_y") for k, out in enumerate(names)}
    keyed = df.withColumns({c: normalize_name(side) for out, both in names.items() for c, side in zip(pairs[out], both)})
    unsettled = {out: (F.col(x) != F.col(y)) & near_length(F.col(x), F.col(y)) for out, (x, y) in pairs.items()}
    asked = keyed.withColumns({f"_{k}_near": ratio(F.when(unsettled[out], F.col(f"_{k}_x")), F.when(unsettled[out], F.col(f"_{k}_y"))) for k, out in enumerate(names)})
    found = asked.withColumns({out: F.coalesce(F.col(f"_{k}_x") == F.col(f"_{k}_y"), F.lit(False)) | F.col(f"_{k}_near") for k, out in enumerate(names)})
    return found.drop(*[c for both in pairs.values() for c in both], *[f"_{k}_near" for k in range(len(names))])


def with_same_pair(df: DataFrame, out: str, a1: Column, a2: Column, b1: Column, b2: Column) -> DataFrame:
    """Adds whether both are the same two players, straight or swapped."""
    names = {"_11": (a1, b1), "_22": (a2, b2), "_12": (a1, b2), "_21": (a2, b1)}
    found = with_similar(df, names)
    return found.withColumn(out, (F.col("_11") & F.col("_22")) | (F.col("_12") & F.col("_21"))).drop(*names)


def same_players(a: tuple[str, str], b: tuple[str, str]) -> bool:
    return (similar(a[0], b[0]) and similar(a[1], b[1])) or (similar(a[0], b[1]) and similar(a[1], b[0]))
