"""Comparison of two tables of any size, by key: what one lacks, and values that differ by more than a column's tolerance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .artifacts import MONEY

NUMBERS = (T.NumericType,)


def tolerance(column: str) -> float:
    """A cent for money, rounding for other numbers; a billionth of it more, as cents are no binary fractions."""
    return 0.01 if any(m in column for m in MONEY) else 1e-9


def differences(left: DataFrame, right: DataFrame, keys: list[str], *, ignored: tuple[str, ...] = (), allowed: dict[str, float] | None = None) -> DataFrame:
    """(section, keys, column, left, right): one row a difference.

    section is only_left, only_right, repeated (a key with several rows, on the side that has them) or values.  Null
    equals null, also in keys; numbers are equal within their column's tolerance (allowed, else tolerance()), NaN equals
    NaN; columns that one side lacks are compared as null; ignored columns are not compared.  One join by key.
    """
    allowed = allowed or {}
    kinds = {f.name: f.dataType for f in [*right.schema, *left.schema]}
    columns = sorted(c for c in kinds if c not in (*keys, *ignored))

    def side(df: DataFrame, name: str) -> DataFrame:
        facts = F.struct(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None).cast(kinds[c])).alias(c) for c in columns]) if columns else F.struct(F.lit(1).alias("one"))
        return df.groupBy(*[F.col(f"`{k}`").alias(f"{name}_{i}") for i, k in enumerate(keys)]).agg(F.min(facts).alias(name), F.count("*").alias(f"{name}_n"))

    same = reduce(lambda a, b: a & b, [F.col(f"l_{i}").eqNullSafe(F.col(f"r_{i}")) for i in range(len(keys))])
    both = side(left, "l").join(side(right, "r"), same, "full_outer")
    key = F.struct(*[F.when(F.col("l_n").isNotNull(), F.col(f"l_{i}")).otherwise(F.col(f"r_{i}")).alias(k) for i, k in enumerate(keys)])

    def found(section: str, when: Column, column: str | None = None, a: Column | None = None, b: Column | None = None) -> Column:
        text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
        return F.when(when, F.struct(F.lit(section).alias("section"), F.lit(column).cast("string").alias("column"), text(a).alias("left"), text(b).alias("right")))

    entries = [
        found("only_left", F.col("r_n").isNull(), None, F.col("l_n")), found("only_right", F.col("l_n").isNull(), None, None, F.col("r_n")),
        found("repeated", (F.coalesce("l_n", F.lit(1)) > 1) | (F.coalesce("r_n", F.lit(1)) > 1), None, F.col("l_n"), F.col("r_n")),
    ]
    single = (F.col("l_n") == 1) & (F.col("r_n") == 1)
    for c in columns:
        a, b = F.col(f"l.`{c}`"), F.col(f"r.`{c}`")
        equal = a.eqNullSafe(b)
        if isinstance(kinds[c], NUMBERS):
            x, y = a.cast("double"), b.cast("double")
            equal = equal | F.coalesce(F.abs(x - y) <= allowed.get(c, tolerance(c)) * (1 + 1e-9), F.lit(False))
        entries.append(found("values", single & ~equal, c, a, b))
    rows = both.select(key.alias("key"), F.explode(F.array_compact(F.array(*entries))).alias("e"))
    return rows.select("e.section", *[F.col(f"key.`{k}`").alias(k) for k in keys], "e.column", "e.left", "e.right")


def report(found: DataFrame) -> DataFrame:
    """By section and column, how many differences, and the first of them by its values."""
    return found.groupBy("section", "column").agg(F.count("*").alias("n"), F.min(F.struct("left", "right")).alias("example"))
