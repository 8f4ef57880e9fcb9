"""Conditions on time that prune the folders of a log by month."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_of(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


_BOUND = re.compile(r"placed_at\s*(>=|<=|>|<|==?)\s*(?:timestamp\s*|date\s*)?('[^']*'|\"[^\"]*\")", re.I)
_RANGE = re.compile(r"placed_at\s+between\s+(?:timestamp\s*|date\s*)?('[^']*')\s+and\s+(?:timestamp\s*|date\s*)?('[^']*')", re.I)
_BRANCHES = re.compile(r"\b(?:or|not|case)\b|\|\||!", re.I)


def _only_ands(plain: str) -> bool:
    """Whether a condition (its literals left out) is comparisons joined by and: its brackets group parts or lists."""
    if _BRANCHES.search(plain):
        return False
    for i, c in enumerate(plain):
        before, after = plain[:i].rstrip(), plain[i + 1 :].lstrip()
        if c == "(" and not (not before or before.endswith("(") or re.search(r"\b(?:and|in)$", before, re.I)):
            return False
        if c == ")" and not (not after or after.startswith(")") or re.match(r"and\b", after, re.I)):
            return False
    return True


def months_of(where: str) -> Column | None:
    """What a condition says about placed_month: the bounds of those of its ANDed parts that compare placed_at with a
    literal.  A condition of another form says nothing; its rows are the same either way."""
    where = _RANGE.sub(r"placed_at >= \1 and placed_at <= \2", where)
    if not _only_ands(re.sub(r"'[^']*'|\"[^\"]*\"", "''", where)):
        return None
    out = None
    for part in re.split(r"\band\b", where, flags=re.I):
        found = _BOUND.fullmatch(part.strip().lstrip("( ").rstrip(") "))
        if found:
            sign, column = found[1], F.col("placed_month")
            least = " - interval 1 microsecond" if sign == "<" else ""  # the first instant of a month needs the one before
            month = month_of(F.expr(f"timestamp {found[2]}{least}"))
            bound = column >= month if ">" in sign else column <= month if "<" in sign else column == month
            out = bound if out is None else out & bound
    return out


def pruned(log: DataFrame, where: str | None) -> DataFrame:
    """The log's rows that satisfy where; its months are pruned by what where says about placed_at."""
    if not where:
        return log
    months = months_of(where) if "placed_month" in log.columns else None
    return log.filter(F.expr(where)) if months is None else log.filter(months).filter(F.expr(where))
