"""The sentences of the reconciliation's reviews, and how a query and its SQL twin fill them in.

A sentence names columns in braces.  A column without a value is said to be "nothing", so that a sentence is never
lost to a null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Why a record is to be reviewed.
REASONS = {
    "team": "the {role} side is called {alpha_name} by alpha and {beta_name} by beta",
    "provisional": "{alpha_name} and {beta_name} play for one side and resemble each other by {method} only",
    "placeholder": "{beta_name} names nobody, or has no side in this match",
    "alpha_only": "no player of beta's squad fits {alpha_name}",
    "beta_only": "no player of alpha's squad fits {beta_name}",
    "market": "quoted in one feed ({method})",
    "score": "two final scores; the one of {chosen} was kept ({basis})",
    "kickoff": "{alpha_kickoff} and {beta_kickoff} are two points in time",
    "stat": "{stat}: {alpha_value} in alpha, {beta_value} in beta",
    "price": "{alpha_price} in alpha, {beta_price} in beta",
}

#: What to do about it.
ACTIONS = {
    "team": "look up both club ids; correct the name, or the role, in the feed that is wrong",
    "provisional": "decide whether both ids mean one person, and note the spelling if they do",
    "placeholder": "find out who is meant from the feed's own pages, else leave the row out",
    "alpha_only": "see whether beta lists this player under another id",
    "beta_only": "see whether alpha lists this player under another id",
    "market": "see whether the other feed sells it under another code",
    "score": "look up the official result",
    "kickoff": "look up the scheduled time",
    "stat": "count again from the match report",
    "price": "no action while the market is open; compare again once it is settled",
}

#: What was chosen meanwhile, where two values compete.
CHOICES = {"score": "{chosen} by {basis}", "kickoff": "alpha's time stands", "stat": "alpha's count stands"}

_SLOT = re.compile(r"\{(\w+)\}")


def sentence(text: str) -> Column:
    """A sentence with the row's values."""
    parts = _SLOT.split(text)
    return F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("nothing")) if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def sentence_sql(text: str) -> str:
    """The same as an expression of SQL."""
    parts = _SLOT.split(text)
    quoted = [f"coalesce({p}::VARCHAR, 'nothing')" if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts) if p]
    return " || ".join(quoted)
