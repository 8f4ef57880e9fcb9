"""Sentences of reviews: a query's and its SQL twin's words are the same, nulls included."""

import duckdb
import pytest

from wagerlens.functions import wording

NAMES = ("role", "alpha_name", "beta_name", "method", "chosen", "basis", "alpha_kickoff", "beta_kickoff", "stat", "alpha_value", "beta_value", "alpha_price", "beta_price")


@pytest.mark.parametrize("table", ["REASONS", "ACTIONS", "CHOICES"])
def test_a_sentence_is_never_lost(spark, table):
    texts = getattr(wording, table)
    row = {n: None if i % 3 == 0 else f"it's {n}" for i, n in enumerate(NAMES)}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} string" for n in NAMES))
    got = df.select(*[wording.sentence(t).alias(k) for k, t in texts.items()]).first().asDict()
    cells = ", ".join(f"CAST(? AS VARCHAR) AS {n}" for n in NAMES)
    wanted = duckdb.connect().execute(f"SELECT {', '.join(f'{wording.sentence_sql(t)} AS {k}' for k, t in texts.items())} FROM (SELECT {cells})", list(row.values())).fetchone()
    assert tuple(got.values()) == wanted and all("{" not in v for v in wanted)
    filled = {k: t.format(**{n: v or "nothing" for n, v in row.items()}) for k, t in texts.items()}
    assert got == filled
