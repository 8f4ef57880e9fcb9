from datetime import datetime, timedelta
from decimal import Decimal

SCHEMA = (
    "uid string, placed_at timestamp, event_at timestamp, bet_type string, match_id long, fixture string, competition string, market string, player string, "
    "selection string, management_unit string, currency string, price decimal(10,3), turnover decimal(18,2), ggr decimal(18,2), net_revenue decimal(18,2), version long, row_key string"
)
START = datetime(2025, 6, 1, 12, 0, 0)


def leg(key, *, uid="7", minutes=0, lead=120, bet_type="SIMPLE", match_id=1, market="1X2", player="P", selection="1", unit="RETA MADRID", currency="EUR", price="2.000", turnover="10.00", ggr="10.00", version=1):
    placed = START + timedelta(minutes=minutes)
    return (
        uid, placed, placed + timedelta(minutes=lead), bet_type, match_id, f"F{match_id}", "C", market, player, selection, unit, currency,
        None if price is None else Decimal(price), Decimal(turnover), Decimal(ggr), Decimal(ggr) * Decimal("0.08"), version, key,
    )


def legs_of(spark, rows):
    from wagerlens.operators.legs import enrich

    return enrich(spark.createDataFrame(rows, SCHEMA))
