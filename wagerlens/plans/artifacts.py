"""Reports: small result frames as JSON values, with a hash, truncation accounts, invariants and comparison.

Only results of a stated size come to the driver: aggregates by a few keys, and tables cut to their limit.
"""

from __future__ import annotations

import hashlib
import json
import math
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import invariants

MONEY = ("turnover", "ggr", "stake", "amount", "net_revenue", "unresolved_units", "by_currency")


def plain(value, key: str = ""):
    """Any value as JSON has it: no NaN or infinity, dates as text, money at 2 decimals, other numbers at 4."""
    if value is None or isinstance(value, (str, bool, int)):
        return value
    if isinstance(value, (float, Decimal)):
        number = float(value)
        return round(number, 2 if any(m in key for m in MONEY) else 4) if math.isfinite(number) else None
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, dict):
        return {str(k): plain(v, key if key in MONEY else str(k)) for k, v in sorted(value.items(), key=lambda x: str(x[0]))}
    if hasattr(value, "asDict"):
        return {k: plain(v, k) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [plain(v, key) for v in value]
    return str(value)


#: Most rows of a table in a report; what is longer is cut in a stated order, with an account.
LONGEST = 5000


def rows_of(df: DataFrame, limit: int = LONGEST) -> list[dict]:
    """The rows of a report, in the order of all their columns; a table over its limit is an error."""
    rows = [plain(r) for r in df.limit(limit + 1).collect()]
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows; cut it with truncate()")
    return sorted(rows, key=lambda r: json.dumps(r, sort_keys=True, default=str))


def truncate(df: DataFrame, order: list[Column], limit: int, *, stake: str | None = None) -> tuple[list[dict], dict]:
    """The first rows in an order, and an account of what was left out: rows, and stake if named."""
    shown = [plain(r) for r in df.orderBy(*order).limit(limit).collect()]
    totals = df.agg(F.count("*").alias("total"), *([F.sum(stake).alias("stake")] if stake else [])).first()
    account = {"total": totals["total"], "shipped": len(shown), "omitted": totals["total"] - len(shown)}
    if stake:
        account["omitted_stake"] = plain(float(totals["stake"] or 0) - sum(float(r[stake] or 0) for r in shown), "stake")
    return shown, account


def cut(**tables: tuple) -> dict:
    """The first rows of each table (rows, order, limit), and under truncation an account of what each leaves out."""
    made = {name: truncate(df, order, limit) for name, (df, order, limit) in tables.items()}
    return {name: shown for name, (shown, _) in made.items()} | {"truncation": {name: account for name, (_, account) in made.items()}}


def payload_hash(value) -> str:
    """First 16 digits of the SHA-256 of the value's JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=True, allow_nan=False).encode()).hexdigest()[:16]


def envelope(name: str, data, meta: dict) -> dict:
    data = plain(data)
    return {"artifact": name, "hash": payload_hash(data), "meta": plain(meta), "data": data}


def read_artifacts(folder: str) -> dict:
    """All artifacts of a folder by name, without their envelopes."""
    found = {p.stem: json.loads(p.read_text(encoding="utf-8")) for p in sorted(Path(folder).glob("*.json"))}
    return {name: value["data"] if isinstance(value, dict) and "data" in value else value for name, value in found.items()}


def dataset_fingerprint(raw: DataFrame) -> str:
    """A digest of the input's file names and sizes; raw is read from files."""
    files = raw.select("_metadata.file_name", "_metadata.file_size").distinct()
    digest = F.sum(F.xxhash64("file_name", "file_size").cast("decimal(38,0)"))
    return hashlib.sha256(str(files.agg(digest, F.count("*")).first()).encode()).hexdigest()[:16]


def resolve_ref(payload: dict, ref: str):
    """'section/table#key=value' to the rows of that table with that value."""
    path, _, test = ref.partition("#")
    rows = payload
    for part in path.split("/"):
        rows = rows[part]
    if not test:
        return rows
    key, _, wanted = test.partition("=")
    return [r for r in rows if str(r.get(key)) == wanted]


def money_shape(value, path: str = "") -> list[str]:
    """Paths at which an amount stands outside a currency."""
    bad = []
    if isinstance(value, dict):
        for k, v in value.items():
            here = f"{path}/{k}"
            if k in ("turnover", "ggr", "net_revenue", "amount") and isinstance(v, (int, float)) and "currency" not in value:
                bad.append(here)
            bad += money_shape(v, here)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            bad += money_shape(v, f"{path}[{i}]")
    return bad


def check_invariants(payload: dict) -> list[str]:
    """What a payload of overview, flow, prices and sharp must satisfy; the failures as text.

    Legs and betslips are conserved by every breakdown and by the phases, money stands under a currency,
    pre-match, eligible and in-play legs add up, rates are of their counts, each flagged window passes the gate,
    the hash is of the data.
    """
    failures = [f"money outside a currency: {p}" for p in money_shape({k: v["data"] for k, v in payload.items()})]
    for name, artifact in payload.items():
        if artifact["hash"] != payload_hash(artifact["data"]):
            failures.append(f"{name}: the hash is not of its data")
    universe = payload["overview"]["data"]["universe"][0] if "overview" in payload else None
    for name, table in (payload["flow"]["data"].items() if universe and "flow" in payload else []):
        if not isinstance(table, dict):
            continue
        legs = sum(r["legs"] for r in table["rows"])
        wanted = universe["betslips"] if name in ("by_region", "by_bet_type") else universe["legs"]
        if legs != wanted and name not in ("by_selection", "by_player"):
            failures.append(f"{name}: {legs} rows counted, {wanted} exist")
    if "prices" in payload and universe:
        failures += invariants.of_prices(payload["prices"]["data"]["coverage"][0])
    if "sharp" in payload:
        data, covered = payload["sharp"]["data"], payload.get("prices", {}).get("data", {}).get("coverage", [None])
        failures += invariants.of_sharp(data["report"][0], covered[0], data["flagged"], data["truncation"]["flagged"])
    return failures


def compare(a, b, path: str = "") -> list[str]:
    """Differences of two payloads: keys on one side, and values; money within a cent, others within 1e-9."""
    if isinstance(a, dict) and isinstance(b, dict):
        out = [f"{path}/{k}: on one side only" for k in sorted(a.keys() ^ b.keys())]
        for k in sorted(a.keys() & b.keys()):
            out += compare(a[k], b[k], f"{path}/{k}")
        return out
    if isinstance(a, list) and isinstance(b, list):
        if len(a) != len(b):
            return [f"{path}: {len(a)} and {len(b)} rows"]
        return [x for i, (p, q) in enumerate(zip(a, b, strict=True)) for x in compare(p, q, f"{path}[{i}]")]
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        allowed = 0.01 if any(m in path.rpartition("/")[2] for m in MONEY) else 1e-9
        return [] if abs(a - b) <= allowed else [f"{path}: {a} and {b}"]
    return [] if a == b else [f"{path}: {a!r} and {b!r}"]
