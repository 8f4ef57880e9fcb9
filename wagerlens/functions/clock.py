"""Instants, minutes from kick-off and phases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import PHASES


def parse_export_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("dd/MM/yyyy HH:mm:ss"))


def canonical_instant(ts: Column) -> Column:
    """UTC with milliseconds, without a zone: the form that identities use."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS")


def minutes_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(60_000_000.0)


def phase(minutes: Column) -> Column:
    """The phase's label; null minutes have none."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, low, high in PHASES:
        fits = F.lit(True)
        if low is not None:
            fits = fits & (minutes > low if low >= 0 else minutes >= low)
        if high is not None:
            fits = fits & (minutes < high if high < 0 else minutes <= high)
        out = out.when(minutes.isNotNull() & fits, label)
    return out


def version_of_file(path: Column) -> Column:
    """Epoch milliseconds of the stamp '-ddMMyyyy_HHmmss' in a file's name, 0 without one."""
    stamp = F.regexp_extract(path, r"-(\d{8}_\d{6})", 1)
    return F.coalesce(F.unix_millis(F.try_to_timestamp(stamp, F.lit("ddMMyyyy_HHmmss"))), F.lit(0))
