"""Line deduplication by frequency within a site.

A page's lines are the runs of its html between tags and line ends, trimmed, without empty ones.  Pages
are grouped by host; a line's ratio is the number of the host's pages that contain it over the host's
number of pages.  Lines over `ratio`, on at least `least_pages` pages, are boilerplate and dropped.

Lines are counted by host and line, once a page, combined before the shuffle.  Each
boilerplate line is on more than `ratio` of its host's pages, so a host has fewer than (mean lines a
page) / ratio of them: the list that travels to a host's pages is bounded, whatever their number.

Defined results: null html has no lines; a url without a host has the host ''; repeated rows and ties of
page_id count as pages of their own; very long pages are cut into lines whole; an empty table gives an empty
result; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def lines_of(html: Column) -> Column:
    runs = F.split(F.regexp_replace(F.coalesce(html, F.lit("")), r"<[^>]*>", "\n"), "\n")
    return F.filter(F.transform(runs, lambda line: F.trim(line)), lambda line: line != "")


def boilerplate(pages: DataFrame, *, ratio: float, least_pages: int) -> DataFrame:
    """Per host that has any: host, drop (its boilerplate lines)."""
    rows = pages.select(host_of(F.col("url")).alias("host"), F.array_distinct(lines_of(F.col("html"))).alias("lines"))
    sites = rows.groupBy("host").agg(F.count("*").alias("pages"))
    counted = (
        rows.select("host", F.explode("lines").alias("line"))
        .groupBy("host", "line")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= least_pages)
    )
    return (
        counted.join(sites, "host")
        .filter(F.col("n") > ratio * F.col("pages"))
        .groupBy("host")
        .agg(F.collect_list("line").alias("drop"))
    )


def line_dedup(pages: DataFrame, *, ratio: float = 0.3, least_pages: int = 3, broadcast_bytes: int = 8_000_000) -> DataFrame:
    """Per page: page_id, host, n_lines, n_dropped, kept_text (lines that stay, one a row)."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), "html")
    # written first: counted, it can be broadcast if small; if not, the join's inputs are plain shuffles, of
    # which Spark splits the pages of a hot host over many tasks
    lists = keep(boilerplate(pages, ratio=ratio, least_pages=least_pages))
    size = lists.agg(F.coalesce(F.sum(F.octet_length(F.array_join("drop", " ")) + 16 * F.size("drop")), F.lit(0)).alias("n")).first()["n"]
    joined = rows.join(F.broadcast(lists) if size <= broadcast_bytes else lists, "host", "left")
    drop = F.coalesce("drop", F.array().cast("array<string>"))
    joined = joined.select("page_id", "host", lines_of(F.col("html")).alias("lines"), drop.alias("drop"))
    kept = F.filter("lines", lambda line: ~F.array_contains(F.col("drop"), line))
    joined = joined.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    return joined.select(
        "page_id",
        "host",
        "n_lines",
        (F.col("n_lines") - F.size("kept")).alias("n_dropped"),
        F.array_join("kept", "\n").alias("kept_text"),
    )


#: The digest columns of the query, in DuckDB's SQL.
LINE_DEDUP_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS xx, page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
         list_filter(list_transform(string_split(regexp_replace(coalesce(html, ''), '<[^>]*>', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM pages),
sites AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
counted AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY host, line),
bad AS (SELECT host, list(line) AS dropped FROM counted JOIN sites USING (host) WHERE n >= 3 AND n > 0.3 * pages GROUP BY host),
kept AS (
  SELECT page_id, host, len(lines)::BIGINT AS n_lines, list_filter(lines, lambda x: NOT coalesce(list_contains(dropped, x), false)) AS k
  FROM p LEFT JOIN bad USING (host))
SELECT page_id, host, n_lines, n_lines - len(k) AS n_dropped, sha256(coalesce(array_to_string(k, chr(10)), '')) AS kept_sha256 FROM kept
"""
