"""Web page sources: titles, links and crawl scope, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def title(html: Column, url: Column) -> Column:
    """Text of <title>, else the path of the URL."""
    t = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.coalesce(F.nullif(t, F.lit("")), F.regexp_extract(url, r"^[^:]+://[^/]+([^?#]*)", 1))


def links(pages: DataFrame) -> DataFrame:
    """page_id, url, link: absolute form of every <a href>, fragments dropped (root-relative and absolute forms)."""
    href = F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^>]*href=\"([^\"#]+)"), F.lit(1))
    rows = pages.select("page_id", "url", F.explode(href).alias("h"))
    base = F.regexp_extract("url", r"^([a-zA-Z]+://[^/?#]+)", 1)
    return rows.select("page_id", "url", F.when(F.col("h").rlike("^[a-zA-Z]+://"), F.col("h")).when(F.col("h").startswith("/"), F.concat(base, "h")).otherwise(F.concat(base, F.lit("/"), "h")).alias("link"))


def in_scope(url: Column, base: Column) -> Column:
    """Same scheme and host, and a path below the base's path."""
    origin = r"^([a-zA-Z]+://[^/?#]+)"
    path = r"^[a-zA-Z]+://[^/?#]+([^?#]*)"
    return (F.regexp_extract(url, origin, 1) == F.regexp_extract(base, origin, 1)) & F.startswith(F.regexp_extract(url, path, 1), F.regexp_replace(F.regexp_extract(base, path, 1), "[^/]*$", ""))
