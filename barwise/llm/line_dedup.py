"""Line dedup by site-relative frequency: a line that fills more than a given part of its host's pages goes.

Lines count once per page. Pairs of host and line combine before the shuffle, so neither a host with a third of
all pages nor a line on every page gathers rows in one task. The lines that exceed the ratio are few per host
by construction: with ratio r and L lines on an average page of the host there are at most L / r. They are
listed per host as 128-bit hashes and joined to the pages by host. Pages are cut into lines once and written, and so is the table
of hosts: with its true size known, it is broadcast where small, else a large host's pages are split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwise.session import materialize

#: A line on more than this part of its host's pages is boilerplate, if it is on so many pages at least.
RATIO, LEAST_PAGES = 0.05, 3
# Elements without text of the page, elements that end a line, and entities.
UNSEEN = r"(?is)<!--.*?-->|<head\b.*?</head\s*>|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
BREAKS = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|html|li|main"
    r"|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>"
)
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&middot;": "·", "&copy;": "©", "&amp;": "&"}
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    """The host in lower case; null where the address has none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def lines_of_html(html: Column) -> Column:
    """The text lines of a page: white space collapsed, empty lines left out; an empty array for null."""
    text = F.regexp_replace(html, UNSEEN, "")
    text = F.regexp_replace(F.regexp_replace(text, r"[\r\n]", " "), BREAKS, "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return lines_of_text(text)


def lines_of_text(text: Column) -> Column:
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\x09-\x0D\x20]+", " ")))
    return F.filter(trimmed, lambda x: x != "")


def _key(line: Column) -> Column:
    return F.md5(F.encode(line, "UTF-8"))


def drop_boilerplate(
    pages: DataFrame,
    lines: Column,
    host: Column,
    page_id: str = "page_id",
    ratio: float = RATIO,
    least_pages: int = LEAST_PAGES,
) -> DataFrame:
    """One row per page: ``page_id, host, host_pages, n_lines, n_dropped, text``, the kept lines joined by line feeds.

    ``lines`` is an array of lines per page. Pages without a host have no site to compare with: they keep
    all lines and ``host_pages`` is null. Repeated page rows count one by one. An empty page gives an empty text.
    """
    cut = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), F.coalesce(lines, F.array().cast("array<string>")).alias("lines"))
    cut = materialize(cut, "page-lines")
    sites = cut.where(F.col("host").isNotNull())
    totals = sites.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    seen = sites.select("host", F.explode(F.array_distinct("lines")).alias("line")).select("host", _key(F.col("line")).alias("key"))
    seen = seen.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    common = seen.join(totals, "host").where(F.col("n") > F.lit(ratio) * F.col("host_pages"))
    common = common.groupBy("host").agg(F.collect_set("key").alias("common"))
    per_host = materialize(totals.join(common, "host", "left"), "host-lines")
    joined = cut.join(per_host, "host", "left")
    kept = F.filter("lines", lambda x: ~F.coalesce(F.array_contains(F.col("common"), _key(x)), F.lit(False)))
    joined = joined.withColumn("kept", F.when(F.col("common").isNull(), F.col("lines")).otherwise(kept))
    return joined.select(
        "page_id",
        "host",
        "host_pages",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"),
    )
