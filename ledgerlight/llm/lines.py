"""Removal of lines that a site repeats on too many of its pages.

For every site, the pages that hold a line are divided by all its pages. Lines
above the boilerplate ratio are cut from each page of that site.

A site has at most (mean lines per page / ratio) such lines, whatever its size,
so they travel as one array per site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import settle

MAX_RATIO = 0.1
#: A line on one page only is not repeated, whatever the site's size.
MIN_PAGES = 2


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without port; '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1)), F.lit(""))


def html_lines(html: Column) -> Column:
    """Visible text of a page, one line per block element."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->", " ")
    cut = F.regexp_replace(
        bare, r"(?i)</?(?:p|div|li|ul|ol|nav|h[1-6]|br|footer|article|title|header|head|body|html|table|tr)\b[^>]*>", "\n")
    return F.regexp_replace(F.regexp_replace(cut, r"<[^>]*>", ""), r" *\n[ \n]*", "\n")


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate_lines(
    pages: DataFrame, site: str, text: str, *, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, copies: bool = False,
) -> DataFrame:
    """Lines above the ratio: site, line_key, pages, site_pages, ratio.

    Pages with equal text count once, so a group of copies does not turn its own
    lines into boilerplate; with `copies` every page counts, in both numbers. A null
    site is the site ''; a null text is a page without lines. Blank lines never
    count. Lines are compared without spaces at their ends. A line needs at least
    `min_pages` pages.
    """
    rows = pages.select(
        F.coalesce(F.col(site), F.lit("")).alias("site"), F.xxhash64(text).alias("page"), F.col(text).alias("text"))
    pages_of = F.count("*") if copies else F.count_distinct("page")
    sites = rows.groupBy("site").agg(pages_of.alias("site_pages"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _key))
    seen = rows.select("site", "page", F.explode(keys).alias("line_key"))
    counts = seen.groupBy("site", "line_key").agg(pages_of.alias("pages")).filter(F.col("pages") >= min_pages)
    return counts.join(sites, "site").withColumn("ratio", F.col("pages") / F.col("site_pages")).filter(F.col("ratio") > max_ratio)


def drop_site_lines(
    pages: DataFrame, site: str, text: str, *, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, copies: bool = False,
) -> DataFrame:
    """The same rows and columns with boilerplate lines cut from `text`, and a
    column `dropped_lines` with their number (`_` is added to a name that is taken).

    Every row stays, also one whose lines all go (its text is then ''). Null
    texts stay null. Line order stays.
    """
    found = boilerplate_lines(pages, site, text, max_ratio=max_ratio, min_pages=min_pages, copies=copies)
    of, bad, number = (fresh(pages.columns, name) for name in ("_site", "_cut", "dropped_lines"))
    # Written first: where it is small, pages are not shuffled; where not, the join can split a large site's pages.
    cut = settle(found.groupBy(F.col("site").alias(of)).agg(F.collect_list("line_key").alias(bad)))
    joined = pages.join(cut, F.coalesce(F.col(site), F.lit("")) == F.col(of), "left")
    lines = _lines(F.col(text))
    kept = F.filter(lines, lambda x: ~F.array_contains(bad, _key(x)))
    hit = F.col(bad).isNotNull() & F.col(text).isNotNull()
    dropped = F.when(hit, F.size(lines) - F.size(kept)).otherwise(0)
    new = F.when(hit, F.array_join(kept, "\n")).otherwise(F.col(text))
    return joined.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in pages.columns], dropped.alias(number))


def fresh(taken: list[str], name: str) -> str:
    """The name, with `_` added until no column has it."""
    names = {c.lower() for c in taken}
    while name.lower() in names:
        name += "_"
    return name
