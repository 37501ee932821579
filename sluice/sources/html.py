"""Rows of tables in HTML pages, by expressions; and the inspection schedule that such rows hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars

#: The entities that texts of cells may hold; the ampersand comes last, so nothing is decoded twice.
ENTITIES = [("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]
#: What an inspection row has when its cell does not say.
DEPARTMENT, KIND, STATUS = "MPCB", "Standard", "Scheduled"


def inner_text(html: Column) -> Column:
    """The text of a piece of HTML: white space as one blank, line ends at ``<br>`` and where a block begins or ends, no tags, entities decoded."""
    t = F.regexp_replace(html, r"\s+", " ")
    t = F.regexp_replace(t, r"(?i)</?(?:br|p|div|li)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for entity, plain in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(plain))
    return F.regexp_replace(F.regexp_replace(t, r" *\n[\n ]*", "\n"), r"^\s+|\s+$", "")


def table_rows(pages: DataFrame, keys: list[str], html: str = "html", row: str = "tr", cell: str = "td") -> DataFrame:
    """(keys, row int, cells array<string>): the rows of every page in order, from 0, with the texts of their cells.

    End tags of cells and rows may be missing.  Comments, scripts and styles are no part of a page.  Rows without a cell (headers)
    are left out but keep their number.  Null pages and pages without rows give no rows.
    """
    page = F.regexp_replace(F.col(html), r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "")
    rest = lambda t, tag: F.regexp_replace(t, rf"(?is)</{tag}\b.*$", "")
    pieces = lambda t, tag: F.transform(F.slice(F.split(t, rf"(?i)<{tag}\b[^>]*>"), 2, 1_000_000_000), lambda x: rest(x, tag))
    rows = pages.select(*keys, F.posexplode(pieces(page, row)).alias("row", "_r"))
    rows = rows.select(*keys, "row", F.transform(pieces(F.col("_r"), cell), inner_text).alias("cells"))
    return rows.filter(F.size("cells") > 0)


def inspection_rows(rows: DataFrame, keys: list[str], today: Column | None = None) -> DataFrame:
    """The inspections in ``rows`` (of `table_rows`): 7 cells begin a date, 6 cells share the date of the rows above; other rows are skipped.

    keys, row, factory_name, inspection_date, inspection_type, region, district, midc, officer_name, status, address, inspection_dept,
    contact_details.  A date that cannot be read, and a page's rows before its first date, take ``today`` (the current date if it is not given).
    A page is one window: its rows are in one task, pages are spread.
    """
    today = F.current_date() if today is None else today
    n = F.size("cells")
    at = lambda k: F.get("cells", F.lit(k) - (7 - n))  # noqa: E731  # the same cells, with or without the date before them
    told = F.when(n == 7, F.coalesce(scalars.long_date(F.get("cells", F.lit(1))), today))
    known = rows.filter(n.isin(6, 7)).withColumn("_date", F.last(told, ignorenulls=True).over(W.partitionBy(*keys).orderBy("row").rowsBetween(W.unboundedPreceding, 0)))
    lines = F.filter(F.transform(F.split(at(4), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    officer, address = at(5), at(3)
    return known.select(
        *keys, "row", at(2).alias("factory_name"), F.coalesce("_date", today).alias("inspection_date"), F.coalesce(F.get(lines, F.lit(1)), F.lit(KIND)).alias("inspection_type"), scalars.office(officer).alias("region"),
        scalars.district(address).alias("district"), scalars.industrial_area(address).alias("midc"), F.trim(F.regexp_replace(officer, r"\(.*\)", "")).alias("officer_name"), F.lit(STATUS).alias("status"),
        address.alias("address"), F.coalesce(F.get(lines, F.lit(0)), F.lit(DEPARTMENT)).alias("inspection_dept"), at(6).alias("contact_details"),
    )
