"""A collector's run as tables: what became of each factory, which rows are to be written, and the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States of a factory in a run, in the order they are tried, whether its document is there, and what the log says.
STATES = {
    "FAILED_MAPPING": (False, "Failed to resolve consent number via CMS live search"),
    "SKIPPED_DB_EXISTS": (False, None),
    "SUCCESS_CACHED": (True, None),
    "FAILED_SEARCH": (False, "Failed to locate consent row in live MPCB CMS search"),
    "FAILED_RESOLVING": (False, "Failed to resolve direct PDF URL from blockchain document page"),
    "SUCCESS_LIVE": (True, None),
    "FAILED_DOWNLOAD": (False, "Failed to download PDF binary from resolved blockchain link"),
}
KEY = "consent_number"


def run(factories: DataFrame, mapping: DataFrame, existing: DataFrame, cached: DataFrame, found: DataFrame, resolved: DataFrame, fetched: DataFrame) -> DataFrame:
    """(factory_id, consent_number, status): one state for each row of ``factories``.

    Each step takes what it decides out of the rest, by semi- and anti-joins on the number: no number, in the store, in the
    cache, not found on the portal, no link, fetched; what is left could not be fetched.  ``mapping``: factory_id, consent_number (the least one
    counts); the other tables need only the number.  With nothing but a cache, give it for ``cached`` and empty tables for the rest.
    """
    numbers = mapping.filter(F.col(KEY).isNotNull()).groupBy("factory_id").agg(F.min(KEY).alias(KEY))
    rest = factories.select("factory_id").join(numbers, "factory_id", "left")
    out = rest.filter(F.col(KEY).isNull()).withColumn("status", F.lit("FAILED_MAPPING"))
    rest = rest.filter(F.col(KEY).isNotNull())
    for status, table, inside in (("SKIPPED_DB_EXISTS", existing, True), ("SUCCESS_CACHED", cached, True), ("FAILED_SEARCH", found, False), ("FAILED_RESOLVING", resolved, False), ("SUCCESS_LIVE", fetched, True)):
        marks = table.select(KEY).distinct()
        hit, left = (rest.join(marks, KEY, how) for how in (("left_semi", "left_anti") if inside else ("left_anti", "left_semi")))
        out, rest = out.unionByName(hit.withColumn("status", F.lit(status))), left
    return out.unionByName(rest.withColumn("status", F.lit("FAILED_DOWNLOAD"))).select("factory_id", KEY, "status")


def log(states: DataFrame, limits: DataFrame) -> DataFrame:
    """states with pdf_downloaded, tables_detected, limits_extracted and error_message: the rows that a run's log gets.

    ``limits``: extracted rows with consent_number, page_number and table_number; only documents that the run has opened count.
    """
    per = limits.groupBy(KEY).agg(F.count_distinct("page_number", "table_number").alias("tables_detected"), F.count(F.lit(1)).alias("limits_extracted"))
    told = F.create_map(*(x for s, (there, _) in STATES.items() for x in (F.lit(s), F.lit(there))))
    says = F.create_map(*(x for s, (_, text) in STATES.items() for x in (F.lit(s), F.lit(text))))
    rows = states.withColumns({"pdf_downloaded": told[F.col("status")], "error_message": says[F.col("status")]})
    opened = rows.join(per, KEY, "left").withColumns({c: F.when(F.col("pdf_downloaded"), F.coalesce(c, F.lit(0))).otherwise(0).cast("long") for c in ("tables_detected", "limits_extracted")})
    return opened.select("factory_id", KEY, "status", "pdf_downloaded", "tables_detected", "limits_extracted", "error_message")


def new_rows(states: DataFrame) -> DataFrame:
    """The factories whose consents the run writes, and those it has to open."""
    return states.filter(F.col("status").isin(*(s for s, (there, _) in STATES.items() if there)))
