"""Limits out of tables that were extracted from documents: which tables and cells name a parameter, and what the row says about it.

Input is a table as cells; extracting tables from a document is left to whoever reads it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars

#: What names a parameter, as a whole cell or between blanks; cells that only head a column.
PARAMETER_KEYWORDS = [
    "ph", "bod", "cod", "tss", "tds", "oil & grease", "oil and grease", "sulphate", "chloride", "phosphate", "suspended solids", "dissolved solids", "so2", "nox", "particulate matter",
    "spm", "tpm", "ammoniacal nitrogen", "nh3-n", "toc", "temperature", "flow", "quantity of sewage", "trade effluent", "chlorides", "sulphates", "suspended", "dissolved", "ammonia",
]
HEADINGS = ["parameter", "parameters", "parameters/standards"]
#: The unit of water and air limits without one, and how far extracted rows are trusted.
WATER_UNIT, AIR_UNIT, CONFIDENCE = "mg/l", "mg/Nm3", 0.95


def clean(cell: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " "))


def names_parameter(cell: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(cell), F.lit(" ")).rlike(f" (?:{'|'.join(map(re.escape, PARAMETER_KEYWORDS))}) ")


def limit_rows(tables: DataFrame, keys: list[str], cells: str = "cells") -> DataFrame:
    """(keys, row, parameter, minimum_limit, maximum_limit, unit, condition_text, extraction_confidence) from tables of ``cells`` array<array<string>>.

    A table counts if it has two rows or more and any cell names a parameter.  In each row the first naming cell that is no
    heading is the parameter; of the other cells, those with digits give limits (later ones win, bound by bound; the last such cell is the
    condition) and the last unit counts, else the parameter's own cell may have one.  Rows without a limit are left out; limits on
    SO2 and NOx are in mg/Nm3 whatever the row says.  Null cells are empty; a null table has no rows.
    """
    # a row that names a parameter is in a table that does.  What is used several times is bound by explode, else it would be computed as often
    r = tables.filter(F.size(cells) >= 2).select(*keys, F.posexplode(cells).alias("row", "raw"))
    r = r.select(*keys, "row", F.explode(F.array(F.transform("raw", clean))).alias("r"))
    is_name = lambda c: names_parameter(c) & ~F.lower(c).isin(*HEADINGS)
    at = F.array_position(F.transform("r", is_name), F.lit(True)).cast("int")  # from 1; 0 for none
    r = r.select(*keys, "row", "r", F.explode(F.filter(F.array(at), lambda a: a > 0)).alias("at"))
    others = F.filter("r", lambda c, i: (i + 1 != F.col("at")) & (c != ""))
    read = F.transform(others, lambda c: F.struct(F.when(c.rlike(r"\d"), F.struct(c.alias("c"), scalars.limit_range(c).alias("m"))).alias("limit"), scalars.unit(c).alias("unit")))
    r = r.select(*keys, "row", F.get("r", F.col("at") - 1).alias("parameter"), F.explode(F.array(read)).alias("o"))
    last = lambda of: F.try_element_at(F.filter(F.transform("o", of), lambda x: x.isNotNull()), F.lit(-1))
    low, high = last(lambda x: x["limit"]["m"]["low"]), last(lambda x: x["limit"]["m"]["high"])
    unit = F.coalesce(last(lambda x: x["unit"]), scalars.unit(F.col("parameter")), F.lit(WATER_UNIT))
    air = F.lower("parameter").rlike("so2|nox")
    out = r.select(
        *keys, "row", "parameter", low.alias("minimum_limit"), high.alias("maximum_limit"), F.when(air, AIR_UNIT).otherwise(unit).alias("unit"),
        F.coalesce(last(lambda x: x["limit"]["c"]), F.lit("")).alias("condition_text"), F.lit(CONFIDENCE).alias("extraction_confidence"),
    )
    return out.filter("minimum_limit is not null or maximum_limit is not null")
