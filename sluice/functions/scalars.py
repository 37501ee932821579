"""Text, date and lookup functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The units that limits come in, by what their text holds; the first that fits counts.
UNITS = [("mg/Nm3", r"mg/\s*nm[3³]"), ("mg/l", r"mg/\s*l"), ("pH", "ph"), ("KLD", "kld"), ("ppm", "ppm"), ("kg/day", r"kg/\s*day")]
#: Words that say nothing about which company a name means, in keyword searches and in matching two names.
STOP_WORDS = ["pvt", "ltd", "private", "limited", "industries", "chemical", "chemicals", "india", "co", "company", "corp", "corporation", "unit", "and", "sons", "export"]
COMMON_WORDS = [
    "limited", "private", "ltd", "pvt", "corp", "co", "india", "pharmaceuticals", "pharmaceutical", "chemicals", "chemical", "industries", "industry", "company",
    "sciences", "science", "labs", "laboratories", "laboratory", "m/s", "unit", "formerly", "known", "know", "as", "formarly", "formaly",
]
#: What the quality codes of scraped cells mean.
QUALITY_NAMES = {
    "U": "Raw", "V": "Validated", "E": "Error", "O": "Out of Range", "N": "Negative", "I": "Invalid", "M": "Maintenance",
    "C": "Span Calibration", "Z": "Zero Calibration", "X": "Expected Calibration", "Y": "Dynamic Limit", "input": "Manual Input",
}


def standard_parameter(name: Column) -> Column:
    """A free-text parameter's standard id; the order of the rules matters, null if none fits."""
    n = F.lower(F.trim(name))
    return (
        F.when(n.isin("ph", "ph value"), "ETP-pH")
        .when(n.contains("trade effluent") | n.contains("flow"), "ETP-Flow")
        .when(n.contains("bod"), "ETP-BOD")
        .when(n.contains("cod"), "ETP-COD")
        .when(n.contains("tss") | n.contains("suspended solid"), "ETP-TSS")
    )


def name_tokens(name: Column, least: int = 3) -> Column:
    """Distinct lower-case keywords of a name: without a leading "M/s", what stands in brackets, short and meaningless words."""
    bare = F.regexp_replace(F.regexp_replace(name, r"(?i)^m/s\.?\s*", ""), r"\(.*?\)", "")
    words = F.split(F.trim(F.regexp_replace(F.lower(F.regexp_replace(bare, r"[^a-zA-Z0-9\s]", " ")), r"\s+", " ")), " ")
    return F.array_except(F.filter(words, lambda w: F.length(w) >= least), F.array(*map(F.lit, STOP_WORDS)))


def plain_name(name: Column) -> Column:
    """A name as it is compared with others: lower case, without "m/s", dots and commas, hyphens as blanks."""
    return F.trim(F.replace(F.regexp_replace(F.replace(F.lower(name), F.lit("m/s"), F.lit("")), r"[.,]", ""), F.lit("-"), F.lit(" ")))


def plain_tokens(name: Column, least: int = 3) -> Column:
    """The words of a plain name that say which company it is, in order and as often as they occur."""
    words = F.split(plain_name(name), r"\s+")
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*COMMON_WORDS))


def cell(text: Column) -> Column:
    """struct<value, code> of a cell such as ``[37.61, 'U']``; null if it is none: other than two parts, no number, ``'NA'``."""
    parts = F.split(F.regexp_replace(F.trim(text), r"^[\[\]]+|[\[\]]+$", ""), ",")
    value = F.trim(F.get(parts, F.lit(0))).try_cast("double")
    code = F.regexp_replace(F.get(parts, F.lit(1)), r"^[ '\"]+|[ '\"]+$", "")
    return F.when((F.size(parts) == 2) & value.isNotNull(), F.struct(value.alias("value"), code.alias("code")))


def limit_range(text: Column) -> Column:
    """struct<low, high> of ``a - b`` or ``a to b``; otherwise the first number is a high limit.  Commas do not count."""
    pair = r"([0-9.]+)\s*(?:to|-)\s*([0-9.]+)"

    def texts(t: Column) -> Column:
        return F.struct(F.regexp_extract(t, pair, 1).alias("low"), F.regexp_extract(t, pair, 2).alias("high"), F.regexp_extract(t, r"[0-9.]+", 0).alias("single"))

    def numbers(m: Column) -> Column:
        # an empty text is no number either, but costs an exception to find out
        return F.struct(*(F.when(m[k] != "", m[k].try_cast("double")).alias(k) for k in ("low", "high", "single")))

    def limits(m: Column) -> Column:
        ranged = m["low"].isNotNull() & m["high"].isNotNull()
        return F.struct(F.when(ranged, m["low"]).alias("low"), F.when(ranged, m["high"]).otherwise(m["single"]).alias("high"))

    # each step is bound once: inside a lambda nothing else keeps an expression from being computed wherever it occurs
    plain = F.replace(F.lower(text), F.lit(","), F.lit(""))
    return F.get(F.transform(F.transform(F.transform(F.array(plain), texts), numbers), limits), F.lit(0))


def unit(text: Column) -> Column:
    """The unit that a text names, null if none of `UNITS`."""

    def first(low: Column) -> Column:
        # most texts name none, which one search tells
        out = F.when(~low.rlike("|".join(pattern for _, pattern in UNITS)), None)
        for name, pattern in UNITS:
            out = out.when(low.rlike(pattern), name)
        return out

    return F.get(F.transform(F.array(F.lower(text)), first), F.lit(0))  # bound once


def labelled_unit(text: Column) -> Column:
    """The word behind "unit"."""
    return F.nullif(F.regexp_extract(text, r"(?i)unit\s*[-–]?\s*(\w+)", 1), F.lit(""))


def any_date(text: Column, default: Column | None = None) -> Column:
    """An ISO date, a date with the month's name, or the first day-first date with dots, slashes or hyphens inside the text, else ``default``."""
    day_first = F.concat_ws("-", *(F.regexp_extract(text, r"(\d{2})[-/.](\d{2})[-/.](\d{4})", k) for k in (3, 2, 1)))
    found = F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(day_first, "yyyy-MM-dd"), long_date(text))
    return F.coalesce(found, default) if default is not None else found


def has_all_words(text: Column, words: list[str]) -> Column:
    """Is every keyword a whole word of the text, whatever its case?  Keywords are plain text, not patterns."""
    out = F.lit(True)
    for w in words:
        out = out & text.rlike(rf"(?i)\b{re.escape(w)}\b")
    return out


def has_word(text: Column, word: str) -> Column:
    return F.concat(F.lit(" "), F.lower(text), F.lit(" ")).contains(f" {word.lower()} ")


def quality_name(code: Column) -> Column:
    """A code's name; unknown codes pass through."""
    names = F.create_map(*(F.lit(x) for kv in QUALITY_NAMES.items() for x in kv))
    return F.coalesce(F.try_element_at(names, code), code)


#: Prefixes of offices (field, sub-regional, regional) before a region's name.
_OFFICE = r"(?i)^(?:FO\s*-\s*|SRO\s*-\s*|RO\s*-\s*|FO|SRO|RO)\s*"
#: Formats of dates in schedules, tried in this order.
DATE_FORMATS = ["MMMM d, yyyy", "MMM d, yyyy", "yyyy-M-d", "d-M-yyyy"]


def office(text: Column) -> Column:
    """The region in the first brackets, without its office's prefix and leading hyphens; null without brackets."""
    inside = F.nullif(F.regexp_extract(text, r"\(([^)]+)\)", 1), F.lit(""))
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(inside, _OFFICE, "")), "^-+", ""))


def district(address: Column) -> Column:
    """The word behind "Dist" or "District"."""
    return F.nullif(F.regexp_extract(address, r"(?i)Dist(?:rict)?\s*:?\s*([A-Za-z]+)", 1), F.lit(""))


def industrial_area(address: Column) -> Column:
    """The word behind "MIDC", or before it; the first place in the text counts."""
    both = F.regexp_extract(address, r"(?i)MIDC\s+([A-Za-z0-9-]+)|([A-Za-z0-9-]+)\s+MIDC", 0)
    return F.nullif(F.trim(F.regexp_replace(both, r"(?i)^MIDC\s+|\s+MIDC$", "")), F.lit(""))


def long_date(text: Column) -> Column:
    """A date such as "January 5, 2026", "Jan 5, 2026", "2026-01-05" or "05-01-2026"; null if the text is none."""
    t = F.trim(text)
    # one blank, a capital first: what the formats expect
    t = F.initcap(F.regexp_replace(t, r"\s+", " "))
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)).cast("date") for f in DATE_FORMATS))


def region(text: Column) -> Column:
    """The region named in brackets or after "Region:", without its office's prefix."""
    return F.regexp_replace(_region(text), _OFFICE, "")


def _region(text: Column) -> Column:
    return F.nullif(F.trim(F.coalesce(F.nullif(F.regexp_extract(text, r"(?i)region\s*:\s*([^,;]+)", 1), F.lit("")), F.regexp_extract(text, r"\(([^)]*)\)", 1))), F.lit(""))


def file_name(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"[^A-Za-z0-9._-]+", "_")


def header(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", "_")


def quarter_hour(ts: Column) -> Column:
    """The start of the quarter of an hour."""
    return F.date_trunc("hour", ts) + F.make_dt_interval(mins=(F.floor(F.minute(ts) / 15) * 15).cast("int"))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys and the seed only, not on partitions."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


#: What a consent calls itself; the first in the text counts.
_CONSENT = r"(?i)(consent to operate|consent to establish|consent to renewal|cto|cte|renewal of consent)"
_DATE = r"(\d{2}[-/.]\d{2}[-/.]\d{4})"


def consent_metadata(text: Column) -> Column:
    """struct<consent_type, issue_date, valid_from, valid_until> of a consent's text.

    Dates follow "date" or "dated", "valid from" and "valid up to".  Without an end, the last date of the first 2,000
    characters ends the validity if there are two or more, and the first one begins it; a validity without beginning
    begins at its issue.
    """
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    kind = F.nullif(F.regexp_extract(t, _CONSENT, 1), F.lit(""))
    behind = lambda words: any_date(F.regexp_extract(t, rf"(?i){words}{_DATE}", 1))
    issued, until = behind(r"(?:date|dated|issue date)[:\s]+"), behind(r"valid\s+(?:up\s+to|upto|to|till|until)\s+")
    dates = F.regexp_extract_all(F.substring(t, 1, 2000), F.lit(_DATE), F.lit(1))
    guess = until.isNull() & (F.size(dates) >= 2)
    first = F.coalesce(behind(r"valid\s+from\s+"), F.when(guess, any_date(F.get(dates, F.lit(0)))), issued)
    last = F.coalesce(until, F.when(guess, any_date(F.get(dates, F.size(dates) - 1))))
    return F.struct(F.coalesce(F.initcap(kind), F.lit("Consent to Operate")).alias("consent_type"), issued.alias("issue_date"), first.alias("valid_from"), last.alias("valid_until"))
