"""What a read service asks for, as functions from tables to DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import risk, windows

#: Four categories as three tiers, what is shown of factories without an entry, priorities of a dispatch.
TIERS = {"LOW": "Low", "MEDIUM": "Medium", "HIGH": "High", "CRITICAL": "High"}
NO_NAME, NO_REGION, NO_INDUSTRY = "Industrial Site ", "Taloja", "Chemical Manufacturing"
NO_COVERAGE, NO_READINESS, NO_PARAMETERS, NO_STABILITY = 92.5, 84.5, 4, 0.942
LIMITED_CONTEXT = "\u26a0\ufe0f Limited Regulatory Context (Missing CTO limits / Inspection baseline)"
PRIORITIES = {"High": "CRITICAL - IMMEDIATE UNANNOUNCED AUDIT", "Medium": "HIGH - MANDATE SENSOR CALIBRATION", "Low": "ROUTINE MONITORED"}
#: The standards that apply where a factory has no consent, and the settings that detection starts with.
DEFAULT_LIMITS = [
    ("pH", "pH Level", "pH", 5.5, 9.0, "Effluent Quality"), ("BOD", "Biochemical Oxygen Demand", "mg/L", 0.0, 30.0, "Effluent Quality"), ("COD", "Chemical Oxygen Demand", "mg/L", 0.0, 250.0, "Effluent Quality"),
    ("TSS", "Total Suspended Solids", "mg/L", 0.0, 100.0, "Effluent Quality"), ("FLOW", "Effluent Discharge Flow", "m\u00b3/hr", 0.0, 500.0, "Flow Monitoring"), ("DO", "Dissolved Oxygen", "mg/L", 4.0, 14.0, "Effluent Quality"),
    ("TEMP", "Water Temperature", "\u00b0C", 10.0, 40.0, "Physical Parameter"),
]
STANDARD = "CPCB Standard 2024"
DEFAULT_THRESHOLDS = [("flatline_sensitivity", 0.95, "ratio"), ("limit_hugging_tolerance", 0.02, "margin"), ("correlation_decay_cutoff", 0.35, "r-score"), ("missing_data_alert_threshold", 5.0, "%")]


def same_text(column: str, wanted: str | None, every: str = "all") -> Column:
    """Equality whatever the case; no wish, or one that begins with "all", lets everything pass."""
    if wanted is None or wanted.lower().startswith(every):
        return F.lit(True)
    return F.lower(column) == wanted.lower()


def factories(scores: DataFrame, region: str | None = None, tier: str | None = None, sort: str = "risk") -> DataFrame:
    """Filtered and sorted score rows with their position."""
    rows = windows.positions(scores, "risk_score", "factory_id").filter(same_text("region", region) & same_text("risk_category", tier))
    order = {"risk": [F.col("risk_score").desc()], "name": [F.col("factory_id").asc()], "rank": [F.col("position").asc()]}[sort]
    return rows.orderBy(*order, "factory_id")


def search(rows: DataFrame, columns: list[str], text: str, most: int = 8) -> DataFrame:
    """Up to ``most`` rows that hold the text in any of the columns, in the order of the first."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(text.lower()), F.lit(False))
    return rows.filter(hit).orderBy(columns[0]).limit(most)


def regions(scores: DataFrame) -> DataFrame:
    """Per region: factories, how many of high risk, mean score."""
    return scores.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("risk_category").isin("HIGH", "CRITICAL")).alias("high"), F.round(F.avg("risk_score"), 2).alias("mean_score"))


def detail(scores: DataFrame, factory_id: str) -> DataFrame:
    return scores.filter(F.col("factory_id") == factory_id)


def dispatch(scores: DataFrame, most: int = 5) -> DataFrame:
    """The factories to inspect first."""
    return scores.filter(F.col("risk_category").isin("HIGH", "CRITICAL")).orderBy(F.col("risk_score").desc(), "factory_id").limit(most)


def parameter_means(real: DataFrame, other: DataFrame) -> DataFrame:
    """(factory_id, parameter_id, mean): rounded to one digit, null without values; ``other`` stands in for factories that ``real`` lacks."""
    from ..operators import joins

    rows = joins.with_fallback(real.select("factory_id", "parameter_id", "value"), other.select("factory_id", "parameter_id", "value"), ["factory_id"])
    return rows.groupBy("factory_id", "parameter_id").agg(numeric.half_even(F.avg("value"), 1).alias("mean"))


def in_cities(rows: DataFrame, column: str, cities: dict[str, list[str]], city: str) -> DataFrame:
    """Rows that name one of a city's spellings; a city without an entry takes the spellings of all."""
    names = cities.get(city.lower()) or [n for every in cities.values() for n in every]
    text = F.lower(column)
    return rows.filter(F.exists(F.array(*map(F.lit, names)), lambda n: text.contains(F.lower(n))))


def joined(left: DataFrame, right: DataFrame, key: str, suffix: str = "_fp") -> DataFrame:
    """``left`` with the columns of ``right``; those that both have get the suffix on the right side."""
    return left.join(right.withColumnsRenamed({c: c + suffix for c in right.columns if c in left.columns and c != key}), key, "left")


def with_fallback(static: DataFrame, live: DataFrame | None, key: str) -> DataFrame:
    """``static`` (a row for each key) with what ``live`` says instead, field by field where that is not null; None if ``live`` cannot be reached.

    Keys that only ``live`` has are added.
    """
    if live is None:
        return static
    other = live.withColumnsRenamed({c: f"_{c}" for c in live.columns if c != key})
    both = static.join(other, key, "full")
    return both.select(key, *(F.coalesce(f"_{c}", c).alias(c) if c in live.columns else F.col(c) for c in static.columns if c != key))


def score_view(factories: DataFrame, fingerprints: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """What the read views start from: a row for each of ``factories`` with its rank, tier, and magnitudes as fractions.

    ``factories``: factory_id, risk_score, risk_category, anomaly_norm; ``fingerprints``: the magnitudes, trig_coordinated_missing_data.
    ``names``: factory_id, name, region, industry.  Columns that both first tables have come with the suffix _fp.  Unknown
    categories are of the lowest tier; what is not measured is 0, the ratio's volatility null.
    """
    rows = joined(factories, fingerprints, "factory_id")
    tiers = F.create_map(*(F.lit(x) for kv in TIERS.items() for x in kv))
    share = lambda c, name: (F.col(c) / 100.0).alias(name)
    if names is not None:
        rows = rows.drop("name", "region", "industry").join(names.select("factory_id", "name", "region", "industry"), "factory_id", "left")
    told = {"name": F.concat(F.lit(NO_NAME), F.col("factory_id")), "region": F.lit(NO_REGION), "industry": F.lit(NO_INDUSTRY)}
    rows = rows.withColumns({c: F.coalesce(c, other) if c in rows.columns else other for c, other in told.items()})
    return windows.positions(rows, "risk_score", "factory_id").select(
        F.col("position").alias("rank"), "factory_id", "name", "region", "industry", F.col("risk_score").alias("tsi_score"), F.coalesce(tiers[F.col("risk_category")], F.lit("Low")).alias("risk_tier"),
        F.col("risk_category").alias("true_risk_category"), F.col("anomaly_norm").alias("anomaly_score"), share("flatline", "flatline_rate"), share("copy_paste", "autocorr_high_rate"), share("limit_hugging", "limit_hugging_mean"),
        share("impossible_ph_range", "impossible_val_rate"), F.coalesce("inspection_dip", F.lit(0.0)).alias("pre_dip_mean"), F.coalesce("trig_coordinated_missing_data", F.lit(0)).alias("coordinated_missing_flag"),
        *(F.lit(0.0).alias(c) for c in ("dup_run_rate", "bdl_rate_mean", "cov_high_rate")), F.lit(None).cast("double").alias("bod_cod_vol_mean"),
    )


def summary(view: DataFrame) -> DataFrame:
    """(total_factories, high_risk_count, medium_risk_count, low_risk_count): one row."""
    return view.agg(F.count(F.lit(1)).alias("total_factories"), *(F.count_if(F.col("risk_tier") == t).alias(f"{t.lower()}_risk_count") for t in ("High", "Medium", "Low")))


def listing(view: DataFrame, region: str | None = None, tier: str | None = None, sort: str = "rank") -> DataFrame:
    """Rows of a region and a tier, whatever the case, in the order of their rank, score or name."""
    order = {"tsi_score": F.col("tsi_score").desc(), "name": F.col("name").asc()}.get(sort, F.col("rank").asc())
    return view.filter(same_text("region", region) & same_text("risk_tier", tier)).orderBy(order, "rank")


def admin_listing(view: DataFrame, district: str | None = None, industry: str | None = None) -> DataFrame:
    """Rows of a district and an industry; blank wishes, and such as "All districts", let everything pass."""
    wish = lambda w: None if w is None or not w.strip() else w.strip()
    hit = same_text("region", wish(district)) & same_text("industry", wish(industry))
    return view.filter(hit).select("rank", "factory_id", "name", F.col("region").alias("district"), "industry", "risk_tier", "tsi_score")


def tagged(rows: DataFrame, tag: str | None = None) -> DataFrame:
    """Rows with the tag Critical (of the highest tier) or Routine, and of one tag only if it is wished for."""
    out = rows.withColumn("tag", F.when(F.col("risk_tier") == "High", "Critical").otherwise("Routine"))
    return out.filter(same_text("tag", tag))


def details(view: DataFrame, quality: DataFrame, means: DataFrame, limited: DataFrame, parameters: dict[str, str]) -> DataFrame:
    """The page of each factory: its row of the view, its data quality or what stands for it, means of parameters, the driver's note.

    ``means``: factory_id, parameter_id, mean; ``parameters``: column -> parameter_id; ``limited``: factory_id of those without regulatory context.
    """
    q = quality.select("factory_id", "coverage_percentage", "readiness_score", "parameter_count", *(["missing_percentage"] if "missing_percentage" in quality.columns else []))
    wide = means.groupBy("factory_id").agg(*(F.max(F.when(F.col("parameter_id") == p, F.col("mean"))).alias(c) for c, p in parameters.items()))
    marks = limited.select("factory_id").distinct().withColumn("_limited", F.lit(True))
    rows = view.join(q, "factory_id", "left").join(wide, "factory_id", "left").join(marks, "factory_id", "left")
    covered = F.coalesce("coverage_percentage", F.lit(NO_COVERAGE))
    lost = F.coalesce("missing_percentage", 100.0 - covered) if "missing_percentage" in q.columns else 100.0 - covered
    shares = {"flatline": 100 * F.col("flatline_rate"), "limit_hugging": 100 * F.col("limit_hugging_mean"), "impossible_ph_range": 100 * F.coalesce("impossible_val_rate", F.lit(0.0)), "trig_coordinated_missing_data": F.col("coordinated_missing_flag"), "risk_category": F.col("true_risk_category")}
    note = risk.drivers(view.select("factory_id", *(c.alias(k) for k, c in shares.items())))
    return rows.join(note, "factory_id", "left").select(
        *view.columns, F.col("_limited").isNull().alias("has_cto_context"), F.when(F.col("_limited"), LIMITED_CONTEXT).alias("context_warning"), covered.alias("coverage_percentage"), lost.alias("missing_percentage"),
        F.coalesce("readiness_score", F.lit(NO_READINESS)).alias("readiness_score"), F.coalesce("parameter_count", F.lit(NO_PARAMETERS)).alias("parameter_count"), *parameters, "note",
    )


def predictions(view: DataFrame, stability: DataFrame) -> DataFrame:
    """(factory_id, tsi_score, anomaly_score, seed_stability_index): what the models say of each factory."""
    rows = view.join(stability.select("factory_id", "stability"), "factory_id", "left")
    return rows.select("factory_id", "tsi_score", numeric.half_even(F.col("anomaly_score"), 4).alias("anomaly_score"), F.coalesce("stability", F.lit(NO_STABILITY)).alias("seed_stability_index"))


def inspection_history(events: DataFrame, factory_id: str | None = None) -> DataFrame:
    """Inspections of a factory (or all), the latest first."""
    rows = events if factory_id is None else events.filter(F.col("factory_id") == factory_id)
    return rows.orderBy(*(["factory_id"] if factory_id is None else []), F.col("inspection_date").desc_nulls_last(), "status")


def data_quality(quality: DataFrame) -> DataFrame:
    """Each factory's quality beside the records of all: factory_id, coverage and missing percentages, grade, readiness, total_records, total_records_processed."""
    total = quality.agg(F.coalesce(F.sum("total_records"), F.lit(0)).alias("total_records_processed"))
    rows = quality.crossJoin(F.broadcast(total))  # one row
    return rows.select("factory_id", F.coalesce("coverage_percentage", F.lit(0.0)).alias("coverage_percentage"), (100 - F.coalesce("coverage_percentage", F.lit(0.0))).alias("missing_percentage"), F.coalesce("quality_grade", F.lit("N/A")).alias("quality_grade"), F.coalesce("readiness_score", F.lit(0.0)).alias("readiness_score"), "total_records", "total_records_processed")


def oversight(view: DataFrame) -> DataFrame:
    """Per region: total_sites, high_risk_count, avg_tsi_score."""
    mean = numeric.half_even_mean(F.col("tsi_score"), 2)
    return view.groupBy("region").agg(F.count(F.lit(1)).alias("total_sites"), F.count_if(F.col("risk_tier") == "High").alias("high_risk_count"), F.coalesce(mean, F.lit(0.0)).alias("avg_tsi_score"))


def dispatch_queue(view: DataFrame, most: int = 5) -> DataFrame:
    """The ``most`` factories of highest score with the priority that their tier gives."""
    words = F.create_map(*(F.lit(x) for kv in PRIORITIES.items() for x in kv))
    return view.orderBy("rank").limit(most).select("factory_id", "name", "rank", "tsi_score", "risk_tier", words[F.col("risk_tier")].alias("priority"))


def default_limits(spark: SparkSession) -> DataFrame:
    """The standards for factories without a consent, by category and name."""
    rows = spark.createDataFrame([(*x[:5], STANDARD, x[5]) for x in DEFAULT_LIMITS], "parameter_id string, parameter_name string, unit string, min_limit double, max_limit double, regulatory_standard string, category string")
    return rows.orderBy("category", "parameter_name")


def default_thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_THRESHOLDS, "setting_key string, value double, unit string")


def factory_profile(parts: list[DataFrame], expected: int | None = None) -> DataFrame:
    """The parts of a profile joined on factory_id, in order; with ``expected``, another number of factories is an error."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "factory_id", "left")
    if expected is not None and (n := out.count()) != expected:
        raise ValueError(f"{n} factories, {expected} expected")
    return out
