"""Composite risk from model outputs and fingerprints, and what is read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric
from .fingerprints import ORDER

#: The anomaly score's scale, the weights of the three parts, the ladder of categories, the actions.
ISO_TOP, ISO_SPAN = -0.3208, 0.3062
WEIGHTS = {"tamper": 0.10, "anomaly": 0.225, "fingerprints": 0.675}
LADDER = [("CRITICAL", 75.0, 4), ("HIGH", 50.0, 2), ("MEDIUM", 25.0, 1)]
ACTIONS = {
    "CRITICAL": "Immediate unannounced physical site inspection & automated regulator dispatch.",
    "HIGH": "Issue formal notice of telemetry anomaly & schedule audit within 48 hours.",
    "MEDIUM": "Flag site for heightened monitoring & mandate sensor calibration report.",
    "LOW": "Normal routine surveillance.",
}
#: What alerts are called and when they are raised.
ALERT_TYPE, ALERT_TIME = "Tamper Fingerprint Triggered", "2024-12-30 14:00:00"
#: Label, unit and threshold of each fingerprint; the threshold of correlations follows the data.
CHECKS = {
    "impossible_ph_range": ("Impossible pH Range", "%", "> 0.0% of readings"),
    "inspection_dip": ("Pre-Inspection Dip", "%", "average pre-inspection change < -20.0%"),
    "flatline": ("Flatline", "%", "> 5.0% of readings"),
    "limit_hugging": ("Limit Hugging", "%", "> 5.0% of readings"),
    "correlation_break": ("Correlation Break", "", None),
    "copy_paste": ("Copy-Paste", "%", "> 1.0% of readings (autocorrelation > 0.95)"),
    "coordinated_missing_data": ("Coordinated Missing Data", "\u03c3", "> 1.5 std dev above dataset median missing rate"),
    "data_integrity": ("Data Integrity (Error Rate)", "\u03c3", "> 1.5 std dev above dataset median error rate"),
}
NO_THRESHOLD = "insufficient data to compute dataset threshold"


def composite(scores: DataFrame) -> DataFrame:
    """anomaly_norm, risk_score, risk_category, recommended_action and triggered_fingerprints.

    ``scores``: probability, anomaly_score, trig_<fingerprint>, total_fingerprints_triggered.
    """
    norm = numeric.clip((F.lit(ISO_TOP) - F.col("anomaly_score")) / ISO_SPAN, 0.0, 1.0)
    out = scores.withColumn("anomaly_norm", norm)
    score = WEIGHTS["tamper"] * F.col("probability") + WEIGHTS["anomaly"] * F.col("anomaly_norm") + WEIGHTS["fingerprints"] * F.col("total_fingerprints_triggered") / 8
    out = out.withColumn("risk_score", numeric.half_even(100 * score, 1)).withColumn("risk_category", category(F.col("risk_score"), F.col("total_fingerprints_triggered")))
    names = F.filter(F.array(*(F.when(F.col(f"trig_{k}") == 1, F.lit(k.replace("_", " ").title())) for k in ORDER)), lambda x: x.isNotNull())
    actions = F.create_map(*(F.lit(x) for kv in ACTIONS.items() for x in kv))
    return out.withColumns({"recommended_action": actions[F.col("risk_category")], "triggered_fingerprints": names})


def category(score: Column, triggered: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, least, count in LADDER:
        out = out.when((score >= least) | (triggered >= count), name)
    return out.otherwise("LOW")


def alerts(risks: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(factory_id, alert_type, severity, message, timestamp, status): a row for each factory of high or critical risk.

    ``names``: factory_id and name, one row each; a factory without a name goes by its id.
    """
    rows = risks.filter(F.col("risk_category").isin("HIGH", "CRITICAL"))
    rows = rows.withColumn("name", F.lit(None).cast("string")) if names is None else rows.drop("name").join(names.select("factory_id", "name"), "factory_id", "left")
    text = F.concat(F.coalesce("name", "factory_id"), F.lit(" triggered "), F.col("total_fingerprints_triggered").cast("string"), F.lit(" tampering fingerprints. "), F.col("recommended_action"))
    return rows.select("factory_id", F.lit(ALERT_TYPE).alias("alert_type"), F.col("risk_category").alias("severity"), text.alias("message"), F.lit(ALERT_TIME).alias("timestamp"), F.lit("OPEN").alias("status"))


def breakdown(risks: DataFrame) -> DataFrame:
    """The three contributions, each rounded, and their sum."""
    parts = {
        "from_tamper_model": numeric.half_even(100 * WEIGHTS["tamper"] * F.col("probability"), 1),
        "from_anomaly": numeric.half_even(100 * WEIGHTS["anomaly"] * F.col("anomaly_norm"), 1),
        "from_fingerprints": numeric.half_even(100 * WEIGHTS["fingerprints"] * F.col("total_fingerprints_triggered") / 8, 1),
    }
    out = risks.select("factory_id", *(c.alias(k) for k, c in parts.items()))
    return out.withColumn("total", numeric.half_even(sum((F.col(k) for k in parts), F.lit(0.0)), 1))


def checks(scores: DataFrame) -> DataFrame:
    """(factory_id, place, key, label, raw_value, unit, threshold_desc, triggered): the fingerprints of each factory as rows.

    The threshold of correlations is the column ``threshold``, told with four digits.
    """
    learnt = F.when(F.col("threshold").isNull(), NO_THRESHOLD).otherwise(F.concat(F.lit("< "), F.format_string("%.4f", numeric.half_even(F.col("threshold"), 4)), F.lit(" (dataset mean - 1 std dev)")))
    of = lambda i, k: F.struct(
        F.lit(i).alias("place"), F.lit(k).alias("key"), F.lit(CHECKS[k][0]).alias("label"), F.col(k).cast("double").alias("raw_value"), F.lit(CHECKS[k][1]).alias("unit"),
        (learnt if CHECKS[k][2] is None else F.lit(CHECKS[k][2])).alias("threshold_desc"), F.coalesce(F.col(f"trig_{k}") == 1, F.lit(False)).alias("triggered"),
    )
    return scores.select("factory_id", F.explode(F.array(*(of(i, k) for i, k in enumerate(ORDER)))).alias("c")).select("factory_id", "c.*")


def drivers(scores: DataFrame) -> DataFrame:
    """(factory_id, note): which fingerprints drive a high risk; null where the risk is not high."""
    high = F.col("risk_category").isin("HIGH", "CRITICAL")
    rules = {
        "flatline": F.col("flatline") > 5, "limit hugging": F.col("limit_hugging") > 5,
        "coordinated missing data": F.col("trig_coordinated_missing_data") == 1, "impossible values": F.col("impossible_ph_range") != 0,
    }
    parts = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())), lambda x: x.isNotNull())
    named = F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("see raw_fingerprint_signals for detail")
    note = F.concat(F.lit("Risk score is being driven by fingerprint checks: "), named, F.lit("."))
    return scores.select("factory_id", F.when(high, note).alias("note"))
