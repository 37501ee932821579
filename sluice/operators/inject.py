"""Seeded tamper injection: labelled intervals in real series, by keyed hashes and not by the order of rows."""

from __future__ import annotations

import zlib
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import uniform
from . import joins

#: Kind -> (intervals per series half-year, least and most rows of one).
KINDS = {"bdl_gaming": (2, 48, 72), "negative_values": (2, 36, 60), "duplicate_runs": (8, 6, 20)}


def plan(readings: DataFrame, seed: int = 42) -> DataFrame:
    """(factory_id, parameter_id, half, tamper_type, slot, first, last): row ranges that do not overlap.

    Each half-year of a series is cut into as many equal slots as there are intervals; kinds take slots in
    hashed order, and an interval lies at a hashed place inside its slot, no longer than the slot.
    """
    half = F.when(F.month("timestamp") <= 6, 1).otherwise(2)
    size = readings.withColumn("half", half).groupBy("factory_id", "parameter_id", "half").agg(F.count(F.lit(1)).alias("n"))
    slots = [(kind, low, high, i) for kind, (times, low, high) in KINDS.items() for i in range(times)]
    wanted = readings.sparkSession.createDataFrame(slots, "tamper_type string, low int, high int, i int")
    rows = size.crossJoin(F.broadcast(wanted))
    key = [F.col(c) for c in ("factory_id", "parameter_id", "half", "tamper_type", "i")]
    rows = rows.withColumn("slot", F.row_number().over(W.partitionBy("factory_id", "parameter_id", "half").orderBy(uniform(seed, *key), "tamper_type", "i")) - 1)
    width = F.floor(F.col("n") / len(slots))
    length = F.least(F.col("low") + F.floor(uniform(seed + 1, *key) * (F.col("high") - F.col("low") + 1)), width)
    rows = rows.withColumns({"width": width, "length": length})
    first = F.col("slot") * F.col("width") + F.floor(uniform(seed + 2, *key) * (F.col("width") - F.col("length") + 1)) + 1
    return rows.filter("length > 0").withColumn("first", first).select("factory_id", "parameter_id", "half", "tamper_type", "slot", "first", (F.col("first") + F.col("length") - 1).alias("last"))


def inject(readings: DataFrame, tie: str, seed: int = 42) -> DataFrame:
    """Readings with tamper_type: values and codes changed inside the planned intervals, all else as it was."""
    half = F.when(F.month("timestamp") <= 6, 1).otherwise(2)
    rows = readings.withColumn("half", half).withColumn("at", F.row_number().over(W.partitionBy("factory_id", "parameter_id", "half").orderBy("timestamp", tie)))
    at = F.explode(F.sequence("first", "last")).alias("pat")
    p = plan(readings, seed).select(F.col("factory_id").alias("pf"), F.col("parameter_id").alias("pp"), F.col("half").alias("ph"), "tamper_type", "slot", at)
    met = rows.join(p, (F.col("factory_id") == F.col("pf")) & (F.col("parameter_id") == F.col("pp")) & (F.col("half") == F.col("ph")) & (F.col("at") == F.col("pat")), "left")
    u, kind = uniform(seed + 3, F.col("factory_id"), F.col("parameter_id"), F.col(tie)), F.col("tamper_type")
    low = (kind == "bdl_gaming") & (uniform(seed + 4, F.col("parameter_id"), F.col(tie)) < 0.85)
    constant = 10 + 75 * uniform(seed + 5, F.col("factory_id"), F.col("parameter_id"), F.col("half"), F.col("slot"))
    value = F.when(low, 0.05 * u).when(kind == "negative_values", -50 + 48 * u).when(kind == "duplicate_runs", constant).otherwise(F.col("value"))
    return met.select("factory_id", "parameter_id", "timestamp", tie, value.alias("value"), F.when(low, "L").otherwise(F.col("quality_code")).alias("quality_code"), "tamper_type")


#: Kind -> (events per factory and half-year, least and most steps of one, days that its start may be late, starts of both halves, does it spare pH).
EVENTS = {
    "BDL GAMING": (2, 48, 72, 100, ((1, 15), (7, 15)), True),
    "NEGATIVE VALUES": (2, 36, 60, 100, ((1, 20), (7, 20)), True),
    "DUPLICATE RUN": (8, 6, 20, 140, ((1, 10), (7, 10)), False),
}
#: Kinds that a label may have before anything is injected, and the one that is told otherwise.
GIVEN_KINDS = ["INSPECTION DIP", "CORRELATION BREAK", "LIMIT HUGGING", "COPY-PASTE", "FLATLINE", "COORDINATED MISSING DATA", "IMPOSSIBLE PH RANGE", "SENSOR FREEZE", "NIGHTTIME ZERO SHUTDOWN", "EXTREME SPIKE", "CALIBRATION DRIFT"]
RENAMED = {"IMPOSSIBLE PH RANGE": "NEGATIVE VALUES"}
BASELINE, LOW_SHARE, PH, STEP, ATTEMPTS = 0.008, 0.85, "ETP-pH", timedelta(minutes=15), 100
LABELS = "factory_id string, parameter_id string, tamper_type string, start_timestamp timestamp_ntz, end_timestamp timestamp_ntz, severity string"


def draw_labels(readings: DataFrame, labels: DataFrame, year: int = 2024, seed: int = 42, events: dict = EVENTS) -> DataFrame:
    """New labels (`LABELS`) for each factory, none of which overlaps a given or another new one of its parameter.

    Per kind and half-year a parameter of the factory (other than pH where the kind spares it and there is another), a start on the grid and a length
    are drawn, and drawn again while they overlap, up to 100 times; then the event is left out.  A factory's draws are seeded by its
    name, so reruns and other factories change nothing.  A factory is one group: its parameters and labels, not its readings.
    """
    own = readings.groupBy("factory_id").agg(F.sort_array(F.collect_set("parameter_id")).alias("parameters"))
    given = labels.filter("parameter_id is not null").groupBy(F.col("factory_id").alias("f")).agg(F.collect_list(F.struct("parameter_id", "start_timestamp", "end_timestamp")).alias("given"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        factory, parameters = row["factory_id"], list(row["parameters"])
        rng = np.random.default_rng([seed, zlib.crc32(str(factory).encode())])
        held: dict[str, list] = {}
        for g in row["given"] if row["given"] is not None else []:
            held.setdefault(g["parameter_id"], []).append((pd.Timestamp(g["start_timestamp"]), pd.Timestamp(g["end_timestamp"])))
        out = []
        for kind, (times, least, most, days, starts, spares) in events.items():
            choice = [p for p in parameters if p != PH] if spares else parameters
            for month, day in starts:
                for _ in range(times):
                    for _ in range(ATTEMPTS):
                        p = str(rng.choice(choice or parameters))
                        first = pd.Timestamp(datetime(year, month, day)) + timedelta(days=int(rng.integers(days + 1)), hours=int(rng.integers(24))) + STEP * int(rng.integers(4))
                        last = first + STEP * (int(rng.integers(least, most + 1)) - 1)
                        if all(max(first, a) > min(last, b) for a, b in held.get(p, [])):
                            held.setdefault(p, []).append((first, last))
                            out.append((factory, p, kind, first, last, str(rng.choice(["low", "medium", "high"]))))
                            break
        return pd.DataFrame(out, columns=["factory_id", "parameter_id", "tamper_type", "start_timestamp", "end_timestamp", "severity"])

    met = own.join(given, F.col("factory_id") == F.col("f"), "left").select("factory_id", "parameters", "given")
    return met.groupBy("factory_id").applyInPandas(draw, LABELS)


def inject_events(readings: DataFrame, labels: DataFrame, drawn: DataFrame, tie: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(readings, labels): synthetic readings with the events of ``drawn`` (written by `draw_labels`) in them, and all labels.

    Labels of kinds that only an earlier injection gives are dropped first, so reruns do not add up; "IMPOSSIBLE PH RANGE" becomes
    "NEGATIVE VALUES", in labels and in the readings' tamper_type.  About 0.8 % of the readings without a kind, by keyed hash, get the code
    L and a value below 0.05.  Then inside an event: 85 % of the rows of BDL GAMING (at least one, of least hash) likewise; NEGATIVE VALUES from -50
    to -2, code Raw; DUPLICATE RUN one value from 10 to 85, code Raw.  ``readings`` may have tamper_type, and lack quality_code (Raw).
    """
    say = lambda c: F.when(F.col(c).isin(*RENAMED), F.create_map(*(F.lit(x) for kv in RENAMED.items() for x in kv))[F.col(c)]).otherwise(F.col(c))
    kept = labels.filter(F.col("tamper_type").isin(*GIVEN_KINDS)).withColumn("tamper_type", say("tamper_type"))
    rows = readings if "quality_code" in readings.columns else readings.withColumn("quality_code", F.lit("Raw"))
    rows = rows.withColumn("tamper_type", say("tamper_type") if "tamper_type" in rows.columns else F.lit(None).cast("string"))
    key = [F.col(c) for c in ("factory_id", "parameter_id", "timestamp", tie)]
    quiet = F.col("tamper_type").isNull() & (uniform(seed + 10, *key) < BASELINE)
    rows = rows.withColumns({"value": F.when(quiet, 0.05 * uniform(seed + 11, *key)).otherwise(F.col("value")), "quality_code": F.when(quiet, "L").otherwise(F.col("quality_code"))})
    marks = drawn.select("factory_id", "parameter_id", "tamper_type", "start_timestamp", "end_timestamp", "severity", F.lit(1).alias("label_order"))
    marks = marks.withColumn("tamper_type", F.concat_ws("|", "tamper_type", F.col("start_timestamp").cast("string")))  # which event it is, too
    met = joins.label_intervals(rows.withColumnRenamed("tamper_type", "_before"), marks, [tie]).withColumnRenamed("tamper_type", "_event")
    kind = F.substring_index("_event", "|", 1)
    in_event = W.partitionBy("factory_id", "parameter_id", "_event")  # an event has a few dozen rows; rows outside any are of no interest
    place = F.row_number().over(in_event.orderBy(uniform(seed + 12, *key), "timestamp", tie))
    inside = met.filter(F.col("_event").isNotNull()).withColumns({"_low": (kind == "BDL GAMING") & (place <= F.greatest(F.lit(1), F.floor(LOW_SHARE * F.count(F.lit(1)).over(in_event))))})
    constant = F.round(10 + 75 * uniform(seed + 13, F.col("factory_id"), F.col("parameter_id"), F.col("_event")), 3)
    value = F.when(F.col("_low"), 0.05 * uniform(seed + 14, *key)).when(kind == "NEGATIVE VALUES", -50 + 48 * uniform(seed + 15, *key)).when(kind == "DUPLICATE RUN", constant).otherwise(F.col("value"))
    code = F.when(F.col("_low"), "L").when(kind != "BDL GAMING", "Raw").otherwise(F.col("quality_code"))
    columns = [c for c in rows.columns if c not in ("value", "quality_code", "tamper_type")]
    inside = inside.select(*columns, value.alias("value"), code.alias("quality_code"), kind.alias("tamper_type"))
    outside = met.filter(F.col("_event").isNull()).select(*columns, "value", "quality_code", F.col("_before").alias("tamper_type"))
    return outside.unionByName(inside), kept.select("factory_id", "parameter_id", "tamper_type", "start_timestamp", "end_timestamp", "severity").unionByName(drawn)
