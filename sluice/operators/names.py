"""Which names of one table do the names of another hold: an inverted index of words, no nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars


def visits_by_name(factories: DataFrame, visits: DataFrame, key: str, name: str, visit_name: str) -> DataFrame:
    """(key, visits): for each factory the rows of ``visits`` whose name holds every keyword of the factory's, as whole words.

    Keywords are ``scalars.name_tokens`` and the word behind "unit"; case does not matter.  Each factory looks up only its rarest word in
    the index of visit names, and the candidates are compared by all words.  Names are counted once before they are split.

    A factory without keywords, or one with a word that no visit holds, has 0.  Null names hold nothing.
    """
    wanted = F.array_compact(F.array_union(scalars.name_tokens(F.col(name)), F.array(F.lower(scalars.labelled_unit(F.col(name))))))
    asked = factories.select(F.col(key).alias("key"), F.coalesce(wanted, F.array().cast("array<string>")).alias("wanted"), F.size(scalars.name_tokens(F.col(name))).alias("named"))
    words = F.array_distinct(F.filter(F.split(F.lower(F.col("n")), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))
    held = visits.groupBy(F.col(visit_name).alias("n")).agg(F.count(F.lit(1)).alias("times")).filter("n is not null").withColumn("words", words)
    index = held.select(F.explode("words").alias("word"), "words", "times")
    known = index.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    each = asked.filter("named > 0").select("key", "wanted", F.explode("wanted").alias("word")).join(known, "word", "left")
    rare = each.groupBy("key").agg(F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), "word")).alias("word"), F.min(F.coalesce("df", F.lit(0))).alias("df"), F.any_value("wanted").alias("wanted")).filter("df > 0")
    met = rare.select("key", "wanted", "word").join(index, "word").filter(F.size(F.array_except("wanted", "words")) == 0)
    found = met.groupBy("key").agg(F.sum("times").alias("visits"))
    out = asked.select("key").join(found, "key", "left")
    return out.select(F.col("key").alias(key), F.coalesce("visits", F.lit(0)).cast("long").alias("visits"))
