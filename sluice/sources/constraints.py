"""What a relational store checks when rows are written: keys, references, missing values, defaults.  Spark does not; these functions do."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ConstraintError(ValueError):
    """Rows that may not be written; ``counts`` has the number of violations of each constraint."""

    def __init__(self, counts: dict[str, int]):
        super().__init__("; ".join(f"{k}: {n}" for k, n in sorted(counts.items())))
        self.counts = counts


@dataclass(frozen=True)
class Reference:
    """``columns`` must be found in ``parent``'s ``keys``; a null in any of them refers to nothing and is allowed."""

    columns: list[str]
    parent: DataFrame
    keys: list[str]


@dataclass(frozen=True)
class Constraints:
    """primary: a key without nulls or repeats; unique: keys whose nulls do not count; not_null: columns; references; defaults: column -> value."""

    primary: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    not_null: list[str] = field(default_factory=list)
    references: list[Reference] = field(default_factory=list)
    defaults: dict[str, object] = field(default_factory=dict)


def with_defaults(df: DataFrame, rules: Constraints) -> DataFrame:
    """Columns that are absent get their default; values that are null stay null, as in a store that is given them."""
    return df.withColumns({c: F.lit(v) for c, v in rules.defaults.items() if c not in df.columns})


def _key(columns: list[str]):
    return F.concat_ws("|", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL")) for c in columns))


def violations(df: DataFrame, rules: Constraints) -> DataFrame:
    """(constraint, columns, key, rows): each offending key of each constraint with its number of rows.

    Repeats of a key are counted before they are told; references are anti-joined on distinct keys of both sides.  An empty table
    violates nothing.
    """
    name = lambda kind, columns: (F.lit(kind).alias("constraint"), F.lit(", ".join(columns)).alias("columns"), _key(columns).alias("key"))
    null = lambda columns: reduce(lambda a, b: a | b, (F.col(f"`{c}`").isNull() for c in columns))
    found = []
    for kind, columns in [("primary key", rules.primary)] * bool(rules.primary) + [("unique", c) for c in rules.unique]:
        groups = df.filter(~null(columns)).groupBy(*(f"`{c}`" for c in columns)).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
        found.append(groups.select(*name(kind, columns), "rows"))
    for columns in [[c] for c in dict.fromkeys([*rules.primary, *rules.not_null])]:
        found.append(df.filter(null(columns)).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 0).select(F.lit("not null").alias("constraint"), F.lit(columns[0]).alias("columns"), F.lit("NULL").alias("key"), "rows"))
    for r in rules.references:
        own = df.filter(~null(r.columns)).groupBy(*(f"`{c}`" for c in r.columns)).agg(F.count(F.lit(1)).alias("rows"))
        there = r.parent.select(*(F.col(f"`{k}`").alias(f"_p{i}") for i, k in enumerate(r.keys))).distinct()
        on = reduce(lambda a, b: a & b, (own[c] == there[f"_p{i}"] for i, c in enumerate(r.columns)))
        found.append(own.join(there, on, "left_anti").select(*name("foreign key", r.columns), "rows"))
    if not found:
        return df.sparkSession.createDataFrame([], "constraint string, columns string, key string, rows long")
    return reduce(DataFrame.unionByName, found)


def write_checked(df: DataFrame, path: str, rules: Constraints, mode: str = "append") -> None:
    """Writes ``df`` with its defaults only if it violates nothing; else `ConstraintError`, and the table stays as it was.

    With ``mode="append"`` keys count against the rows that are there already.
    """
    df = with_defaults(df, rules)
    whole = df
    hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
    there = hadoop.Path(path)
    if mode == "append" and there.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(there):
        whole = df.sparkSession.read.parquet(path).unionByName(df, allowMissingColumns=True)
    counts = {f"{r['constraint']} ({r['columns']})": r["n"] for r in violations(whole, rules).groupBy("constraint", "columns").agg(F.sum("rows").alias("n")).collect()}
    if counts:
        raise ConstraintError(counts)
    df.write.mode(mode).parquet(path)
