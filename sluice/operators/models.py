"""Models: isolation forest, tamper classifier with leave-one-out gates, linear and kernel attributions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars
from . import aggregates


def _path_constant(n: int) -> float:
    """The mean depth of an unsuccessful search among n points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class IsolationForest:
    """Trees of random axis cuts over small subsamples; a point that few cuts isolate is anomalous."""

    def __init__(self, trees: int = 100, sample: int = 256, seed: int = 42):
        self.trees, self.sample, self.seed = trees, sample, seed

    def fit(self, x: np.ndarray) -> IsolationForest:
        self.mean, sd = x.mean(0), x.std(0)
        self.scale = np.where(sd > 0, sd, 1.0)
        x, rng = (x - self.mean) / self.scale, np.random.default_rng(self.seed)
        n = min(self.sample, len(x))
        self.norm, self.roots = _path_constant(n), []
        for _ in range(self.trees):
            self.roots.append(self._grow(x[rng.choice(len(x), n, False)], 0, int(np.ceil(np.log2(max(n, 2)))), rng))
        return self

    def _grow(self, x: np.ndarray, depth: int, most: int, rng: np.random.Generator):
        low, high = (x.min(0), x.max(0)) if len(x) else (None, None)
        axes = np.flatnonzero(high > low) if len(x) else []
        if depth >= most or len(x) < 2 or not len(axes):
            return depth + _path_constant(len(x))
        k = int(rng.choice(axes))
        at = rng.uniform(low[k], high[k])
        left = x[:, k] < at
        return k, at, self._grow(x[left], depth + 1, most, rng), self._grow(x[~left], depth + 1, most, rng)

    def score(self, x: np.ndarray) -> np.ndarray:
        """-2 ** (-mean depth / norm): near -1 for anomalies, near -0.5 for the ordinary."""
        x = (x - self.mean) / self.scale
        total = np.zeros(len(x))
        for root in self.roots:
            work = [(root, np.arange(len(x)))]
            while work:
                node, rows = work.pop()
                if not isinstance(node, tuple):
                    total[rows] += node
                elif len(rows):
                    k, at, left, right = node
                    go = x[rows, k] < at
                    work += [(left, rows[go]), (right, rows[~go])]
        return -(2.0 ** (-total / len(self.roots) / max(self.norm, 1e-9)))


def _sampled(df: DataFrame, columns: list[str], key: list[str], most: int, seed: int) -> np.ndarray:
    """At most ``most`` rows on the driver, those of least keyed hash; missing values take the column's median."""
    medians = aggregates.exact_medians(df, columns)
    picked = df.select(*(F.coalesce(F.col(c).cast("double"), F.lit(float(medians[c] or 0))).alias(c) for c in columns), scalars.uniform(seed, *map(F.col, key)).alias("_u")).orderBy("_u").limit(most)
    table = picked.drop("_u").toArrow()  # by columns: rows as Python objects take several times the memory
    return np.column_stack([table[c].to_numpy() for c in columns])


def fit_isolation_forest(df: DataFrame, columns: list[str], key: list[str], most: int = 100_000, seed: int = 42, **options) -> IsolationForest:
    """Fitted on at most ``most`` rows, those of least keyed hash; missing values take the column's median.

    The bound is a parameter; the rows reach the driver, which grows the trees.
    """
    return IsolationForest(seed=seed, **options).fit(_sampled(df, columns, key, most, seed))


def fit_seeds(df: DataFrame, columns: list[str], key: list[str], seeds: list[int], most: int = 100_000, seed: int = 42, **options) -> list[IsolationForest]:
    """A forest for each of ``seeds``, all of one sample of at most ``most`` rows; the fits run as tasks, one for each seed."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(_sampled(df, columns, key, most, seed))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(int(s), _as_text(IsolationForest(seed=int(s), **options).fit(shared.value))) for s in b["s"]], columns=["s", "model"])

    rows = spark.createDataFrame([(s,) for s in seeds], "s int").repartition(len(seeds)).mapInPandas(fit, "s int, model string").collect()
    by = {r["s"]: _of_text(r["model"]) for r in rows}
    return [by[s] for s in seeds]


def seed_stability(df: DataFrame, forests: list[IsolationForest], key: str, columns: list[str], order: list[str], rows: int = 1000, seed: int = 42) -> DataFrame:
    """(key, n, stability): how alike forests of different seeds rank the readings of each factory.

    The mean rank correlation over all pairs of ``forests``, between the scores of the same ``rows`` hash-sampled readings of a factory
    (all, if it has fewer); equal scores share their mean rank.  Missing values count as 0, as in scoring.  A factory whose scores
    do not vary under some forest, or with one reading, has no stability: null.
    """
    shared = df.sparkSession.sparkContext.broadcast(forests)
    picked = df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(scalars.uniform(seed, *map(F.col, order)), *order))).filter(F.col("_n") <= rows)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[columns].astype(float).fillna(0.0).to_numpy()
        ranks = pd.DataFrame({i: f.score(x) for i, f in enumerate(shared.value)}).rank()
        alike = ranks.corr().to_numpy()[np.triu_indices(len(shared.value), 1)]
        value = None if not len(alike) or np.isnan(alike).any() else float(alike.mean())
        return pd.DataFrame({key: [pdf[key].iloc[0]], "n": [len(pdf)], "stability": pd.array([value], dtype="Float64")})

    kind = df.schema[key].dataType.simpleString()
    return picked.select(key, *columns).groupBy(key).applyInPandas(compare, f"`{key}` {kind}, n long, stability double")


def mean_stability(stability: DataFrame) -> DataFrame:
    """(factories, mean_stability): one row, over the factories that have one."""
    return stability.agg(F.count("stability").alias("factories"), F.avg("stability").alias("mean_stability"))


def score_isolation_forest(df: DataFrame, model: IsolationForest, columns: list[str]) -> DataFrame:
    """anomaly_score of each row; missing values count as 0 here, unlike in training."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(shared.value.score(x.fillna(0.0).to_numpy(float)))

    return df.withColumn("anomaly_score", score(F.struct(*(F.col(c).cast("double").alias(c) for c in columns))))


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Balanced logistic regression with an L2 penalty on the coefficients (not the intercept), by Newton's method."""
    n, k = x.shape
    w = np.where(y == 1, n / (2 * max(y.sum(), 1)), n / (2 * max((1 - y).sum(), 1)))
    z, beta = np.hstack([x, np.ones((n, 1))]), np.zeros(k + 1)
    penalty = np.append(np.full(k, 1 / c), 0.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -500, 500)))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-12), z.T @ (w * (p - y)) + penalty * beta)
        beta -= step
        if np.abs(step).max() < 1e-10:
            break
    return beta[:k], float(beta[k])


def standardise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, sd = x.mean(0), x.std(0)
    scale = np.where(sd > 0, sd, 1.0)
    return (x - mean) / scale, mean, scale


def leave_one_out(features: DataFrame, key: str, columns: list[str], label: str, most: int = 100_000) -> DataFrame:
    """(key, label, probability): each factory's probability from the model of all others, one fit per task row.

    ``features`` has a row per factory, at most ``most``; the table (a few columns) is broadcast, and the fits are spread.
    """
    rows = _few(features.orderBy(key), [key, label, *columns], most)
    shared = features.sparkSession.sparkContext.broadcast((rows[columns].fillna(0.0).to_numpy(float), rows[label].to_numpy(int), rows[key].tolist()))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y, keys = shared.value
        for b in batches:
            out = []
            for i in b["i"]:
                rest = np.arange(len(y)) != i
                z, mean, scale = standardise(x[rest])
                coef, bias = fit_logistic(z, y[rest])
                out.append((keys[i], int(y[i]), float(1 / (1 + np.exp(-((x[i] - mean) / scale @ coef + bias))))))
            yield pd.DataFrame(out, columns=[key, "label", "probability"])

    kind = features.schema[key].dataType.simpleString()
    return features.sparkSession.range(len(rows)).withColumnRenamed("id", "i").mapInPandas(fit, f"`{key}` {kind}, label int, probability double")


@dataclass(frozen=True)
class TamperModel:
    """A logistic model of scaled columns; a probability is one expression."""

    columns: list[str]
    mean: list[float]
    scale: list[float]
    coefficients: list[float]
    bias: float

    def probability(self, known: list[str]) -> Column:
        """Of a row that has the columns ``known``; columns it lacks and nulls count as 0."""
        x = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) if c in known else F.lit(0.0) for c in self.columns]
        terms = (F.lit(b) * (v - F.lit(m)) / F.lit(s) for v, m, s, b in zip(x, self.mean, self.scale, self.coefficients))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-sum(terms, F.lit(self.bias))))


def factory_aggregates(features: DataFrame, columns: list[str], key: str = "factory_id") -> DataFrame:
    """(key, <column>_mean, <column>_std): a single reading has the deviation 0, a factory without values nulls."""
    of = [a for c in columns for v in [F.col(f"`{c}`").cast("double")] for a in (F.avg(v).alias(f"{c}_mean"), F.when(F.count(F.lit(1)) > 1, F.stddev_samp(v)).otherwise(F.lit(0.0)).alias(f"{c}_std"))]
    return features.groupBy(key).agg(*of)


def complete_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns that no row lacks."""
    lacking = df.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns)).first()
    return [c for c in columns if not lacking[c]]


def _few(df: DataFrame, columns: list[str], most: int) -> pd.DataFrame:
    """A table of factories on the driver; more than ``most`` rows are an error, since a sample would be another model."""
    rows = df.select(*(F.col(f"`{c}`") for c in columns)).limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} factories")
    return rows


def fit_tamper_model(features: DataFrame, columns: list[str], label: str, most: int = 100_000) -> TamperModel:
    """The logistic model of all factories; ``features`` has a row per factory, at most ``most``."""
    rows = _few(features, [*columns, label], most)
    z, mean, scale = standardise(rows[columns].fillna(0.0).to_numpy(float))
    coefficients, bias = fit_logistic(z, rows[label].to_numpy(int))
    return TamperModel(list(columns), mean.tolist(), scale.tolist(), coefficients.tolist(), bias)


def factory_probability(readings: DataFrame, model: TamperModel, columns: list[str], key: str = "factory_id") -> DataFrame:
    """(key, probability): each factory's readings aggregated as in training, then scored; no Python in the plan."""
    rows = factory_aggregates(readings, columns, key)
    return rows.select(key, model.probability(rows.columns).alias("probability"))


def save_tamper_model(spark, model: TamperModel, path: str) -> None:
    """The model as one row of JSON in a folder of any store that the cluster knows."""
    spark.createDataFrame([(json.dumps(asdict(model)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_tamper_model(spark, path: str) -> TamperModel:
    return TamperModel(**json.loads(spark.read.text(path, wholetext=True).first().value))


def gates(scored: DataFrame, rate: float | None = None, count: str | None = None) -> DataFrame:
    """One row: auc, flag_rate, spearman and passes of leave-one-out probabilities, by ranks, so no pairs are made.

    The flag rate must lie within 0.15 of ``rate``, by default the share of positive labels.  With ``count``, the
    number of triggers, probabilities must also rank as it does; without it spearman is null and not judged.
    A table of factories is ranked in one task.
    """

    def ranked(df: DataFrame, column: str, name: str) -> DataFrame:
        same = F.count(F.lit(1)).over(W.partitionBy(column))
        return df.withColumn(name, F.rank().over(W.orderBy(column)) + (same - 1) / 2.0)

    rows = ranked(scored, "probability", "r")
    rows = ranked(rows, count, "rc") if count else rows.withColumn("rc", F.lit(None).cast("double"))
    pos, n = F.sum("label"), F.count(F.lit(1))
    auc = F.try_divide(F.sum(F.when(F.col("label") == 1, F.col("r"))) - pos * (pos + 1) / 2, (pos * (n - pos)).cast("double"))
    rho = F.try_divide(F.covar_pop("r", "rc"), F.stddev_pop("r") * F.stddev_pop("rc"))
    out = rows.agg(auc.alias("auc"), F.avg((F.col("probability") >= 0.5).cast("double")).alias("flag_rate"), rho.alias("spearman"), F.avg("label").alias("_rate"))
    near = F.abs(F.col("flag_rate") - (F.col("_rate") if rate is None else F.lit(rate))) <= 0.15
    alike = F.coalesce(F.col("spearman") >= 0.6, F.lit(False)) if count else F.lit(True)
    return out.withColumn("passes", F.coalesce((F.col("auc") >= 0.75) & near, F.lit(False)) & alike).drop("_rate")


def linear_attribution(df: DataFrame, key: str, columns: list[str], coefficients: list[float]) -> DataFrame:
    """(key, feature, raw_value, shap): coefficient * (value - mean), rounded; exact for a linear model."""
    means = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns))
    met = df.crossJoin(F.broadcast(means))
    rows = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("raw_value"), F.round(F.lit(float(b)) * (F.col(c) - F.col(f"_m_{c}")), 4).alias("shap")) for c, b in zip(columns, coefficients)))
    by_size = F.array_sort(rows, lambda a, b: F.when(F.abs(a["shap"]) > F.abs(b["shap"]), -1).when(F.abs(a["shap"]) < F.abs(b["shap"]), 1).otherwise(0))
    return met.select(key, F.posexplode(by_size).alias("place", "f")).select(key, "place", "f.*")


def centres(x: np.ndarray, k: int, seed: int = 42, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(centres, weights): ``k`` clusters of a small table (or one for each distinct row, if these are fewer), weighted by their shares.

    Seeds are drawn in proportion to the squared distance from those drawn; each coordinate of a centre is then the nearest value that
    the column has, so that no impossible value comes up.
    """
    rng, rows = np.random.default_rng(seed), np.unique(x, axis=0)
    if len(rows) <= k:
        chosen = rows
    else:
        chosen = x[[rng.integers(len(x))]]
        far = ((x - chosen[0]) ** 2).sum(1)
        while len(chosen) < k:
            chosen = np.vstack([chosen, x[rng.choice(len(x), p=far / far.sum())]])
            far = np.minimum(far, ((x - chosen[-1]) ** 2).sum(1))
    for _ in range(rounds if len(rows) > k else 0):
        own = ((x[:, None] - chosen[None]) ** 2).sum(2).argmin(1)
        moved = np.array([x[own == c].mean(0) if (own == c).any() else chosen[c] for c in range(k)])
        if np.allclose(moved, chosen):
            break
        chosen = moved
    own = ((x[:, None] - chosen[None]) ** 2).sum(2).argmin(1)
    weights = np.bincount(own, minlength=len(chosen)) / len(x)
    nearest = np.column_stack([x[np.abs(x[:, [c]] - chosen[:, c]).argmin(0), c] for c in range(x.shape[1])])
    return nearest[weights > 0], weights[weights > 0]


def background_of(df: DataFrame, model: IsolationForest, columns: list[str], order: list[str], clusters: int = 30, of: int = 1500, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(rows, weights): the centres of ``clusters`` clusters of at most ``of`` rows of least keyed hash, in the forest's own scale; missing values are 0."""
    u = scalars.uniform(seed, *map(F.col, order))
    x = df.select(*(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c) for c in columns), u.alias("_u")).orderBy("_u", *columns).limit(of).drop("_u").toPandas().to_numpy(float)
    rows, weights = centres((x - model.mean) / model.scale, clusters, seed)
    return rows * model.scale + model.mean, weights


def coalitions(k: int, samples: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(masks, weights) of the kernel: all proper coalitions of ``k`` features if they are no more than ``samples``, else drawn ones."""
    if k < 2:
        return np.empty((0, k), bool), np.empty(0)
    if 2**k - 2 <= samples:
        mask = (np.arange(1, 2**k - 1)[:, None] >> np.arange(k)) & 1 == 1
        size = mask.sum(1)
        return mask, (k - 1) / (np.array([comb(k, int(s)) for s in size]) * size * (k - size))
    mask = rng.random((samples, k)) < rng.random((samples, 1))
    mask = mask[(mask.sum(1) > 0) & (mask.sum(1) < k)]
    size = mask.sum(1)
    return mask, (k - 1) / (size * (k - size))


def shapley(of, x: np.ndarray, base: np.ndarray, share: np.ndarray, mask: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The shares of each row of ``x``: they sum to its score less the expectation over ``base`` with the weights ``share``."""
    k, floor, out = x.shape[1], float(of(base) @ share), []
    z = mask[:, :-1].astype(float) - mask[:, -1:]
    for row in x:
        gain = float(of(row[None])[0]) - floor
        if len(mask):
            mixed = np.where(mask[:, None, :], row, base[None]).reshape(-1, k)
            y = of(mixed).reshape(len(mask), -1) @ share - floor
            phi = np.linalg.lstsq(z * np.sqrt(weight)[:, None], (y - mask[:, -1] * gain) * np.sqrt(weight), rcond=None)[0]
        else:
            phi = np.zeros(k - 1)
        out.append(np.append(phi, gain - phi.sum()))
    return np.array(out)


def kernel_attribution(df: DataFrame, model: IsolationForest, key: str, columns: list[str], order: list[str], rows: int = 150, background: int = 30, samples: int = 100, seed: int = 42, of: int = 1500) -> DataFrame:
    """(key, feature, shap): the mean Shapley estimate of the anomaly score over ``rows`` hash-sampled readings of each key.

    Missing features come from ``background`` weighted cluster centres of at most ``of`` rows of all factories, which are one
    background for all; coalitions are drawn (or all taken, if they are few), and a weighted least squares fit that sums to
    the score less its expectation gives the shares.
    """
    base, share = background_of(df, model, columns, order, background, of, seed)
    shared = df.sparkSession.sparkContext.broadcast((model, base, share))
    u = scalars.uniform(seed, *map(F.col, order))
    picked = df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(u, *order))).filter(F.col("_n") <= rows)

    def explain(pdf: pd.DataFrame) -> pd.DataFrame:
        forest, base, share = shared.value
        x = pdf.sort_values("_n")[columns].astype(float).fillna(0.0).to_numpy()
        mask, weight = coalitions(len(columns), samples, np.random.default_rng(seed))
        return pd.DataFrame({key: pdf[key].iloc[0], "feature": columns, "shap": shapley(forest.score, x, base, share, mask, weight).mean(0)})

    kind = df.schema[key].dataType.simpleString()
    return picked.groupBy(key).applyInPandas(explain, f"`{key}` {kind}, feature string, shap double")


def _as_text(model: IsolationForest) -> str:
    return json.dumps({"mean": model.mean.tolist(), "scale": model.scale.tolist(), "norm": model.norm, "roots": model.roots})


def _of_text(text: str) -> IsolationForest:
    d = json.loads(text)
    tree = lambda n: (int(n[0]), n[1], tree(n[2]), tree(n[3])) if isinstance(n, list) else n
    out = IsolationForest(len(d["roots"]))
    out.mean, out.scale, out.norm, out.roots = np.array(d["mean"]), np.array(d["scale"]), d["norm"], [tree(r) for r in d["roots"]]
    return out


def save_forest(spark, model: IsolationForest, path: str) -> None:
    """The model as one row of JSON in a folder of any store that the cluster knows."""
    spark.createDataFrame([(_as_text(model),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_forest(spark, path: str) -> IsolationForest:
    return _of_text(spark.read.text(path, wholetext=True).first().value)
