"""Training and prediction on feature tables with pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import filled_with_mean
from ..operators.aggregates import best_of, rmse
from ..operators.ranks import ranked
from ..tables import stored
from .evaluation import Split
from .movements import NAMES, Names
from .registry import families, leaving_out

#: A number that no feature takes, for unknown values: trees send it to one side.
UNKNOWN = -1e9


def level_codes(df: DataFrame, column: str) -> DataFrame:
    """level and code: all of the column's values in order, from 0."""
    levels = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("level")).distinct()
    return ranked(levels, [F.col("level").asc()], "_place").select("level", (F.col("_place") - 1).cast("int").alias("code"))


def encode(df: DataFrame, codes: dict[str, DataFrame]) -> DataFrame:
    """df with each column replaced by its code; null and unknown levels get -1."""
    for c, table in codes.items():
        t = table.select(F.col("level").alias("_level"), F.col("code").alias("_code"))
        df = df.join(t, F.col(f"`{c}`").cast("string") == F.col("_level"), "left").withColumn(c, F.coalesce("_code", F.lit(-1)).cast("double")).drop("_level", "_code")
    return df


@dataclass
class Encoder:
    """What was learned on the training side, carried to the other unchanged."""

    columns: list[str]
    codes: dict[str, DataFrame] = field(default_factory=dict)
    gaps: list[str] = field(default_factory=list)

    def fit(self, df: DataFrame) -> Encoder:
        text = [c for c in self.columns if isinstance(df.schema[c].dataType, T.StringType)]
        self.codes = {c: level_codes(df, c) for c in text}
        numbers = [c for c in self.columns if c not in text]
        if numbers:
            known = df.agg(*[F.coalesce(F.min(self._number(c).isNotNull()), F.lit(True)).alias(c) for c in numbers]).first()
            self.gaps = [c for c in numbers if not known[c]]
        return self

    def _number(self, c: str):
        # float32 as in the published matrix; not a number is unknown
        x = F.col(f"`{c}`").cast("float").cast("double")
        return F.when(~F.isnan(x), x)

    def transform(self, df: DataFrame) -> DataFrame:
        """df with `features`: unknown numbers are UNKNOWN, with a flag for each column that had some in training."""
        df = encode(df, self.codes)
        flags = {f"_gap{i}": self._number(c).isNull().cast("double") for i, c in enumerate(self.gaps)}
        df = df.withColumns(flags) if flags else df
        df = df.withColumns({c: F.coalesce(self._number(c), F.lit(UNKNOWN)) for c in self.columns})
        return VectorAssembler(inputCols=[*self.columns, *flags], outputCol="features").transform(df).drop(*flags)


def train_predict(split: Split, columns: Sequence[str], residual: bool = True, seeds: Sequence[int] = (1,), rounds: int = 20, depth: int = 5, rate: float = 0.1, n: Names = NAMES) -> DataFrame:
    """The held-out rows with prediction: the mean over seeds, at least 0.

    residual: the model learns the target less the reference, each side's unknown references filled with its own mean.
    """
    # levels, gaps, the mean and the trees each read the training side: what it is made of is computed once
    known = stored(split.fit.select(*dict.fromkeys([*columns, "reference_sec", n.taxi])), "training")
    encoder = Encoder(list(columns)).fit(known)
    side = lambda d: encoder.transform(filled_with_mean(d.withColumn("_ref", F.col("reference_sec").cast("double")), "_ref").withColumn("_y", F.col(n.taxi).cast("double")))
    fit, held = side(known), side(split.held)
    if residual:
        fit = fit.withColumn("_y", F.col("_y") - F.col("_ref"))
    total = F.lit(0.0)
    for seed in seeds:
        model = GBTRegressor(featuresCol="features", labelCol="_y", predictionCol=f"_p{seed}", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed).fit(fit.select("features", "_y"))
        held = model.transform(held)
        total = total + F.col(f"_p{seed}")
    mean = total / len(seeds)
    held = held.withColumn("prediction", F.greatest(mean + F.col("_ref") if residual else mean, F.lit(0.0)))
    return held.drop("features", "_ref", "_y", *[f"_p{s}" for s in seeds])


def ablation(split: Split, score: Callable[[list[str]], DataFrame] | None = None, n: Names = NAMES, **settings) -> list[tuple[str, int, float]]:
    """Name, columns and error of the model with all families, then without each in turn."""
    score = score or (lambda columns: train_predict(split, columns, n=n, **settings))
    out = []
    for name in ("all", *families()):
        columns = list(split.columns) if name == "all" else leaving_out(split.columns, name)
        if columns and (name == "all" or len(columns) < len(split.columns)):
            out.append((name, len(columns), score(columns).agg(rmse("prediction", n.taxi)).first()[0]))
    return out


def leaderboard(items: DataFrame, team: str = "team", score: str = "score", at: str = "submitted") -> DataFrame:
    """Each team's best score, the first of equals, with its rank."""
    return ranked(best_of(items, [team], score, [at]), [F.col(score).asc(), F.col(at).asc(), F.col(team).asc()], "rank")
