"""The prediction file: rules, versions, and one file in the template's order."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY, VALUE = "MVT_ID_mvt", "TAXITIME_SEC_mvt"
# The file's name, and the limits that warn.
FILE_NAME = r"^(?P<team>.+)_v(?P<version>\d+)\.parquet$"
LONG, SHORT, MEAN_LOW, MEAN_HIGH = 7200, 60, 300, 1800


class InvalidPrediction(ValueError):
    pass


def findings(pred: DataFrame, template: DataFrame, key: str = KEY, value: str = VALUE) -> DataFrame:
    """One row with every count that the rules need, from one pass over the predictions and one join of the keys."""
    v = F.col(value).cast("double")
    number = v.isNotNull() & ~F.isnan(v)
    finite = number & (F.abs(v) < F.lit(float("inf")))
    counts = pred.agg(
        F.count("*").alias("n"), F.count_distinct(key).alias("n_keys"), F.count_if(v.isNull()).alias("n_null"), F.count_if(F.isnan(v)).alias("n_nan"),
        F.count_if(number & (F.abs(v) == F.lit(float("inf")))).alias("n_infinite"), F.count_if(finite & (v < 0)).alias("n_negative"),
        F.count_if(finite & (v > LONG)).alias("n_long"), F.count_if(finite & (v < SHORT)).alias("n_short"), F.avg(F.when(finite, v)).alias("mean"),
    )
    a, b = template.select(key).distinct().withColumn("_t", F.lit(1)), pred.select(key).distinct().withColumn("_p", F.lit(1))
    keys = a.join(b, key, "full").agg(F.count_if(F.col("_p").isNull()).alias("n_absent"), F.count_if(F.col("_t").isNull()).alias("n_extra"))
    size = template.agg(F.count("*").alias("n_template"))
    one = lambda d: d.withColumn("_one", F.lit(1))
    return one(counts).join(one(keys), "_one").join(one(size), "_one").drop("_one")


def validate(pred: DataFrame, template: DataFrame, key: str = KEY, value: str = VALUE) -> list[str]:
    """The warnings; raises at the first rule that is broken."""
    for c in (key, value):
        if c not in pred.columns:
            raise InvalidPrediction(f"column missing: {c}")
    f = findings(pred, template, key, value).first()
    rules = (
        (f.n != f.n_template, f"{f.n} rows instead of {f.n_template}"),
        (f.n_keys != f.n, f"{f.n - f.n_keys} keys occur again"),
        (f.n_absent, f"{f.n_absent} keys are absent"),
        (f.n_extra, f"{f.n_extra} keys are not in the template"),
        (f.n_null, f"{f.n_null} values are null"),
        (f.n_nan, f"{f.n_nan} values are not numbers"),
        (f.n_infinite, f"{f.n_infinite} values are infinite"),
        (f.n_negative, f"{f.n_negative} values are below 0"),
    )
    for broken, text in rules:
        if broken:
            raise InvalidPrediction(text)
    warnings = []
    if f.n_long:
        warnings.append(f"{f.n_long} values are above {LONG} s")
    if f.n_short:
        warnings.append(f"{f.n_short} values are below {SHORT} s")
    if f.mean is not None and not MEAN_LOW <= f.mean <= MEAN_HIGH:
        warnings.append(f"the mean, {f.mean:.1f} s, is outside {MEAN_LOW} to {MEAN_HIGH}")
    return warnings


def _fs(spark: SparkSession, path: str):
    """The path in Spark's file systems, local or not, and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def next_version(folder: str, team: str, spark: SparkSession | None = None) -> int:
    """One more than the team's last version in the folder."""
    spark = spark or SparkSession.active()
    p, fs = _fs(spark, folder)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    found = [re.match(FILE_NAME, x) for x in names]
    return 1 + max([0, *(int(m["version"]) for m in found if m and m["team"] == team)])


def with_position(template: DataFrame) -> DataFrame:
    """The template, read from one file as one partition, with each row's place in it."""
    return template.coalesce(1).withColumn("_pos", F.monotonically_increasing_id())


def fill_missing(pred: DataFrame, template: DataFrame, key: str = KEY, value: str = VALUE) -> DataFrame:
    """Predictions for exactly the template's keys; those without one get the median."""
    mid = pred.agg(F.median(value).cast(pred.schema[value].dataType)).scalar()
    absent = template.select(key).join(pred.select(key), key, "left_anti").select(key, mid.alias(value))
    return pred.select(key, value).join(template.select(key), key, "left_semi").unionByName(absent)


def write(pred: DataFrame, template: DataFrame, folder: str, name: str, key: str = KEY, value: str = VALUE) -> list[str]:
    """Validates, then writes one file in the template's order; the warnings.

    The file is made in a folder beside it and renamed when it is whole, in whatever file system the folder is.
    """
    if not re.match(FILE_NAME, name):
        raise InvalidPrediction(f"not a prediction file's name: {name}")
    warnings = validate(pred, template, key, value)
    rows = with_position(template.select(key)).join(pred.select(key, value), key, "left").orderBy("_pos").select(key, value)
    parts = f"{folder.rstrip('/')}/_{name}.parts"
    rows.coalesce(1).write.mode("overwrite").parquet(parts)
    p, fs = _fs(pred.sparkSession, parts)
    made = next(f.getPath() for f in fs.listStatus(p) if f.getPath().getName().startswith("part-"))
    end, _ = _fs(pred.sparkSession, f"{folder.rstrip('/')}/{name}")
    fs.delete(end, False)
    if not fs.rename(made, end):
        raise OSError(f"can't rename {made} to {end}")
    fs.delete(p, True)
    return warnings
