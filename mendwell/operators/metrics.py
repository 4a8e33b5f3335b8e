"""Counters, rates and nearest-rank percentiles of samples.

Percentiles are taken from counts of rounded values: rounding to the reported two digits keeps the order, so the nearest
rank of the rounded values is the rounded nearest rank, and a client with a tenth of all samples arrives as one row a
distinct value instead of all its rows.

Defined results: samples without a measure don't count in that measure; no samples give zeros, and a share within
budget of 1; negative measures count as they are; repeated rows count each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C


def hundredths(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def percentiles(samples: DataFrame, by: list[str], value: str = "ms") -> DataFrame:
    """(by..., n, p50, p95, p99, min, max, mean)."""
    counts = samples.filter(F.col(value).isNotNull()).groupBy(*by, hundredths(F.col(value)).alias("v")).agg(F.count("*").alias("c"), F.sum(F.col(value).cast("decimal(20,6)")).alias("s"))  # exact: the order of adding mustn't show
    w = Window.partitionBy(*by)
    upto = F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    rows = counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(w))
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * p / 100), F.col("v")))
    return rows.groupBy(*by).agg(
        F.max("n").alias("n"), at(50).alias("p50"), at(95).alias("p95"), at(99).alias("p99"), F.min("v").alias("min"), F.max("v").alias("max"), hundredths(F.sum("s").cast("double") / F.max("n")).alias("mean")
    )


def share(condition: Column, of: Column, empty: float) -> Column:
    """Share of the rows where ``of`` holds that meet the condition too; what an empty set gives is a parameter."""
    n = F.sum(F.coalesce(of, F.lit(False)).cast("bigint"))
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(empty)).otherwise(hundredths(F.sum((F.coalesce(of, F.lit(False)) & F.coalesce(condition, F.lit(False))).cast("bigint")) / n))


def summary(samples: DataFrame, by: list[str]) -> DataFrame:
    have = F.lit(True)
    return samples.groupBy(*by).agg(
        F.count("*").alias("requests"),
        share(F.col("hit"), have, 0.0).alias("hit_rate"),
        share(F.coalesce("contexts", F.lit(0)) == 0, have, 0.0).alias("empty_rate"),
        share(F.col("ms") < C.BUDGET_MS, F.col("ms").isNotNull(), 1.0).alias("within_budget"),
    )


def newest(samples: DataFrame, n: int = C.SAMPLES_KEPT) -> DataFrame:
    """The samples that a store of n keeps; the limit is the feature."""
    return samples.filter("t IS NOT NULL").orderBy(F.col("t").desc(), F.col("sample_id").desc()).limit(n)
