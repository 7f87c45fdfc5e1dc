"""Robust statistics per group and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Multiples of the deviation for the insert-size cutoff, and the cutoff of unknown groups (fixed values).
TUMOUR_MULT, NORMAL_MULT, UNKNOWN_CUTOFF = 3.92, 3.60, 2000


def trimmed_location(df: DataFrame, key: str, value: str, keep: float = 0.98) -> DataFrame:
    """(key, n_kept, median, sd): of the lowest ``keep`` share of each group, at least one; sd is about the median.

    Equal values are counted before they are ranked, so a group costs its distinct values and not its rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_c"))
    order = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    kept = F.greatest(F.lit(1), F.floor(F.sum("_c").over(whole) * F.lit(keep)))
    ranked = counts.withColumn("_to", F.sum("_c").over(order)).withColumn("_keep", kept).withColumn("_from", F.col("_to") - F.col("_c"))
    ranked = ranked.where("_from < _keep").withColumn("_c", F.least("_to", "_keep") - F.col("_from"))
    at = lambda k: F.max(F.when((F.col("_from") < k) & (k <= F.col("_from") + F.col("_c")), F.col(value)))
    low, high = F.floor((F.col("_keep") + 1) / 2), F.floor(F.col("_keep") / 2) + 1
    med = ranked.groupBy(key).agg(F.max("_keep").alias("n_kept"), ((at(low) + at(high)) / 2).alias("median"))
    met = ranked.join(med, key)
    spread = met.groupBy(key).agg(F.first("n_kept").cast("long").alias("n_kept"), F.first("median").alias("median"), F.sqrt(F.sum(F.col("_c") * F.pow(F.col(value) - F.col("median"), F.lit(2.0))) / F.first("n_kept")).alias("sd"))
    return spread


def cutoff(median: Column, sd: Column, tumour: Column) -> Column:
    """Truncated median plus a multiple of the deviation; UNKNOWN_CUTOFF where there is no estimate."""
    mult = F.when(tumour, TUMOUR_MULT).otherwise(NORMAL_MULT)
    return F.coalesce((median + sd * mult).cast("int"), F.lit(UNKNOWN_CUTOFF))


def ranked_picks(df: DataFrame, keys: list[str], value: str, picks: dict[str, Column]) -> DataFrame:
    """(keys, one column for each pick): the value at a rank (from 0) that a Column gives in terms of ``_n``, the group's size."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_to", F.sum("_c").over(order)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    inside = lambda k: (F.col("_to") > k) & (F.col("_to") - F.col("_c") <= k)
    return ranked.groupBy(*keys).agg(*(F.max(F.when(inside(k), F.col(value))).alias(name) for name, k in picks.items()))


def histogram(df: DataFrame, value: str, n: int, low: float, high: float) -> DataFrame:
    """(bin, n): equal bins from ``low`` to ``high``; what lies outside counts in the end bins."""
    width = (high - low) / n
    at = F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((F.col(value) - low) / width)))
    return df.where(F.col(value).isNotNull()).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group under a total order; adds ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)
