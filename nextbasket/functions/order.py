"""Running totals and exact quantiles of ordered rows, without a task that sorts them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: Column, out: str) -> DataFrame:
    """df with out: the sum of amount over the rows of the same keys up to this one, in the given order, which has to be total.

    Rows are dealt to ranges and written once, so that both passes see the same ranges; a range adds the sums of those before it.
    """
    by = [*keys, *order]
    parts = written(df.withColumn("_amount", amount).repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy(*keys, "_part").agg(F.sum("_amount").alias("_sum"))  # a row for each range and key in it
    before = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*keys, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.sum("_amount").over(Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    offsets = offsets.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_p"), "_before")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_part") == F.col("_p")]
    rows = parts.withColumn("_own", own).join(offsets, same)
    return rows.select(*df.columns, (F.col("_own") + F.col("_before")).alias(out))


def median(df: DataFrame, value: str) -> float | None:
    """Of all rows, exact; None if there is no value."""
    row = quantiles(df.select(F.lit(1).alias("_all"), F.col(value).cast("double").alias(value)), "_all", value, [0.5]).first()
    return row["q"] if row else None


def quantile_sketches(df: DataFrame, keys: Sequence[str], value: str, k: int = 800) -> DataFrame:
    """keys, sketch: of each key's values, of a size that k sets whatever their number; sketches of days can be kept and merged later. Nulls are left out."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, keys: Sequence[str], at: Sequence[float]) -> DataFrame:
    """keys, p, q: values whose rank is within about 2.3 / k of p * rows (99 of 100 times), from merged sketches: one task merges those of a key."""
    merged = sketches.groupBy(*keys).agg(F.collect_list("sketch").alias("_all"))
    one = F.aggregate(F.slice("_all", 2, F.greatest(F.size("_all") - 1, F.lit(0))), F.get("_all", F.lit(0)), F.kll_sketch_merge_double)
    found = F.arrays_zip(F.array(*map(F.lit, at)).alias("p"), F.kll_sketch_get_quantile_double(one, F.array(*map(F.lit, at))).alias("q"))
    return merged.select(*keys, F.inline(found))


def quantiles(df: DataFrame, key: str, value: str, at: Sequence[float]) -> DataFrame:
    """key, p, q: for each of the shares p the exact quantile of value, between two values by linear interpolation. Nulls are left out."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    ends = running(counts, [key], [value], F.col("_n"), "_end")
    wanted = counts.groupBy(key).agg(F.sum("_n").alias("_rows")).select(F.col(key).alias("_key"), "_rows", F.explode(F.array(*map(F.lit, at))).alias("p"))
    wanted = wanted.withColumn("_at", F.col("p") * (F.col("_rows") - 1)).select("_key", "p", "_at", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_place"))
    hit = ends.join(F.broadcast(wanted), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_place") < F.col("_end")) & (F.col("_place") >= F.col("_end") - F.col("_n")))  # a few rows for each key
    share = F.when(F.col("_place") == F.col("_at"), 1.0).otherwise(1 - F.abs(F.col("_place") - F.col("_at")))
    return hit.groupBy(key, "p").agg(F.sum(F.col(value) * share).alias("q"))
