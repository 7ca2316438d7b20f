"""Sales analytics at full table size; no samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import quantiles
from ..functions.ranks import age_group
from .prep import histogram


def profile_table(df: DataFrame) -> DataFrame:
    """column, dtype, rows, non_null, n_distinct, null_pct: distinct values in two steps, column by column, so each column is read once and no row is copied for another."""
    out = None
    for c, t in df.dtypes:
        counts = df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))
        rows, known = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0))
        one = counts.agg(F.lit(c).alias("column"), F.lit(t).alias("dtype"), rows.alias("rows"), known.alias("non_null"), F.count("value").alias("n_distinct"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("null_pct", 100 * (1 - F.col("non_null") / F.nullif("rows", F.lit(0))))


def weekly_activity(tx: DataFrame) -> DataFrame:
    """week, tx, customers, articles, revenue of whole weeks; distinct customers and articles in two steps."""
    rows = tx.withColumn("week", F.date_trunc("week", "t_dat").cast("date"))
    sums = rows.groupBy("week").agg(F.count("*").alias("tx"), F.sum("price").alias("revenue"))
    for key, out in (("customer_id", "customers"), ("article_id", "articles")):
        sums = sums.join(rows.groupBy("week", key).agg(F.lit(1).alias("one")).groupBy("week").agg(F.count(key).alias(out)), "week")
    newest = tx.agg(F.date_trunc("week", F.max("t_dat")).cast("date").alias("newest"))
    return sums.crossJoin(F.broadcast(newest)).where("week < newest").select("week", "tx", "customers", "articles", "revenue")


def daily_sketches(tx: DataFrame, bits: int = 12) -> DataFrame:
    """t_dat, tx, revenue and sketches of the day's customers and articles (2**bits small counters each): a table that grows by a row a day and answers for any period."""
    return tx.groupBy("t_dat").agg(F.count("*").alias("tx"), F.sum("price").alias("revenue"), *(F.hll_sketch_agg(c, F.lit(bits)).alias(f"{c}_sketch") for c in ("customer_id", "article_id")))


def activity(daily: DataFrame, period: str = "week") -> DataFrame:
    """period, tx, customers, articles, revenue from daily_sketches; the distinct counts are estimates with a standard error of about 1.04 / sqrt(2**bits)."""
    merged = daily.groupBy(F.date_trunc(period, "t_dat").cast("date").alias(period)).agg(F.sum("tx").alias("tx"), *(F.hll_union_agg(f"{c}_sketch").alias(c) for c in ("customer_id", "article_id")), F.sum("revenue").alias("revenue"))
    return merged.select(period, "tx", F.hll_sketch_estimate("customer_id").alias("customers"), F.hll_sketch_estimate("article_id").alias("articles"), "revenue")


def channel_summary(tx: DataFrame) -> DataFrame:
    rows = tx.groupBy("sales_channel_id").agg(F.count("*").alias("tx"), F.avg("price").alias("mean_price"))
    return rows.withColumn("share", F.col("tx") / F.sum("tx").over(Window.partitionBy(F.lit(1))))  # two rows


def price_histogram(tx: DataFrame, bins: int = 80) -> DataFrame:
    ends = tx.agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    at = F.least(F.floor((F.col("price") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    return tx.select("price").crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def _channels(tx: DataFrame) -> DataFrame:
    """channel ('all' and each one), price: every row twice."""
    return tx.select(F.explode(F.array(F.lit("all"), F.col("sales_channel_id").cast("string"))).alias("channel"), "price")


def price_quantiles(tx: DataFrame, at: Sequence[float] = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """channel ('all' for all rows), q25...: exact, from the counts of prices."""
    q = quantiles(_channels(tx), "channel", "price", at)
    return q.groupBy("channel").agg(*(F.max(F.when(F.col("p") == p, F.col("q"))).alias(f"q{round(100 * p)}") for p in at))


def price_box(tx: DataFrame) -> DataFrame:
    """channel, q25, q50, q75, lo, hi, outliers: the whiskers are the outermost prices within 1.5 times the range of the middle half."""
    rows = tx.select(F.col("sales_channel_id").cast("string").alias("channel"), "price")
    q = quantiles(rows, "channel", "price", (0.25, 0.5, 0.75))
    q = q.groupBy("channel").agg(*(F.max(F.when(F.col("p") == p, F.col("q"))).alias(f"q{round(100 * p)}") for p in (0.25, 0.5, 0.75)))
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    within = F.col("price").between(F.col("q25") - reach, F.col("q75") + reach)
    x = rows.join(F.broadcast(q), "channel")  # a row for each channel
    return x.groupBy("channel", "q25", "q50", "q75").agg(F.min(F.when(within, F.col("price"))).alias("lo"), F.max(F.when(within, F.col("price"))).alias("hi"), F.count(F.when(~within, 1)).alias("outliers"))


def age_distribution(customers: DataFrame) -> DataFrame:
    return customers.agg(F.avg("age").alias("mean"), F.median("age").alias("median"), F.count("age").alias("n"))


def age_histogram(customers: DataFrame, bins: int = 50) -> DataFrame:
    """bin, customers: equal bins between the smallest and the largest age."""
    return histogram(customers, "age", customers.agg(F.min("age").alias("lo"), F.max("age").alias("hi")), bins).agg(F.count("*").alias("customers"))


def value_counts(df: DataFrame, columns: Sequence[str], n: int = 20) -> DataFrame:
    """column, value, n: the n most frequent values of each column, one pass."""
    long = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], list(columns), "column", "value")
    counts = long.where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("place") <= n).drop("place")


def purchase_frequency(tx: DataFrame, clip: int = 100) -> DataFrame:
    per = tx.groupBy("customer_id").agg(F.count("*").alias("c"))
    return per.groupBy(F.least("c", F.lit(clip)).alias("purchases")).agg(F.count("*").alias("customers"))


def purchase_stats(tx: DataFrame) -> DataFrame:
    """statistic, value: of the purchases of a customer, to one digit."""
    per = tx.groupBy("customer_id").agg(F.count("*").cast("double").alias("c"))
    one = per.agg(F.count("*").cast("double").alias("count"), F.avg("c").alias("mean"), F.stddev_samp("c").alias("std"), F.min("c").alias("min"), F.max("c").alias("max")).unpivot([], ["count", "mean", "std", "min", "max"], "statistic", "value")
    q = quantiles(per.withColumn("every", F.lit(1)), "every", "c", (0.25, 0.5, 0.75)).select(F.concat(F.round(F.col("p") * 100).cast("int").cast("string"), F.lit("%")).alias("statistic"), F.col("q").alias("value"))
    return one.unionByName(q).withColumn("value", F.round("value", 1))


def purchase_cdf(tx: DataFrame) -> DataFrame:
    counts = tx.groupBy("customer_id").agg(F.count("*").alias("purchases")).groupBy("purchases").agg(F.count("*").alias("customers"))
    w = Window.partitionBy(F.lit(1))  # a row for each distinct count
    return counts.select("purchases", "customers", (F.sum("customers").over(w.orderBy("purchases")) / F.sum("customers").over(w)).alias("cdf"))


def cdf_thresholds(cdf: DataFrame, at: Sequence[float] = (0.5, 0.8, 0.95)) -> DataFrame:
    return cdf.agg(*(F.min(F.when(F.col("cdf") >= p, F.col("purchases"))).alias(f"p{round(100 * p)}") for p in at))


def top_articles(tx: DataFrame, articles: DataFrame, n: int = 20) -> DataFrame:
    best = tx.groupBy("article_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "article_id").limit(n)
    return articles.select("article_id", "prod_name").join(F.broadcast(best), "article_id", "right")


def article_histogram(tx: DataFrame, clip: int = 3000, bins: int = 60) -> DataFrame:
    """bin, articles: articles by their sales, clipped, in equal bins between the smallest and the largest."""
    per = tx.groupBy("article_id").agg(F.least(F.count("*"), F.lit(clip)).alias("c"))
    return histogram(per, "c", per.agg(F.min("c").alias("lo"), F.max("c").alias("hi")), bins).agg(F.count("*").alias("articles"))


def unsold_articles(tx: DataFrame, articles: DataFrame) -> DataFrame:
    sold = tx.select("article_id").distinct().withColumn("sold", F.lit(True))
    return articles.join(sold, "article_id", "left").agg(F.count(F.when(F.col("sold").isNull(), 1)).alias("unsold"), F.count("sold").alias("sold"))


def largest_groups(articles: DataFrame, n: int = 8) -> DataFrame:
    """product_group_name: the n with the most articles in the catalogue."""
    counts = articles.where("product_group_name is not null").groupBy("product_group_name").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "product_group_name").limit(n).select("product_group_name")


def age_product_pivot(tx: DataFrame, customers: DataFrame, articles: DataFrame, n: int = 8) -> DataFrame:
    """age_group, product_group_name, tx, pct: per cent of an age group's purchases in each of the n largest product groups; the others are in the base too."""
    x = tx.join(customers.select("customer_id", age_group(F.col("age")).alias("age_group")), "customer_id").join(articles.select("article_id", "product_group_name"), "article_id").where("age_group is not null and product_group_name is not null")
    counts = x.groupBy("age_group", "product_group_name").agg(F.count("*").alias("tx"))
    base = counts.groupBy("age_group").agg(F.sum("tx").alias("base"))
    every = base.crossJoin(F.broadcast(largest_groups(articles, n)))  # age groups x n
    return every.join(counts, ["age_group", "product_group_name"], "left").select("age_group", "product_group_name", F.coalesce("tx", F.lit(0)).alias("tx"), (100 * F.coalesce("tx", F.lit(0)) / F.col("base")).alias("pct"))


def repeat_rate(tx: DataFrame) -> DataFrame:
    share = tx.groupBy("customer_id", "article_id").agg(F.count("*").alias("n")).groupBy("customer_id").agg(F.avg((F.col("n") > 1).cast("double")).alias("r"))
    return share.agg(F.avg("r").alias("mean"), F.avg((F.col("r") == 0).cast("double")).alias("share_0"), F.avg((F.col("r") > 0.5).cast("double")).alias("share_over_half"))


def monthly_price_ci(tx: DataFrame, articles: DataFrame, groups: Sequence[str]) -> DataFrame:
    x = tx.join(articles.where(F.col("product_group_name").isin(*groups)).select("article_id", "product_group_name"), "article_id")
    x = x.groupBy("product_group_name", F.trunc("t_dat", "month").alias("month")).agg(F.avg("price").alias("mean"), F.count("*").alias("n"), F.stddev_samp("price").alias("std"))
    se = F.col("std") / F.sqrt("n")
    return x.withColumns({"se": se, "lo": F.col("mean") - 1.96 * se, "hi": F.col("mean") + 1.96 * se})


CATEGORY = ("index_group_name", "index_name", "product_type_name")


def monthly_category_share(tx: DataFrame, articles: DataFrame, columns: Sequence[str] = CATEGORY) -> DataFrame:
    """category, month (each of the table), pct: per cent of the category's sales; 0 without sales. A category with a null name is left out."""
    named = articles.select("article_id", F.concat(*(e for i, c in enumerate(columns) for e in ([F.lit(" | ")] if i else []) + [F.col(c)])).alias("category"))
    counts = tx.join(named.where("category is not null"), "article_id").groupBy("category", F.trunc("t_dat", "month").alias("month")).agg(F.count("*").alias("n"))
    base = counts.groupBy("category").agg(F.sum("n").alias("base"))
    every = base.crossJoin(F.broadcast(tx.select(F.trunc("t_dat", "month").alias("month")).distinct()))  # months are few
    return every.join(counts, ["category", "month"], "left").select("category", "month", (100 * F.coalesce("n", F.lit(0)) / F.col("base")).alias("pct"))


def season_clusters(shares: DataFrame, k: int = 4, seed: int = 42) -> DataFrame:
    """cluster, n: standardised shares of all months, two principal components, a Gaussian mixture."""
    months = [r[0] for r in shares.select(F.col("month").cast("string")).distinct().orderBy("month").collect()]  # as many as there are months
    wide = shares.groupBy("category").pivot("month", months).agg(F.first("pct")).fillna(0.0)
    stages = [VectorAssembler(inputCols=[f"`{m}`" if "." in m else m for m in months], outputCol="raw"), StandardScaler(withMean=True, inputCol="raw", outputCol="scaled"), PCA(k=2, inputCol="scaled", outputCol="pca"), GaussianMixture(k=k, seed=seed, featuresCol="pca", predictionCol="cluster")]
    return Pipeline(stages=stages).fit(wide).transform(wide).groupBy("cluster").agg(F.count("*").alias("n"))


def repurchase_rate(tx: DataFrame, key: str, weeks: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Per cent of rows whose customer's next row of the same key follows within (0, 7w] days."""
    days = F.datediff(F.lead("t_dat").over(Window.partitionBy("customer_id", key).orderBy("t_dat")), "t_dat")
    x = tx.select(days.alias("days"))
    return x.agg(F.lit(key).alias("key"), *((100 * F.count(F.when((F.col("days") > 0) & (F.col("days") <= 7 * w), 1)) / F.count("*")).alias(f"w{w}") for w in weeks))


# A public list of English stop words (without forms that have an apostrophe, as words here are runs of letters),
# and words of descriptions that say nothing.
STOP_WORDS = tuple("""
a about above after again against all also am an and any are as at be because been before being below between both but by can cannot com could
did do does doing down during each else ever few for from further get had has have having he hence her here hers herself him himself his how however
http i if in into is it its itself just k like me more most my myself no nor not of off on once only or other otherwise ought our ours ourselves out over own
r same shall she should since so some such than that the their theirs them themselves then there therefore these they this those through to too
under until up very was we were what when where which while who whom why with would www you your yours yourself yourselves
cm item made product size wear
""".split())


def word_counts(articles: DataFrame, n: int = 200) -> DataFrame:
    words = F.explode(F.split(F.trim(F.regexp_replace(F.lower("detail_desc"), "[^a-z]+", " ")), " +"))
    counts = articles.select(words.alias("word")).where((F.col("word") != "") & ~F.col("word").isin(*STOP_WORDS)).groupBy("word").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(n)
