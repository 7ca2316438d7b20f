"""Sources and sinks: the three tables of the data model, read column by column, and what the jobs write."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import running


@dataclass(frozen=True)
class Tables:
    transactions: DataFrame
    customers: DataFrame
    articles: DataFrame


def load_tables(spark: SparkSession, path: str) -> Tables:
    """The tables from the star schema in path; columns that a query does not use are never read."""
    read = lambda name: spark.read.parquet(f"{path}/{name}.parquet")
    orders = read("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("t_dat"), F.col("o_custkey").cast("long").alias("customer_id"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(2).alias("sales_channel_id"))
    lines = read("lineitem").select("l_orderkey", F.col("l_partkey").cast("long").alias("article_id"), (F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("price"))
    transactions = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("t_dat", "customer_id", "article_id", "price", "sales_channel_id")
    key, balance, segment = F.col("c_custkey"), F.col("c_acctbal"), F.col("c_mktsegment")
    customers = read("customer").select(
        key.cast("long").alias("customer_id"), F.when(key % 20 != 0, 14 + key % 70).cast("double").alias("age"),
        F.when(balance < 0, None).when(balance < 5000, "PRE-CREATE").otherwise("ACTIVE").alias("club_member_status"), F.when(segment != "MACHINERY", segment).alias("fashion_news_frequency"),
    )
    name = F.col("p_name")
    articles = read("part").select(
        F.col("p_partkey").cast("long").alias("article_id"), name.alias("prod_name"), name.alias("detail_desc"), F.concat_ws(" ", "p_brand", "p_name").alias("product_code"), F.col("p_type").alias("product_group_name"),
        F.col("p_brand").alias("index_group_name"), F.col("p_brand").alias("index_name"), F.split(name, "[ ]").getItem(0).alias("colour_group_name"), F.get(F.split(name, "[ ]"), F.lit(1)).alias("product_type_name"), F.col("p_size").cast("int").alias("section_no"), F.concat_ws(" ", "p_type", F.col("p_size") % 5).alias("garment_group_name"),
    )
    return Tables(transactions, customers, articles)


def normalise_types(transactions: DataFrame) -> DataFrame:
    return transactions.select(F.to_date("t_dat").alias("t_dat"), F.col("customer_id").cast("string").alias("customer_id"), F.col("article_id").cast("int").alias("article_id"), F.col("price").cast("float").alias("price"), F.col("sales_channel_id").cast("int").alias("sales_channel_id"))


def encode_ids(df: DataFrame, column: str, out: str, known: DataFrame | None = None) -> DataFrame:
    """column, out: dense codes from 0 in order of the distinct non-null values. No task sorts them all: ranks inside range partitions plus the sizes of those before.

    known(column, out) is the dictionary of an earlier load: its codes stay, and new values come after its highest code.
    """
    keys = df.select(column).where(F.col(column).isNotNull()).distinct()
    if known is None:
        return running(keys, [], [column], F.lit(1), "_at").select(column, (F.col("_at") - 1).cast("int").alias(out))
    first = known.agg(F.coalesce(F.max(out) + 1, F.lit(0))).first()[0]  # one row
    new = running(keys.join(known.select(column), column, "left_anti"), [], [column], F.lit(1), "_at")
    return known.select(column, out).unionByName(new.select(column, (F.col("_at") - 1 + first).cast("int").alias(out)))


#: Transactions in a bucket of the stored layout, about: a task sorts one bucket.
BUCKET_ROWS = 4_000_000


def buckets_for(transactions: DataFrame, least: int = 2, rows: int = BUCKET_ROWS) -> int:
    """So many that a bucket holds about `rows` transactions, whatever their number."""
    return max(least, -(-transactions.count() // rows))


@dataclass(frozen=True)
class Layout:
    """The stored output of the preprocessing. transactions: folders by week, in each of them files by customer; customers: files by customer, as many."""

    transactions: DataFrame
    customers: DataFrame
    articles: DataFrame
    obsolete: DataFrame

    def weeks(self, first: int, last: int) -> DataFrame:
        """The transactions of some weeks, 0 the newest: whole folders, nothing else is read."""
        return self.transactions.where(F.col("week").between(first, last))

    def splits(self, train_weeks: int = 8, val_weeks: int = 1, test_weeks: int = 1) -> dict[str, DataFrame]:
        """train, val and test are ranges of folders, not copies."""
        a, b = test_weeks, test_weeks + val_weeks
        return {"train": self.weeks(b, b + train_weeks - 1), "val": self.weeks(a, b - 1), "test": self.weeks(0, a - 1)}


def write_layout(transactions: DataFrame, customers: DataFrame, articles: DataFrame, obsolete: DataFrame, path: str, buckets: int = 8) -> Layout:
    """Writes the tables (transactions with week) and opens them. A task writes one bucket of customers, of all weeks."""
    for name, df, by in (("transactions", transactions, ["week"]), ("customers", customers, [])):
        table = f"nextbasket_{uuid.uuid4().hex}"
        writer = df.repartition(buckets, "customer_id").write.format("parquet").bucketBy(buckets, "customer_id").sortBy("customer_id").option("path", f"{path}/{name}")
        (writer.partitionBy(*by) if by else writer).saveAsTable(table)
        df.sparkSession.sql(f"DROP TABLE {table}")  # of an external table: its files stay
    for name, df in (("articles", articles), ("obsolete", obsolete)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    return open_layout(transactions.sparkSession, path, buckets)


def open_layout(spark: SparkSession, path: str, buckets: int = 8) -> Layout:
    """The layout in path, in any session: a catalogue entry tells Spark the buckets, so what goes by customer needs no exchange."""

    def bucketed(name: str, by: str) -> DataFrame:
        table, schema = f"nextbasket_{uuid.uuid4().hex}", spark.read.parquet(f"{path}/{name}").schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet {by} CLUSTERED BY (customer_id) SORTED BY (customer_id) INTO {buckets} BUCKETS LOCATION '{path}/{name}'")
        if by:
            spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
        return spark.table(table)

    return Layout(bucketed("transactions", "PARTITIONED BY (week)"), bucketed("customers", ""), *(spark.read.parquet(f"{path}/{n}") for n in ("articles", "obsolete")))


def write_results(results: DataFrame, path: str) -> DataFrame:
    """A metric table (a few rows) as one JSON file; read back."""
    results.coalesce(1).write.mode("overwrite").json(path)
    return results.sparkSession.read.schema(results.schema).json(path)
