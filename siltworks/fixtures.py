"""Dirty variants of the clean tables: values go missing or become text by fixed arithmetic rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    return e.withColumns({"value": value, "event_type": F.when(F.col("event_id") % 11 != 0, F.col("event_type"))})


def lineitem_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    return li.withColumns({"l_tax": F.when(F.col("l_linenumber") != 3, F.col("l_tax")), "l_returnflag": F.when(F.col("l_partkey") % 5 != 0, F.col("l_returnflag"))})


def orders_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    price = F.concat(F.floor(cents / 100).cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))
    return o.select("o_orderkey", price.alias("price_txt"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_txt"), F.col("o_orderkey").cast("string").alias("key_txt"))


def orders_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, last = load(spark, sf_dir, "orders"), F.col("o_orderkey") % 10
    status = F.when(last == 0, " NA ").when(last == 1, "null").when(last == 2, "").otherwise(F.col("o_orderstatus"))
    return o.select("o_orderkey", status.alias("status_txt"), "o_orderpriority")


def labels_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "Oui").otherwise("Non").alias("flag_txt"))
