"""How the driver's tables play the parts of dictionary, user entries, usage log, frequencies and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates as C


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as dictionary: the brand reads, the name is read."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("reading"), F.col("p_name").alias("value"), F.col("p_type").alias("comment"))


def user_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of size 1 are the user's own entries; promoted ones have no comment."""
    p = table(spark, sf_dir, "part").where("p_size = 1")
    comment = F.when(F.col("p_type") == "PROMO", "").otherwise(F.concat(F.lit("own "), F.col("p_type")))
    return p.select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("reading"), F.col("p_name").alias("value"), comment.alias("comment"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line selects its part. Lines are counted by part before they meet the parts."""
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    joined = sold.join(p, sold["l_partkey"] == p["p_partkey"])
    return joined.groupBy(F.col("p_brand").alias("lookup_key"), F.col("p_name").alias("value")).agg(F.sum("n").alias("count"))


def own_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """usage, with returned lines also counted as choices of the brand itself."""
    back = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.count("*").alias("n"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    brand = back.join(p, back["l_partkey"] == p["p_partkey"]).groupBy(F.col("p_brand").alias("lookup_key")).agg(F.floor(F.sum("n") / 40).cast("long").alias("count"))
    return usage(spark, sf_dir).unionByName(brand.select("lookup_key", F.col("lookup_key").alias("value"), "count"))


def frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("value"), F.col("p_size").cast("long").alias("freq"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for every brand."""
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("key")).distinct().select(F.regexp_extract("key", "[0-9]+", 0).cast("long").alias("request_id"), "key")


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ranked(dictionary(spark, sf_dir), user_entries(spark, sf_dir), usage(spark, sf_dir), frequency(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as gestures of clients: a purchase commits, an error cancels, anything else selects value k for its type."""
    return gestures(table(spark, sf_dir, "events"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream over the files of events."""
    schema = table(spark, sf_dir, "events").schema
    return gestures(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]"))  # a pattern may match a file; a plain path must be a folder


def gestures(e: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "commit").when(F.col("event_type") == "error", "cancel").otherwise("select")
    return e.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("client_id"), F.col("ts"), F.col("event_type").alias("slot"), kind.alias("kind"),
        F.col("event_type").alias("lookup_key"), F.get_json_object("props", "$.k").alias("value"),
    )
