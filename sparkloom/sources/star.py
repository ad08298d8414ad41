"""The item graph's tables derived from an order star schema: parts are items, orders tie them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators import fuse, graph
from sparkloom.schemas import GraphConfig
from sparkloom.sources import together
from sparkloom.sources.dumps import as_books
from sparkloom.sources.enrich import subject_edges

#: Longest list that an item gets.
LIST = 50
#: Parts of this size have an unknown number of ratings.
UNKNOWN_SIZE = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(c: str) -> Column:
    return F.col(c).cast("string")


def subjects() -> Column:
    """Brand, type and size of a part, and its pairs of these."""
    brand, kind, size = F.col("p_brand"), F.col("p_type"), F.concat(F.lit("size "), F.col("p_size").cast("string"))
    return F.array(brand, kind, size, F.concat_ws("|", brand, kind), F.concat_ws("|", kind, size), F.concat_ws("|", brand, size))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a book; its order lines are its ratings, unknown for one size."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left")
    rated = F.when(F.col("p_size") != UNKNOWN_SIZE, F.coalesce("n", F.lit(0)))
    return as_books(rows.select(key("p_partkey").alias("work_id"), F.col("p_name").alias("title"), F.array("p_brand").alias("authors"), rated.alias("ratings_count"), subjects().alias("subjects"), key("p_partkey").alias("asin")))


def ranked_edges(pairs: DataFrame, kind: str, source: str, order: list[Column]) -> DataFrame:
    """Lists of each ``src``, by ``order``, of up to ``LIST`` places."""
    placed = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(*order)))
    return placed.where(F.col("rank") <= LIST).select("src", "dst", F.lit(kind).alias("kind"), "rank", F.lit(source).alias("source"))


def _listed(lines: DataFrame, kind: str, source: str) -> DataFrame:
    """Lists of up to ``LIST`` places from ``lines(grp, own, item)``: most often together first."""
    placed = together.most_together(lines, LIST)
    if placed is not None:
        return placed.select("src", "dst", F.lit(kind).alias("kind"), "rank", F.lit(source).alias("source"))
    named = lines.select("grp", "own", key("item").alias("item")).distinct()
    pairs = named.alias("a").join(named.alias("b"), "grp").where("a.own != b.own and a.item != b.item")
    counted = pairs.groupBy(F.col("a.item").alias("src"), F.col("b.item").alias("dst")).agg(F.count("*").alias("n"))
    return ranked_edges(counted, kind, source, [F.desc("n"), F.asc("dst")])


def also_bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the same order, most often together first."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("grp"), F.col("l_partkey").cast("long").alias("item"))
    return _listed(lines.select("grp", F.col("item").alias("own"), "item"), "az_also_bought", "amazon_meta")


def also_viewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that one customer bought in different orders, by the number of such pairs of orders."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("own"), F.col("l_partkey").cast("long").alias("item"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("own"), F.col("o_custkey").cast("long").alias("grp"))
    return _listed(lines.join(orders, "own").select("grp", "own", "item"), "az_also_viewed", "amazon_reviews_2023")


def similar_by_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one brand nearest in price, ties by key.

    Only parts within ``LIST`` places in the brand's price order can be among the nearest, so each
    part meets a fixed number of others, whatever the brand's size."""
    parts = table(spark, sf_dir, "part").select(key("p_partkey").alias("item"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"))
    brand = Window.partitionBy("brand")
    placed = parts.select(
        "*",
        F.row_number().over(brand.orderBy("price", "item")).alias("up"), F.row_number().over(brand.orderBy("price", F.desc("item"))).alias("down"),
        F.row_number().over(Window.partitionBy("brand", "price").orderBy("item")).alias("level"),
        F.count("*").over(brand.orderBy("price").rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"),
    )
    below = F.col("upto") - F.count("*").over(Window.partitionBy("brand", "price"))
    own = placed.withColumn("below", below).select("brand", "price", F.col("item").alias("src"), "upto", "below")
    steps = F.explode(F.sequence(F.lit(1), F.lit(LIST))).alias("k")
    other = placed.select("brand", F.col("price").alias("other"), F.col("item").alias("dst"), "up", "down", "level")
    dearer = own.select("*", steps).withColumn("up", F.col("upto") + F.col("k")).join(other, ["brand", "up"])
    cheaper = own.select("*", steps).withColumn("down", F.col("below") + 1 - F.col("k")).join(other, ["brand", "down"])
    equal = own.join(other.where(F.col("level") <= LIST + 1).withColumnRenamed("other", "price"), ["brand", "price"]).where("src != dst").withColumn("other", F.col("price"))
    columns = ["src", "dst", F.abs(F.col("price") - F.col("other")).alias("gap")]
    near = dearer.select(columns).union(cheaper.select(columns)).union(equal.select(columns))
    return ranked_edges(near, "gr_similar", "goodreads_ucsd", [F.asc("gap"), F.asc("dst")])


def shared_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subject_edges(books(spark, sf_dir))


def all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = also_bought(spark, sf_dir)
    for more in (also_viewed(spark, sf_dir), similar_by_price(spark, sf_dir), shared_subjects(spark, sf_dir)):
        out = out.unionByName(more)
    return out


def bought_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused graph of parts bought together."""
    return fuse.fuse(also_bought(spark, sf_dir), GraphConfig())


def bought_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(bought_graph(spark, sf_dir))


def brand_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, community): each part's brand by its order."""
    parts = table(spark, sf_dir, "part").select(key("p_partkey").alias("node"), "p_brand")
    places = parts.select("p_brand").distinct().withColumn("community", F.dense_rank().over(Window.orderBy("p_brand")) - 1)  # one row per brand
    return parts.join(places, "p_brand").select("node", "community")
