"""The undirected graph: adjacency, degrees, neighbours, subgraphs and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.lineage import cut


def adjacency(fused: DataFrame) -> DataFrame:
    """Both directions (src, dst, weight) of ``fused(src, dst, weight)``, without self-loops."""
    edges = fused.select("src", "dst", "weight").where("src != dst")
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def nodes(fused: DataFrame) -> DataFrame:
    """The distinct ends, as ``node``."""
    return fused.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def node_index(fused: DataFrame) -> DataFrame:
    """(node, idx): places from 0 in sorted order, by range partitions and their offsets."""
    spark = fused.sparkSession
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = nodes(fused).repartitionByRange(width, "node").withColumn("_part", F.spark_partition_id())
    placed = cut(placed)  # partition ids must not change between the two uses
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    first = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("node")) - 1
    return placed.withColumn("_own", own).join(first, "_part").select("node", (F.col("_first") + F.col("_own")).alias("idx"))


def degrees(adj: DataFrame) -> DataFrame:
    """(node, degree, weighted_degree); entries of weight 0 are no neighbours."""
    return adj.groupBy(F.col("src").alias("node")).agg(F.count_if(F.col("weight") != 0).alias("degree"), F.sum("weight").alias("weighted_degree"))


def degree_stats(adj: DataFrame) -> DataFrame:
    """Mean, median, 95th percentile (interpolated) and maximum of the degrees."""
    found = degrees(adj)
    return found.agg(
        F.mean("degree").alias("mean"), F.percentile("degree", F.lit(0.5)).alias("median"), F.percentile("degree", F.lit(0.95)).alias("p95"), F.max("degree").alias("max")
    )


def graph_counts(fused: DataFrame) -> DataFrame:
    """n_nodes and n_edges."""
    return nodes(fused).agg(F.count("*").alias("n_nodes")).crossJoin(fused.where("src != dst").agg(F.count("*").alias("n_edges")))


def neighbours(fused: DataFrame, work_id: str, limit: int | None = 25) -> DataFrame:
    """(neighbour, weight) of a node, strongest first, then by id; zero weights are left out."""
    either = (F.col("src") == work_id) | (F.col("dst") == work_id)
    found = fused.where(either & (F.col("weight") != 0)).select(F.when(F.col("src") == work_id, F.col("dst")).otherwise(F.col("src")).alias("neighbour"), "weight")
    ordered = found.orderBy(F.desc("weight"), "neighbour")
    return ordered.limit(limit) if limit is not None else ordered


def subgraph(fused: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids(node)``; unknown ids have none."""
    for end in ("src", "dst"):
        fused = fused.join(ids.select(F.col("node").alias(end)).distinct(), end, "left_semi")
    return fused


def transition(adj: DataFrame) -> DataFrame:
    """Adjacency with ``p``, each weight over its node's sum; rows of sum 0 stay 0."""
    total = F.sum("weight").over(Window.partitionBy("src"))
    return adj.withColumn("p", F.when(total > 0, F.col("weight") / total).otherwise(0.0))


def neighbour_sets(adj: DataFrame) -> DataFrame:
    """(node, neighbours): sorted distinct neighbours of non-zero weight."""
    return adj.where("weight != 0").groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_set("dst")).alias("neighbours"))


def jaccard_neighbourhoods(adj: DataFrame, among: DataFrame) -> DataFrame:
    """(a, b, jaccard) for a < b of ``among(node)`` that share a neighbour. Counts, not pairs of
    sets, are joined: a shared neighbour adds one."""
    own = adj.where("weight != 0").join(among.select(F.col("node").alias("src")).distinct(), "src", "left_semi").select("src", "dst").distinct()
    sizes = own.groupBy("src").agg(F.count("*").alias("n"))
    shared = own.alias("x").join(own.alias("y"), "dst").where("x.src < y.src").groupBy(F.col("x.src").alias("a"), F.col("y.src").alias("b")).agg(F.count("*").alias("both"))
    sized = shared.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    return sized.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))
