"""Fuse ranked directed edges into one weighted undirected graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.schemas import GraphConfig

#: Kinds that fit the bits of a long.
BITS = 62


def rank_weight(rank: Column) -> Column:
    """Decay of a list position, 1 / log2(2 + rank); positions start at 1."""
    wrong = F.raise_error(F.concat(F.lit("rank must be 1 or more, got "), rank.cast("string"))).cast("double")
    return F.when(rank >= 1, 1 / F.log2(2 + rank)).otherwise(wrong)


def eligible(edges: DataFrame, books: DataFrame, min_ratings: int | None) -> DataFrame:
    """Edges between books with so many ratings, or an unknown number. Falsy means all edges."""
    if not min_ratings:
        return edges
    kept = books.where((F.col("ratings_count") >= min_ratings) | F.isnull("ratings_count")).select("work_id")
    for end in ("src", "dst"):
        edges = edges.join(kept.withColumnRenamed("work_id", end), end, "left_semi")
    return edges


def fuse(edges: DataFrame, config: GraphConfig = GraphConfig(), books: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight, dir_asym, kinds) with src < dst, from ``edges(src, dst, kind, rank, source)``.

    A direction's weight sums alpha(kind) * rank_weight(rank); a pair's weight is its stronger
    direction, dir_asym is 0 for a mutual and 1 for a one-way pair. Unknown kinds and positions
    beyond max_rank don't count. One shuffle by pair serves both sums.
    """
    if config.min_ratings:
        if books is None:
            raise ValueError("min_ratings needs the book table")
        edges = eligible(edges, books, config.min_ratings)
    alpha = F.create_map(*(F.lit(x) for pair in config.source_alpha.items() for x in pair))
    rows = edges.where((F.col("rank") <= config.max_rank) & F.col("kind").isin(*config.source_alpha) & (F.col("src") != F.col("dst")))
    part = alpha[F.col("kind")] * rank_weight(F.col("rank"))
    ahead = F.col("src") < F.col("dst")
    # a bit for each kind: sets of texts would be objects on the heap for each pair
    kinds = sorted(config.source_alpha)
    bit = F.create_map(*(F.lit(x) for i, k in enumerate(kinds) for x in (k, 1 << i))) if len(kinds) <= BITS else None
    named = F.filter(F.array(*map(F.lit, kinds)), lambda k: F.col("bits").bitwiseAND(bit[k]) != 0) if bit is not None else F.sort_array("bits")
    rows = rows.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), ahead.alias("ahead"), part.alias("part"), (F.col("kind") if bit is None else bit[F.col("kind")].cast("long")).alias("bit"))
    pairs = rows.groupBy("a", "b").agg(
        F.sum(F.when(F.col("ahead"), F.col("part")).otherwise(0.0)).alias("there"), F.sum(F.when(F.col("ahead"), 0.0).otherwise(F.col("part"))).alias("back"), (F.collect_set("bit") if bit is None else F.bit_or("bit")).alias("bits")
    ).withColumn("kinds", named)
    weight = F.greatest("there", "back")
    kept = pairs.withColumn("weight", weight).where((F.col("weight") > 0) & (F.col("weight") >= config.min_weight))
    out = kept.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight", (1 - F.least("there", "back") / F.col("weight")).alias("dir_asym"), "kinds")
    return drop_leaves(out) if config.drop_leaves else out


def drop_leaves(fused: DataFrame) -> DataFrame:
    """Without the edges that touch a node of one edge; one pass, so new leaves stay."""
    ends = fused.select(F.explode(F.array("src", "dst")).alias("node"))
    inner = ends.groupBy("node").count().where("count > 1").select("node")
    for end in ("src", "dst"):
        fused = fused.join(inner.withColumnRenamed("node", end), end, "left_semi")
    return fused


def prune(fused: DataFrame, min_weight: float, leaves: bool = False) -> DataFrame:
    """Edges of at least ``min_weight``, and then without leaves if asked."""
    kept = fused.where(F.col("weight") >= min_weight)
    return drop_leaves(kept) if leaves else kept
