"""Resolve namespaced edge ends onto work ids.

The map is made over distinct ends, far fewer than edges, and joined twice. An end with an unknown
prefix stands for itself; one with a known prefix that nothing describes drops its edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.schemas import REF_ID_TYPE


def ref_map(edges: DataFrame, aliases: DataFrame, books: DataFrame) -> DataFrame:
    """(ref, work_id) for each distinct end with a known prefix; work_id is null if it is unknown."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("ref")).where(F.contains("ref", F.lit(":"))).distinct()
    id_type = F.create_map(*(F.lit(x) for pair in REF_ID_TYPE.items() for x in pair))
    parsed = ends.select("ref", F.try_element_at(id_type, F.split_part("ref", F.lit(":"), F.lit(1))).alias("id_type"), F.expr("substring(ref, instr(ref, ':') + 1)").alias("id_value"))
    known = parsed.where("id_type is not null")
    named = known.join(aliases.select("id_type", "id_value", F.col("work_id").alias("by_alias")), ["id_type", "id_value"], "left")
    own = books.select(F.col("work_id").alias("id_value"), F.col("work_id").alias("by_book")).distinct()
    return named.join(own, "id_value", "left").select("ref", F.coalesce("by_alias", "by_book").alias("work_id"))


def rewritten(edges: DataFrame, refs: DataFrame) -> DataFrame:
    """``edges`` with ``new_src``, ``new_dst`` and ``lost``: whether an end is known to be unknown."""
    marked = refs.withColumn("found", F.lit(True))
    out = edges
    for end in ("src", "dst"):
        side = marked.select(F.col("ref").alias(end), F.col("work_id").alias(f"_{end}"), F.col("found").alias(f"_{end}_ref"))
        out = out.join(side, end, "left")
        out = out.withColumn(f"new_{end}", F.when(F.col(f"_{end}_ref"), F.col(f"_{end}")).otherwise(F.col(end)))
    return out.withColumn("lost", F.isnull("new_src") | F.isnull("new_dst"))


def resolve_refs(edges: DataFrame, aliases: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolved edges, and a one-row table ``dropped`` with the rows that had an unknown end.

    Self-loops go, edges that become equal keep their best rank, and a second pass changes nothing."""
    found = rewritten(edges, ref_map(edges, aliases, books))
    kept = found.where("not lost and new_src != new_dst")
    out = kept.groupBy(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "kind", "source").agg(F.min("rank").alias("rank"))
    return out.select("src", "dst", "kind", "rank", "source"), found.agg(F.count_if("lost").alias("dropped"))
