"""Byte-balanced shards by Karmarkar-Karp differencing of indivisible groups.

Differencing works on partial partitions, tuples of one sum per shard. It repeatedly combines the
two with the largest spread in opposite order, the largest sum of one with the smallest of the
other. Groups are dealt to buckets by a hash of their key, as many as the groups' number asks for,
so the result does not depend on the cluster. Each bucket is differenced to one partial partition, a
tuple of ``n_shards`` sums; partial partitions are differenced the same way, ``FAN`` at a time, in
rounds on the cluster until one is left. Each step gives those below a permutation of their places.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import shared

#: Groups that are differenced at once, and expected in a bucket.
BATCH = 8192
#: Partial partitions that are differenced at once.
FAN = 1024
#: Share of all rows, one in so many, from which a text is hot.
HOT = 1000


def difference(tuples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine n partial partitions (n x k sums) to one.

    Returns ``places`` (n x k: where each tuple's place lands) and the k sums. Ties go by row."""
    n, k = tuples.shape
    places = np.tile(np.arange(k), (n, 1))
    if n == 0:
        return places, np.zeros(k, np.int64)
    order = np.argsort(tuples, axis=1, kind="stable")
    sums: dict[int, np.ndarray] = dict(enumerate(np.take_along_axis(tuples, order, 1)))
    # the sorted tuple of node i: its place j holds what child's place moves[...] says
    children: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    heap = [(-int(s[-1] - s[0]), i) for i, s in sums.items()]
    heapq.heapify(heap)
    new = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        joined = sums.pop(a) + sums.pop(b)[::-1]
        rank = np.argsort(joined, kind="stable")
        to = np.empty(k, np.int64)
        to[rank] = np.arange(k)
        sums[new] = joined[rank]
        children.append((a, b, to, to[::-1]))
        heapq.heappush(heap, (-int(sums[new][-1] - sums[new][0]), new))
        new += 1
    root = heap[0][1]
    at = {root: np.arange(k)}
    for i in range(len(children) - 1, -1, -1):
        a, b, to_a, to_b = children[i]
        own = at.pop(n + i)
        at[a], at[b] = own[to_a], own[to_b]
    for i in range(n):
        places[i, order[i]] = at[i]
    return places, sums[root]


def _differenced_batches(sizes: np.ndarray, k: int, batch: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of each size, and the k sums, ``batch`` at a time."""
    own, partial = np.empty(len(sizes), np.int64), []
    for at in range(0, len(sizes), batch):
        tuples = np.zeros((len(sizes[at : at + batch]), k), np.int64)
        tuples[:, k - 1] = sizes[at : at + batch]
        places, sums = difference(tuples)
        own[at : at + batch] = places[:, k - 1]
        partial.append(sums)
    moves, sums = difference(np.array(partial).reshape(-1, k))
    for i in range(len(partial)):
        own[i * batch : (i + 1) * batch] = moves[i][own[i * batch : (i + 1) * batch]]
    return own, sums


def _merged(partial: DataFrame, n_shards: int, fan: int) -> DataFrame:
    """(bucket, moves): the shard of each place of the partial partitions ``partial(bucket, sums)``.

    One round merges the buckets of one parent; the parents' places are then moved by the next round."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bucket")
        places, sums = difference(np.array(rows["sums"].tolist(), np.int64).reshape(-1, n_shards))
        return pd.DataFrame({"parent": rows["parent"], "bucket": rows["bucket"], "moves": places.astype(np.int32).tolist(), "sums": [sums.tolist()] + [None] * (len(rows) - 1)})

    own, _ = shared.staged(partial.select((F.col("bucket") / fan).cast("long").alias("parent"), "bucket", "sums").groupBy("parent").applyInPandas(run, "parent long, bucket long, moves array<int>, sums array<long>"), "kk-merged")
    above = own.where("sums is not null").select(F.col("parent").alias("bucket"), "sums")
    if above.count() <= 1:
        return own.select("bucket", "moves")
    further = _merged(above, n_shards, fan).toDF("parent", "further")
    return own.join(further, "parent").select("bucket", F.transform("moves", lambda p: F.get("further", p)).alias("moves"))


def assign_groups(groups: DataFrame, n_shards: int, batch: int = BATCH, fan: int = FAN) -> DataFrame:
    """``groups(group_key, bytes)`` with their shard, the shards' bytes near equal.

    A group of more than a shard's share stays whole, so its shard exceeds the mean. No groups
    gives an empty table."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    groups, _ = shared.staged(groups.select("group_key", "bytes"), "kk-groups")
    n_buckets = max(1, groups.count() // batch)
    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("group_key"), F.lit(n_buckets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            held.clear()
            own, sums = _differenced_batches(table.column(2).to_numpy(), n_shards, batch)
            columns = [table.column(0).combine_chunks(), table.column(1).combine_chunks(), pa.array(own, pa.int32()), pa.array([sums.tolist()] + [None] * (len(own) - 1), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "group_key", "place", "sums"])  # the sums stand in the bucket's first row

        for rows in batches:
            bucket = rows.column(0).to_numpy()
            cuts = [0, *(1 + np.flatnonzero(bucket[1:] != bucket[:-1])).tolist(), len(bucket)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if held and high > low and held[0].column(0)[0].as_py() != bucket[low]:
                    yield from close()
                if high > low:
                    held.append(rows.slice(low, high - low))
        if held:
            yield from close()

    width = min(n_buckets, shared.partitions(groups.sparkSession))
    spread = dealt.select("bucket", "group_key", "bytes").repartition(width, "bucket").sortWithinPartitions("bucket", F.desc("bytes"), "group_key")
    placed, _ = shared.staged(spread.mapInArrow(run, "bucket long, group_key string, place int, sums array<long>"), "kk-places")
    moves = _merged(placed.where("sums is not null").select("bucket", "sums"), n_shards, fan)
    return placed.join(moves, "bucket").select("group_key", F.get("moves", F.col("place")).alias("shard"))


def numbered_within(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``slot``, gapless from 0 in each group, without a task that holds a whole group.

    Rows get a bucket by hash; a bucket's first slot is the count of the group's earlier buckets."""
    n = 4 * shared.partitions(df.sparkSession)
    hashed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    counts = hashed.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order)) - 1
    return hashed.withColumn("_own", own).join(first, [group, "_bucket"]).withColumn("slot", F.col("_first") + F.col("_own")).drop("_bucket", "_own", "_first")


def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """Shard ``docs(doc_id, text)`` by bytes; equal texts (null and empty alike) stay together.

    Returns doc_id, size (UTF-8 bytes + 16), text_crc32, law, shard, slot, grown_shard. Texts of any
    length are one document; repeated rows and null doc_ids are documents like others; further columns
    are ignored; an empty table gives an empty one."""
    text = F.coalesce("text", F.lit(""))
    sized = docs.select(
        "doc_id", (shared.text_bytes(F.col("text")) + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("group_key")
    )
    sized, _ = shared.staged(sized, "kk-sizes")
    groups, _ = shared.staged(sized.groupBy("group_key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "kk-texts")
    shards, _ = shared.staged(assign_groups(groups, n_shards), "kk-shards")
    # a text of more than one row in ``HOT`` is not shuffled with its rows; there are at most ``HOT`` such texts
    rows = groups.agg(F.sum("n").alias("rows"))  # one row
    hot = groups.crossJoin(F.broadcast(rows)).where(F.col("n") * HOT > F.col("rows")).select("group_key")
    hot_shards, _ = shared.staged(shards.join(F.broadcast(hot), "group_key", "left_semi").withColumnRenamed("shard", "hot_shard"), "kk-hot")
    marked = sized.join(F.broadcast(hot_shards), "group_key", "left")
    columns = ["doc_id", "size", "text_crc32", "group_key", "shard"]
    usual = marked.where("hot_shard is null").drop("hot_shard").join(shards, "group_key").select(columns)
    sharded = usual.union(marked.where("hot_shard is not null").withColumnRenamed("hot_shard", "shard").select(columns))
    numbered = numbered_within(sharded, "shard", ["doc_id", "group_key"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
