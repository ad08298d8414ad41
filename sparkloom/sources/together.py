"""Items that occur together: the most frequent partners of each item, without a table of all pairs.

Lines are gathered to baskets, one row of packed arrays per group. Each line then sends the other
items of its basket to its own item as one packed array, in as many passes over the baskets as keep
the arrays under way in proportion to the lines, however many pairs these make. An item's partners
are counted by sorting where they arrive, and only its first places go on.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.lineage import free_shuffles, new_path

#: Bytes under way in a pass for each line, and what a line's array takes beside its items.
LINE_BYTES, ROW_BYTES = 48, 40
#: Partners made or counted together.
TOGETHER = 1 << 20
#: Characters of the longest keys whose codes fit 64 bits.
LONGEST = 17


def coded(keys: np.ndarray, width: int) -> np.ndarray:
    """Numbers in the order of the ``keys`` as decimal texts of up to ``width`` characters: digits in base
    12, aligned at the first character; 0 is the end of a text and 1 the sign."""
    left, code, scale = np.abs(keys), np.zeros(len(keys), np.int64), np.ones(len(keys), np.int64)
    more = np.ones(len(keys), bool)
    while more.any():
        code += np.where(more, (left % 10 + 2) * scale, 0)
        scale = np.where(more, scale * 12, scale)
        left = left // 10
        more = left > 0
    code += np.where(keys < 0, scale, 0)
    scale = np.where(keys < 0, scale * 12, scale)
    return code * (12**width // scale)


def decoded(codes: np.ndarray, width: int) -> np.ndarray:
    """The keys of ``coded``."""
    keys, sign, left = np.zeros(len(codes), np.int64), np.ones(len(codes), np.int64), codes
    for place in range(width - 1, -1, -1):
        digit = left // 12**place
        left = left - digit * 12**place
        keys = np.where(digit >= 2, keys * 10 + digit - 2, keys)
        sign = np.where(digit == 1, -1, sign)
    return keys * sign


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array of the runs of ``values`` up to ``ends``."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * values.itemsize
    wide = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])
    return wide.cast(pa.binary())


def _unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary array and the length of each of its runs."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind) if data and offsets[-1] > offsets[0] else np.zeros(0, kind)
    return values, np.diff(offsets) // np.dtype(kind).itemsize


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def baskets(lines: DataFrame, width: int) -> DataFrame:
    """(n, items, own) of each group of ``lines(grp, own, item)``: distinct lines in order, ``own`` as
    numbers within the basket."""
    kind = np.int32 if 12**width < 1 << 31 else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3

        def made(columns: list[np.ndarray]) -> pa.RecordBatch:
            grp, own, item = columns
            new = np.ones(len(grp), bool)
            new[1:] = (grp[1:] != grp[:-1]) | (own[1:] != own[:-1]) | (item[1:] != item[:-1])
            grp, own, item = grp[new], own[new], item[new]
            first = np.ones(len(grp), bool)
            first[1:] = grp[1:] != grp[:-1]
            change = np.ones(len(grp), bool)
            change[1:] = first[1:] | (own[1:] != own[:-1])
            starts = np.flatnonzero(first)
            ends = np.append(starts[1:], len(grp)).astype(np.int64)
            local = np.cumsum(change)
            local = (local - np.repeat(local[starts], ends - starts)).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(ends - starts, pa.int64()), _packed(coded(item, width).astype(kind), ends), _packed(local, ends)], ["n", "items", "own"])

        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if last:
                yield made([h[:last] for h in held])
                held = [h[last:] for h in held]
        if len(held[0]):
            yield made(held)

    # sorted by group, so a batch holds whole groups up to its last one
    return lines.repartition("grp").sortWithinPartitions("grp", "own", "item").mapInArrow(run, "n long, items binary, own binary")


def partners(held: DataFrame, width: int, turn: int, turns: int) -> DataFrame:
    """(item, others): for each line of the baskets whose item has its ``turn``, the items of other
    ``own`` in the basket, itself left out."""
    kind = np.int32 if 12**width < 1 << 31 else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, sizes = _unpacked(batch.column(0), kind)
            own, _ = _unpacked(batch.column(1), np.int32)
            size, start = np.repeat(sizes, sizes), np.repeat(_starts(sizes), sizes)
            mixed = (items.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            mine = np.flatnonzero((mixed % np.uint64(turns) == turn) & (size > 1))
            total = np.cumsum(size[mine])
            at = 0
            while at < len(mine):
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + TOGETHER)))
                some, at = mine[at:to], to
                n = size[some]
                other = np.arange(n.sum()) + np.repeat(start[some] - _starts(n), n)
                line = np.repeat(some, n)
                kept = (own[other] != own[line]) & (items[other] != items[line])
                ends = np.cumsum(np.add.reduceat(kept, _starts(n), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(items[some].astype(np.int64)), _packed(items[other[kept]], ends)], ["item", "others"])

    return held.select("items", "own").mapInArrow(run, "item long, others binary")


def counted(item: np.ndarray, sizes: np.ndarray, others: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the item among the different ones of ``item``, other, count), in order; ``item`` is sorted."""
    new = np.ones(len(item), bool)
    new[1:] = item[1:] != item[:-1]
    place = np.repeat(np.cumsum(new) - 1, sizes)
    span = int(others.max()) + 1 if len(others) else 1
    if times is None and (int(new.sum()) + 1) * span < 1 << 63:
        keys = place * span + others
        keys.sort()
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        starts = np.flatnonzero(first)
        return keys[starts] // span, keys[starts] % span, np.diff(np.append(starts, len(keys)))
    order = np.lexsort((others, place))
    place, others = place[order], others[order]
    first = np.ones(len(place), bool)
    first[1:] = (place[1:] != place[:-1]) | (others[1:] != others[:-1])
    starts = np.flatnonzero(first)
    n = np.add.reduceat(times[order], starts) if times is not None and len(starts) else np.diff(np.append(starts, len(place)))
    return place[starts], others[starts], n


def first_places(place: np.ndarray, others: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the first ``most`` others of each place by count, then code, in order, and their ranks."""
    # what occurs once is in order as it is; of that, no place needs more than ``most``
    once = n == 1
    seen = np.cumsum(once)
    first = np.searchsorted(place, place)
    candidates = np.flatnonzero(~once | (seen - seen[first] + once[first] <= most))
    ordered = candidates[np.lexsort((others[candidates], -n[candidates], place[candidates]))]
    own = place[ordered]
    rank = np.arange(len(own)) - np.searchsorted(own, own) + 1
    return ordered[rank <= most], rank[rank <= most]


def top(arrived: DataFrame, width: int, most: int) -> DataFrame:
    """(src, dst, rank) of each item of ``arrived(item, others)``, which is sorted by item."""
    kind = np.int32 if 12**width < 1 << 31 else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # counts of an item that may go on, and lines that wait
        carry: tuple[int, np.ndarray, np.ndarray] | None = None
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal carry
            item, sizes, others = (np.concatenate([w[i] for w in waiting]) if waiting else np.zeros(0, np.int64) for i in range(3))
            waiting.clear()
            if not len(item):
                if not last or carry is None:
                    return
                names, (place, other, n) = np.array([carry[0]]), (np.zeros(len(carry[1]), np.int64), carry[1], carry[2])
            else:
                names = item[np.concatenate([[True], item[1:] != item[:-1]])]
                place, other, n = counted(item, sizes, others)
                if carry is not None:
                    if carry[0] == names[0]:
                        ours = int(np.searchsorted(place, 1))
                        whole = counted(np.zeros(1, np.int64), np.array([len(carry[1]) + ours]), np.concatenate([carry[1], other[:ours]]), np.concatenate([carry[2], n[:ours]]))
                        place, other, n = (np.concatenate([a, b[ours:]]) for a, b in zip(whole, (place, other, n), strict=True))
                    else:
                        names, place = np.append(carry[0], names), np.concatenate([np.zeros(len(carry[1]), np.int64), place + 1])
                        other, n = np.concatenate([carry[1], other]), np.concatenate([carry[2], n])
            carry = None
            if not last:
                begin = int(np.searchsorted(place, len(names) - 1))
                carry = int(names[-1]), other[begin:].copy(), n[begin:].copy()
                place, other, n = place[:begin], other[:begin], n[:begin]
            rows, rank = first_places(place, other, n, most)
            for k in range(0, len(rows), 1 << 16):
                some = rows[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(decoded(names[place[some]], width)), pa.array(decoded(other[some], width)), pa.array(rank[k : k + (1 << 16)], pa.int32())], ["src", "dst", "rank"])

        for batch in batches:
            others, sizes = _unpacked(batch.column(1), kind)
            waiting.append((batch.column(0).to_numpy(), sizes.astype(np.int64), others.astype(np.int64)))
            if sum(len(w[2]) for w in waiting) >= TOGETHER:
                yield from flush(False)
        yield from flush(True)

    return arrived.mapInArrow(run, "src long, dst long, rank int")


def most_together(lines: DataFrame, most: int) -> DataFrame | None:
    """(src, dst, rank) as texts: the ``most`` items that are in a group of ``lines(grp, own, item)``, all
    long, with each item, by the number of pairs of lines of unlike ``own``, then as texts. Rows with
    nulls pair with nothing. None if a key is too long for the codes."""
    spark = lines.sparkSession
    lines = lines.where("grp is not null and own is not null and item is not null")
    width = lines.agg(F.max(F.length(F.col("item").cast("string")))).first()[0] or 1
    if width > LONGEST:
        return None
    home = new_path(spark, "together")
    baskets(lines, width).write.parquet(f"{home}/baskets")
    free_shuffles(spark)
    held = spark.read.schema("n long, items binary, own binary").parquet(f"{home}/baskets")
    n, pairs = held.agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1))).first()
    turns = max(1, math.ceil(((n or 0) * ROW_BYTES + (pairs or 0) * (4 if 12**width < 1 << 31 else 8)) / (max(1, n or 0) * LINE_BYTES)))
    for turn in range(turns):
        arrived = partners(held, width, turn, turns).repartition("item").sortWithinPartitions("item")
        top(arrived, width, most).write.parquet(f"{home}/places/turn={turn}")
        del arrived
        gc.collect()
        free_shuffles(spark)
    found = spark.read.schema("src long, dst long, rank int").parquet(*(f"{home}/places/turn={turn}" for turn in range(turns)))
    return found.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "rank")
