"""MinHash near-duplicates: universal hash minima, banding, verified links, star components.

Steps, each over all documents:

1. A document's set is its distinct word shingles as 64-bit hashes. Documents of equal sets form a
   class at once, named by a 64-bit hash of the set; only one document of a class goes on.
2. ``BANDS`` x ``ROWS`` minima of universal hashes are cut into bands. Two sets of similarity s
   share a band with probability 1 - (1 - s**ROWS)**BANDS, 1 - 1.3e-7 at 0.8.
3. Each member of a band's bucket is compared with the bucket's smallest member by signature. The
   best such partner of each document is confirmed on the full sets, and alternating large-star
   and small-star turns the links into components.
4. Buckets that still hold several components are compared in blocks of ``BLOCK`` members. The
   members of a bucket's largest component only meet the others, the strangers, and strangers meet
   each other. First by signature, which leaves the members that have a partner at all; then these
   on their full sets, where a task hands on only links that join components it has not joined yet.
   A pair is compared in the first band that it shares. The components are joined again with these
   links.

A signature passes unless it is ``SIGMAS`` standard deviations below the threshold. No bucket is
capped. In large groups of copies step 3 leaves one component, so a bucket of n members with s
strangers sends n + s * (n + s) / ``BLOCK`` rows in step 4, not all pairs. Full sets are made anew
from the texts where they are needed, in one scan without a shuffle: a bitmap of fixed size keeps
out most other documents before a join takes the exact ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import shared

BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
SIGMAS = 5.5
BLOCK = 256
#: Bits of the map that keeps other documents out of a scan for full sets.
MAP_BITS = 1 << 26
#: Distinct words whose hashes a task keeps at once.
WORD_CACHE = 100_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(20240229)
_FACTORS = _random.integers(0, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _random.integers(0, 2**63, HASHES, np.uint64)


class Shingler:
    """Sets of hashed word shingles; keeps word hashes between texts."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def __call__(self, text: bytes) -> np.ndarray:
        """Sorted distinct hashes of the shingles of ``words`` words; a shorter text is one shingle."""
        tokens = text.lower().split()  # of bytes: A-Z alone, and white space 0x20, 0x09-0x0D
        if not tokens:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > WORD_CACHE:
            known.clear()
        for word in set(tokens).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        k = min(self.words, len(hashes))
        n = len(hashes) - k + 1
        out = np.full(n, k, np.uint64)
        for i in range(k):
            out = (out ^ hashes[i : i + n]) * _MIX
            out ^= out >> np.uint64(29)
        return np.unique(out)


def minima(shingles: np.ndarray) -> np.ndarray:
    """``HASHES`` minima (uint32) of the universal hashes (a x + b mod 2**64) >> 32."""
    best = np.full(HASHES, np.iinfo(np.uint32).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        hashed = shingles[at : at + 1024, None] * _FACTORS
        hashed += _OFFSETS
        np.minimum(best, hashed.min(axis=0) >> np.uint64(32), out=best)
    return best.astype(np.uint32)


def band_keys(minima_: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of one signature; the band's number is part of it."""
    rows = minima_.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = (key ^ rows[:, i]) * _MIX
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def least_agreement(threshold: float) -> int:
    """Agreeing minima, out of ``HASHES``, below which a pair of that similarity hardly falls."""
    return math.floor(HASHES * threshold - SIGMAS * math.sqrt(HASHES * threshold * (1 - threshold)))


def set_name(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


def text_hash() -> Column:
    return F.xxhash64("text").alias("text_hash")


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, rep, bands, sig) of ``docs``; the last three null for empty sets.

    ``rep`` names the set, ``sig`` has the low byte of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            sizes, ids, bands, sigs = [], [], [], []
            for value in batch.column(2):
                found = shingle(bytes(value.as_buffer())) if value.is_valid else ()
                sizes.append(len(found))
                if len(found):
                    low = minima(found)
                    ids.append(set_name(found))
                    bands.append(band_keys(low))
                    sigs.append(low.astype(np.uint8).tobytes())
                else:
                    ids.append(None), bands.append(None), sigs.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(ids, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "rep", "bands", "sig"],
            )

    return docs.select("doc_id", text_hash(), "text").mapInArrow(run, "doc_id long, text_hash long, n_shingles int, rep long, bands array<long>, sig binary")


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> tuple[DataFrame, str]:
    """(rep, shingles) for the sets of ``wanted(rep, doc_id, text_hash)``, each a document that has it, and
    the table's path: each whole set, as the bytes of its sorted hashes."""
    spark = docs.sparkSession
    bit = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(MAP_BITS))
    parts = wanted.select((bit / 64).cast("int").alias("word"), (bit % 64).cast("int").alias("place"))
    bitmap = np.zeros(MAP_BITS // 64, np.int64)
    # whatever the input, at most MAP_BITS / 64 rows of two numbers
    filled = parts.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, place))").alias("bits")).toArrow()
    bitmap[filled.column("word").to_numpy()] = filled.column("bits").to_numpy()
    shipped = spark.sparkContext.broadcast(bitmap.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, known = Shingler(words), shipped.value
        for batch in batches:
            place = batch.column(3).to_numpy()
            here = pa.array((known[place // 64] >> (place % 64).astype(np.uint64)) & np.uint64(1) == 1)
            rows = batch.filter(here)
            sets = [shingle(bytes(v.as_buffer())).tobytes() if v.is_valid else b"" for v in rows.column(2)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(sets, pa.binary())], ["doc_id", "text_hash", "shingles"])

    texts = docs.select("doc_id", text_hash(), "text")
    made = texts.select("doc_id", "text_hash", "text", bit.alias("bit")).mapInArrow(run, "doc_id long, text_hash long, shingles binary")
    named = made.join(wanted.select("rep", "doc_id", "text_hash").distinct(), ["doc_id", "text_hash"]).select("rep", "shingles")
    out = shared.staged(named.dropDuplicates(["rep"]), "near-sets")
    shipped.destroy()
    return out


def signature_matches(pairs: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """``pairs(a, b)`` whose signatures agree in ``least`` places or more, with that number."""
    light = sketches.select("rep", "sig")
    both = pairs.join(light.toDF("a", "sig_a"), "a").join(light.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, HASHES) for i in (2, 3))
            same = (a == b).sum(axis=1)
            keep = pa.array(same >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(same, pa.int32()).filter(keep)], ["a", "b", "same"])

    return both.mapInArrow(run, "a long, b long, same int")


def passes(left: np.ndarray, right: np.ndarray, part: int, whole: int) -> bool:
    """Whether two sets, sorted, have whole * intersection >= part * union."""
    joined = np.concatenate([left, right])
    joined.sort(kind="stable")
    common = int((joined[1:] == joined[:-1]).sum())
    return whole * common >= part * (len(joined) - common) > 0


def confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, words: int, part: int, whole: int) -> tuple[DataFrame, str]:
    """``pairs(a, b)`` with whole * intersection >= part * union on their full sets."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(reps.select("rep", "doc_id", "text_hash"), "rep")
    sets, path = full_sets(docs, wanted, words)
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                left, right = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                keep.append(passes(left, right, part, whole))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    links, links_path = shared.staged(both.mapInArrow(run, "a long, b long"), "near-links")
    shared.drop_paths(docs.sparkSession, path)
    return links, links_path


def star_components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links(a, b)``: the smallest node that each can reach.

    Alternates large-star (every larger neighbour of a node is linked to the node's smallest
    neighbour) and small-star (every smaller one is) until the links are stars."""
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges, path = shared.staged(edges, "star")
    seen = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.toDF("u", "v")).distinct()
        new, new_path = shared.staged(small, "star")
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        shared.drop_paths(spark, path)
        edges, path = new, new_path
        if now == seen:
            break
        seen = now
    return edges.toDF("node", "component").union(edges.select("v", "v").distinct())


def in_groups(rows: DataFrame, work: Callable[[pa.Table], list[pa.Array]], schema: str) -> DataFrame:
    """``work`` on each group (key, i, j) of ``rows``, groups dealt out by hash and streamed in order.

    A task holds one group, two blocks at most, and the batch that it came with."""
    width = shared.partitions(rows.sparkSession)
    dealt = rows.repartition(width, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table, ends: list[int]) -> Iterator[pa.RecordBatch]:
            for at, end in zip([0, *ends[:-1]], ends, strict=True):
                if end - at > 1:
                    out = pa.RecordBatch.from_arrays(work(table.slice(at, end - at)), names)
                    if out.num_rows:
                        yield out

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            key, i, j = (table.column(c).to_numpy() for c in ("key", "i", "j"))
            ends = (1 + np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))).tolist()
            if ends:
                yield from done(table, ends)
            held = table.slice(ends[-1] if ends else 0).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from done(table, [table.num_rows])

    return dealt.mapInArrow(run, schema)


class Group:
    """The members of a group (key, i, j) and which of them may be linked."""

    def __init__(self, table: pa.Table, least: int, part: int, whole: int):
        self.key = table.column("key")[0].as_py()
        self.own, self.rep, self.comp, self.size = (table.column(c).to_numpy() for c in ("own", "rep", "comp", "n_shingles"))
        self.sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
        self.bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        self.inner = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        self.least, self.part, self.whole = least, part, whole

    def partners(self, x: int, comp: np.ndarray) -> np.ndarray:
        """Later members of another component that pass with ``x`` by size and signature, if this
        key is the first band that both share. In a pair of two blocks, only members of different
        blocks meet."""
        meet = comp[x + 1 :] != comp[x]
        if not self.inner:
            meet &= self.own[x + 1 :] != self.own[x]
        low, high = np.minimum(self.size[x + 1 :], self.size[x]), np.maximum(self.size[x + 1 :], self.size[x])
        near = x + 1 + np.flatnonzero(meet & (self.whole * low.astype(np.int64) >= self.part * high))
        near = near[(self.sig[near] == self.sig[x]).sum(axis=1) >= self.least]
        same = self.bands[near] == self.bands[x]
        return near[self.bands[x][same.argmax(axis=1)] == self.key] if len(near) else near


def placed_members(members: DataFrame) -> DataFrame:
    """(key, i, j, own, rep, comp): the groups in which members of ``members(key, rep, comp)`` meet.

    In a group of a block of the largest component and a block of strangers (i < 0) ``own`` is the
    side; in one of two blocks of strangers (i <= j) it is the block."""
    counts = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    main = counts.groupBy("key").agg(F.max_by("comp", F.struct("n", F.negative("comp"))).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"))
    n_main, n_rest = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("n_main", "n_rest"))
    sized = members.join(main, "key").withColumn("n_rest", F.col("n") - F.col("n_main")).withColumn("is_main", F.col("comp") == F.col("main"))
    sized = sized.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("is_main"), n_main).otherwise(n_rest)).cast("int"))

    def cell(i: Column, j: Column, own: Column) -> Column:
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), own.cast("int").alias("own"))

    own, blocks = F.col("own"), lambda n: F.sequence(F.lit(0), n - 1)
    of_main = F.transform(blocks(n_rest), lambda j: cell(-1 - own, j, F.lit(-1)))
    with_main = F.transform(blocks(n_main), lambda i: cell(-1 - i, own, F.lit(-2)))
    with_rest = F.transform(blocks(n_rest), lambda k: cell(F.least(own, k), F.greatest(own, k), own))
    cells = F.when(F.col("is_main"), of_main).otherwise(F.concat(with_main, with_rest))
    return sized.select("key", F.explode(cells).alias("c"), "rep", "comp").select("key", "c.i", "c.j", "c.own", "rep", "comp")


def block_links(members: DataFrame, reps: DataFrame, docs: DataFrame, words: int, least: int, part: int, whole: int) -> DataFrame:
    """Links (a, b) that join all components within each bucket of ``members(key, rep, comp)``."""
    placed = placed_members(members)
    light = reps.select("rep", "n_shingles", "sig", "bands")

    def with_partner(table: pa.Table) -> list[pa.Array]:
        group = Group(table, least, part, whole)
        found = np.zeros(len(group.rep), bool)
        for x in range(len(found)):
            near = group.partners(x, group.comp)
            if len(near):
                found[near] = found[x] = True
        keep = table.filter(pa.array(found))
        return [keep.column(c).combine_chunks() for c in names]

    schema = "key long, i int, j int, own int, rep long, comp long, n_shingles int, sig binary, bands array<long>"
    names = [x.split()[0] for x in schema.split(", ")]
    open_, open_path = shared.staged(in_groups(placed.join(light, "rep"), with_partner, schema), "near-open")
    wanted = open_.select("rep").distinct().join(reps.select("rep", "doc_id", "text_hash"), "rep")
    sets, sets_path = full_sets(docs, wanted, words)

    def joining(table: pa.Table) -> list[pa.Array]:
        group = Group(table, least, part, whole)
        shingles = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        comp, left, right = group.comp.copy(), [], []
        for x in range(len(comp)):
            for y in group.partners(x, comp):
                if comp[x] != comp[y] and passes(shingles[x], shingles[y], part, whole):
                    left.append(group.rep[x]), right.append(group.rep[y])
                    comp[comp == comp[y]] = comp[x]
        return [pa.array(left, pa.int64()), pa.array(right, pa.int64())]

    full = open_.join(sets, "rep")
    links, _ = shared.staged(in_groups(full, joining, "a long, b long"), "near-more")
    shared.drop_paths(docs.sparkSession, open_path, sets_path)
    return links


def near_components(docs: DataFrame, words: int, part: int, whole: int) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, text_hash, n_shingles, component_id, and the component's
    own name ``comp`` (null without one); the steps above."""
    spark, threshold = docs.sparkSession, part / whole
    if not 0 < threshold <= 1 or (1 - threshold**ROWS) ** BANDS > 1e-6:
        raise ValueError("the bands are made for similarities of 0.8 or more")
    least = least_agreement(threshold)
    known = docs.where("doc_id is not null")
    sketches, _ = shared.staged(sketch(docs, words), "near-sketch")
    usable = sketches.where("doc_id is not null and rep is not null")
    classes = usable.groupBy("rep").agg(F.min(F.struct("doc_id", "text_hash", "n_shingles", "bands", "sig")).alias("first"))
    reps, reps_path = shared.staged(classes.select("rep", "first.*"), "near-reps")
    banded = reps.select("rep", F.explode("bands").alias("key"))
    leaders = banded.groupBy("key").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).where("n > 1")
    buckets, buckets_path = shared.staged(banded.join(leaders, "key"), "near-buckets")
    to_lead = buckets.where("rep != lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    best = signature_matches(to_lead, reps, least).groupBy("b").agg(F.max_by("a", F.struct("same", F.negative("a"))).alias("a")).select("a", "b")
    best, best_path = shared.staged(best, "near-best")
    links, links_path = confirmed(best, reps, known, words, part, whole)
    joined, joined_path = shared.staged(star_components(links), "near-joined")

    located = buckets.join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    mixed = located.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("key")
    more = block_links(located.join(mixed, "key").select("key", "rep", "comp"), reps, known, words, least, part, whole)
    stars = joined.where("node != component").toDF("a", "b").union(more)
    components = star_components(stars).toDF("rep", "comp")
    # a component's name is its smallest doc_id, which one of its classes has
    first = reps.select("rep", "doc_id").join(components, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    first, _ = shared.staged(first, "near-components")
    names = first.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    named = first.join(names.where("n > 1").drop("n"), "comp", "left").select("rep", F.coalesce("component_id", "doc_id").alias("component_id"), "comp")
    out = usable.select("doc_id", "text_hash", "n_shingles", "rep").join(named, "rep").select("doc_id", "text_hash", "n_shingles", "component_id", "comp")
    rest = sketches.where("doc_id is null or rep is null").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long"))
    shared.drop_paths(spark, reps_path, buckets_path, best_path, links_path, joined_path)
    return out.union(rest)


def near_duplicates(docs: DataFrame, words: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept.

    Documents with whole * intersection >= part * union of their shingle sets are linked;
    component_id is the smallest doc_id that links reach. Null and empty texts are linked with
    nothing; texts of any length count whole. Rows of one doc_id are documents of their own, linked
    by their texts alone. Rows without doc_id are not compared: their component_id is null and they
    are kept. Further columns are ignored; an empty table gives an empty one.
    """
    found = near_components(docs, words, part, whole)
    return found.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, words: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest doc_id; all its columns.

    Of several rows of a component with that doc_id, one of the smallest text hash stays. Rows
    without text are in no component and stay, as do rows without doc_id and rows of one doc_id with
    unlike texts. An empty table gives an empty one."""
    found, _ = shared.staged(near_components(docs, words, part, whole).where("comp is not null"), "near-rows")
    removed = found.where("doc_id != component_id").select("doc_id", "text_hash")
    own = found.where("doc_id = component_id")
    first, _ = shared.staged(own.groupBy("doc_id", "comp").agg(F.min("text_hash").alias("least"), F.count("*").alias("n")).where("n > 1"), "near-repeated")
    repeated = own.join(first, ["doc_id", "comp"]).where("text_hash != least").select("doc_id", "text_hash")
    key = next(name for i in range(len(docs.columns) + 1) if (name := f"_hash{i}") not in docs.columns)
    left = docs.withColumn(key, F.xxhash64("text"))
    gone = removed.union(repeated).distinct().withColumnRenamed("text_hash", key)
    left = left.join(gone, ["doc_id", key], "left_anti")
    if first.isEmpty():
        return left.select(docs.columns)
    same = first.select("doc_id", F.col("least").alias(key))
    once = left.join(same, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
    return left.join(same, ["doc_id", key], "left_anti").select(docs.columns).union(once.select(docs.columns))
