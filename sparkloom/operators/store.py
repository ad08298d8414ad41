"""Keyed tables on Parquet: upserts as new versions, counts, ingest progress and lookups."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import clean
from sparkloom.schemas import KEYS, TABLES, columns


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; within ``new``, the last by ``order`` wins.

    Applying the same rows twice changes nothing. A key may not be null in part: nulls are equal."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.select(old.columns).withColumn("_new", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy(F.desc("_new"), *order, F.desc(F.xxhash64(*old.columns)))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_new")


def aliases_of(books: DataFrame) -> DataFrame:
    """(id_type, id_value, work_id) for each identifier that a book has; the smallest work wins."""
    kinds = ["goodreads_id", "isbn13", "asin", "openlibrary_id"]
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("id_type"), clean.text_or_null(F.col(k)).alias("id_value")) for k in kinds)))
    rows = books.select("work_id", pairs.alias("a")).select("a.*", "work_id").where("id_value is not null")
    return rows.groupBy("id_type", "id_value").agg(F.min("work_id").alias("work_id"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) of all tables in one job."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def with_title_norm(books: DataFrame) -> DataFrame:
    """Fill the title key where it is missing."""
    from sparkloom.functions.identity import normalize_title

    return books.withColumn("title_norm", F.coalesce("title_norm", normalize_title("title")))


def search_titles(books: DataFrame, query: str, limit: int) -> DataFrame:
    """Books whose title or key has ``query``: prefix matches, then most rated, then short titles."""
    plain, key = query.strip().lower(), clean.needle(F.lit(query))
    in_key = (key != "") & F.contains(F.coalesce("title_norm", F.lit("")), key)
    found = books.where(in_key | F.contains(F.lower("title"), F.lit(plain)) if plain else F.lit(False))
    starts = F.coalesce(F.startswith("title_norm", key), F.lit(False))
    return found.orderBy(F.desc(starts), F.desc_nulls_last("ratings_count"), F.length("title"), "work_id").limit(limit)


class Store:
    """The tables of a graph as Parquet folders; every write is a new folder that is then pointed to.

    A reader of the old version is never disturbed, and no plan reads the path that it overwrites.
    """

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False):
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only

    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _current(self, name: str) -> str | None:
        pointer, files = self._hadoop(f"{self.root}/{name}/CURRENT")
        if not files.exists(pointer):
            return None
        return self.spark.read.text(f"{self.root}/{name}/CURRENT").first()[0]

    def exists(self, name: str) -> bool:
        return self._current(name) is not None

    def table(self, name: str) -> DataFrame:
        """The table, empty before its first write."""
        version = self._current(name)
        if version is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}/{version}")

    def rows(self, name: str):
        """A table's rows one by one, a partition at a time on the driver."""
        return self.table(name).toLocalIterator(prefetchPartitions=True)

    def replace(self, name: str, df: DataFrame) -> None:
        if self.read_only:
            raise PermissionError(f"the store {self.root} is open for reading only")
        version = f"v-{uuid.uuid4().hex}"
        old = self._current(name)
        named = [F.col(c).cast(kind).alias(c) for c, kind in columns(TABLES[name])]
        df.select(named).write.parquet(f"{self.root}/{name}/{version}")
        pointer, files = self._hadoop(f"{self.root}/{name}/CURRENT")
        stream = files.create(pointer, True)
        stream.write(bytearray(version.encode()))
        stream.close()
        if old:
            gone, files = self._hadoop(f"{self.root}/{name}/{old}")
            files.delete(gone, True)

    def upsert(self, name: str, df: DataFrame, order: Sequence[Column] = ()) -> None:
        self.replace(name, upserted(self.table(name), df, KEYS[name], order))

    def add_books(self, books: DataFrame) -> None:
        """Upsert books with their title keys, and the aliases of all their ids."""
        filled = with_title_norm(books)
        self.upsert("books", filled)
        self.upsert("aliases", aliases_of(filled))

    def add_edges(self, edges: DataFrame) -> None:
        """Upsert raw edges; of one batch's equal keys the best rank stays."""
        self.upsert("edges_raw", edges, [F.asc("rank")])

    def mark_ingest(self, source: str, artifact: str, rows_done: int, books_added: int, edges_added: int, completed: bool = True) -> None:
        row = self.spark.createDataFrame([(source, artifact, rows_done, books_added, edges_added, completed)], "source string, artifact string, rows_done long, books_added long, edges_added long, completed boolean")
        self.upsert("ingest_state", row.withColumn("updated_at", F.current_timestamp()))

    def counts(self) -> DataFrame:
        return table_counts({name: self.table(name) for name in TABLES})
