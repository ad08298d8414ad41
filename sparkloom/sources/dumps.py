"""Readers of published item dumps: each gives a table of books and a table of ranked edges.

Edges name their ends by reference (``source:id``) until ``operators.refs`` resolves them. Readers
check that a local path exists when they are made; other paths are left to Spark.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import clean
from sparkloom.lineage import cut
from sparkloom.schemas import BOOKS, KIND_ALPHA, columns

#: Id prefixes of works, by source.
WORK_PREFIX = {"goodreads_ucsd": "gr-", "amazon": "az-", "openlibrary": "ol-"}


#: Lists within lists of authors that are opened.
AUTHOR_DEPTH = 4


class Source(Protocol):
    """A data set that describes books and the connections between them."""

    name: str

    def books(self, spark: SparkSession) -> DataFrame: ...

    def edges(self, spark: SparkSession) -> DataFrame: ...


def checked(path: str) -> str:
    if path.startswith("/") and not os.path.exists(path):
        raise FileNotFoundError(f"no such dump file: {path}")
    return path


def as_books(df: DataFrame) -> DataFrame:
    """``df`` in the columns of the book table; those it lacks are null, arrays empty."""
    out = []
    for name, kind in columns(BOOKS):
        c = (F.col(name) if name in df.columns else F.lit(None)).cast(kind)
        out.append((F.coalesce(c, F.array().cast(kind)) if name in ("authors", "subjects") else c).alias(name))
    return df.select(out)


def ranked(df: DataFrame, raw_id: str, targets: Column, kind: str, source: str) -> DataFrame:
    """Edges of one list column: position is rank; blank targets and the item itself are left out."""
    listed = df.select(F.col(raw_id).alias("_id"), F.posexplode(targets).alias("_pos", "_target"))
    listed = listed.withColumn("_target", clean.text_or_null(F.col("_target"))).where("_target is not null and _target != _id")
    return listed.select(
        F.concat(F.lit(source + ":"), "_id").alias("src"), F.concat(F.lit(source + ":"), "_target").alias("dst"),
        F.lit(kind).alias("kind"), (F.col("_pos") + 1).cast("int").alias("rank"), F.lit(source).alias("source"),
    )


def best_rank(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst, kind, source): that of the best rank."""
    return edges.groupBy("src", "dst", "kind", "source").agg(F.min("rank").alias("rank")).select("src", "dst", "kind", "rank", "source")


@dataclass(frozen=True)
class WorksDump:
    """NDJSON of editions with numbers as strings, author ids and a similar-items list."""

    path: str
    authors_path: str | None = None
    max_rank: int | None = None
    name: str = "goodreads_ucsd"

    SCHEMA = (
        "book_id string, work_id string, title string, title_without_series string, authors array<struct<author_id:string,role:string>>, isbn string, "
        "isbn13 string, asin string, publication_year string, average_rating string, ratings_count string, series array<string>, similar_books array<string>"
    )

    def __post_init__(self) -> None:
        checked(self.path)
        if self.authors_path:
            checked(self.authors_path)

    def _titled(self, spark: SparkSession) -> DataFrame:
        rows = spark.read.schema(self.SCHEMA).option("mode", "FAILFAST").json(self.path)
        title = F.coalesce(clean.text_or_null(F.col("title_without_series")), clean.text_or_null(F.col("title")))
        return rows.withColumn("title", title).withColumn("book_id", clean.text_or_null(F.col("book_id"))).where("book_id is not null and title is not null")

    def author_names(self, spark: SparkSession) -> DataFrame:
        if not self.authors_path:
            return spark.createDataFrame([], "author_id string, name string")
        rows = spark.read.schema("author_id string, name string").option("mode", "FAILFAST").json(self.authors_path)
        rows = rows.select(clean.text_or_null(F.col("author_id")).alias("author_id"), clean.text_or_null(F.col("name")).alias("name"))
        return rows.where("author_id is not null and name is not null").groupBy("author_id").agg(F.max("name").alias("name"))

    def editions(self, spark: SparkSession) -> DataFrame:
        """One row per edition, authors named in their order; unknown author ids are dropped."""
        rows = self._titled(spark)
        listed = rows.select("book_id", F.posexplode("authors").alias("pos", "a")).select("book_id", "pos", clean.text_or_null(F.col("a.author_id")).alias("author_id"))
        named = listed.join(self.author_names(spark), "author_id").groupBy("book_id").agg(F.array_sort(F.collect_set(F.struct("pos", "name"))).alias("found"))
        named = named.select("book_id", F.col("found.name").alias("names"))
        prefix = F.lit(WORK_PREFIX["goodreads_ucsd"])
        joined = rows.join(named, "book_id", "left")
        return as_books(
            joined.select(
                F.concat(prefix, F.coalesce(clean.text_or_null(F.col("work_id")), "book_id")).alias("work_id"), "title", F.col("names").alias("authors"),
                clean.int_or_null(F.col("publication_year")).alias("year"), clean.text_or_null(F.col("isbn13")).alias("isbn13"),
                clean.text_or_null(F.col("asin")).alias("asin"), F.col("book_id").alias("goodreads_id"),
                clean.text_or_null(F.try_element_at("series", F.lit(1))).alias("series"), clean.double_or_null(F.col("average_rating")).alias("avg_rating"),
                clean.long_or_null(F.col("ratings_count")).alias("ratings_count"),
            )
        )

    def books(self, spark: SparkSession) -> DataFrame:
        """One row per work: its most-rated edition, then the smallest edition id."""
        return most_rated(self.editions(spark))

    def edges(self, spark: SparkSession) -> DataFrame:
        found = best_rank(ranked(self._titled(spark), "book_id", F.col("similar_books"), "gr_similar", self.name))
        return found.where(F.col("rank") <= self.max_rank) if self.max_rank else found


def most_rated(editions: DataFrame) -> DataFrame:
    """One edition per work, partial minima first: most ratings (unknown last), smallest edition id."""
    order = F.struct(F.negative(F.coalesce("ratings_count", F.lit(-1))).alias("r"), F.col("goodreads_id"), F.struct(*editions.columns).alias("row"))
    return editions.groupBy("work_id").agg(F.min(order).alias("best")).select("best.row.*")


def blocks_of_lines(lines: DataFrame) -> DataFrame:
    """(file, start, block, at, value): the lines of ``lines(file, start, at, value)`` that aren't blank, with a
    name of their block (file, start, block). Blank lines, of white space alone, end a block.

    Files are read in splits (file, start), lines in the order of ``at``. What stands before a split's first
    blank line goes on with the last block of an earlier split of the file, that of the nearest split with
    a blank line; a window over one row per split finds it."""
    split = Window.partitionBy("file", "start").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = lines.withColumn("_blank", F.trim(F.regexp_replace("value", r"\s+", " ")) == "").withColumn("block", F.count_if("_blank").over(split))
    ends = lines.groupBy("file", "start").agg(F.count_if(F.trim(F.regexp_replace("value", r"\s+", " ")) == "").alias("_n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("_n") > 0, F.struct(F.col("start").alias("s"), F.col("_n").alias("b"))), ignorenulls=True).over(before)
    carried = ends.select("file", "start", last.alias("_last"))
    joined = counted.where(~F.col("_blank")).join(carried, ["file", "start"])
    goes_on = F.col("block") == 0
    first = F.struct(F.lit(-1).cast("long").alias("s"), F.lit(0).cast("long").alias("b"))  # the file's first block
    own = F.when(goes_on, F.coalesce("_last", first)).otherwise(F.struct(F.col("start").alias("s"), F.col("block").alias("b")))
    return joined.select("file", own["s"].alias("start"), own["b"].alias("block"), F.struct("start", "at").alias("at"), "value")


@dataclass(frozen=True)
class BlockDump:
    """Blank-line-separated ``key: value`` blocks, whatever their line ends and the white space on blank
    lines. Only books with an id and a title count."""

    path: str
    name: str = "amazon_meta"

    FIELDS = ("asin", "title", "group", "similar", "reviews")

    def __post_init__(self) -> None:
        checked(self.path)

    def records(self, spark: SparkSession) -> DataFrame:
        """One row per block; of several lines with one key the last counts, and the first colon ends the key."""
        text = spark.read.text(self.path)
        lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")
        key = F.lower(F.regexp_extract("value", r"(?i)^\s*(asin|title|group|similar|reviews)\s*:", 1))
        gone = F.col("value").rlike(r"^\s*discontinued product\s*$")
        told = blocks_of_lines(cut(lines.where((key != "") | gone | F.col("value").rlike(r"^\s*$"))))
        told = told.select("file", "start", "block", "at", key.alias("key"), F.regexp_extract("value", r"^[^:]*:(.*)$", 1).alias("value"), gone.alias("gone"))
        fields = (clean.text_or_null(F.max_by(F.when(F.col("key") == f, F.col("value")), F.when(F.col("key") == f, F.col("at")))).alias(f) for f in self.FIELDS)
        rows = told.groupBy("file", "start", "block").agg(*fields, F.bool_or("gone").alias("gone")).withColumn("group", F.lower("group"))
        return rows.where("not gone and asin is not null and title is not null and `group` = 'book'").drop("file", "start", "block", "gone")

    def books(self, spark: SparkSession) -> DataFrame:
        number = F.regexp_extract("reviews", r"avg rating:\s*(\S+)", 1)
        total = F.regexp_extract("reviews", r"total:\s*(\S+)", 1)
        rows = self.records(spark).select(
            F.concat(F.lit(WORK_PREFIX["amazon"]), "asin").alias("work_id"), "title", "asin",
            clean.double_or_null(number).alias("avg_rating"), clean.long_or_null(total).alias("ratings_count"),
        )
        return as_books(rows).dropDuplicates(["work_id"])

    def edges(self, spark: SparkSession) -> DataFrame:
        # the leading count says nothing that the list doesn't
        targets = F.slice(F.split("similar", r"\s+"), 2, 1_000_000)
        return best_rank(ranked(self.records(spark), "asin", targets, "az_also_bought", self.name))


@dataclass(frozen=True)
class ProductDump:
    """NDJSON of products; the author may be a text, an object or a list of these."""

    path: str
    max_rank: int | None = None
    name: str = "amazon_reviews_2023"

    SCHEMA = (
        "parent_asin string, asin string, title string, author string, average_rating string, rating_number string, categories array<string>, "
        "also_buy array<string>, bought_together array<string>, also_view array<string>, also_viewed array<string>"
    )

    def __post_init__(self) -> None:
        checked(self.path)

    def records(self, spark: SparkSession) -> DataFrame:
        rows = spark.read.schema(self.SCHEMA).option("mode", "FAILFAST").json(self.path)
        asin = F.coalesce(clean.text_or_null(F.col("parent_asin")), clean.text_or_null(F.col("asin")))
        return rows.withColumn("asin", asin).withColumn("title", clean.text_or_null(F.col("title"))).where("asin is not null and title is not null")

    @staticmethod
    def author_names(author: Column) -> Column:
        """Names out of the field's JSON text."""
        found = F.array(author)
        for _ in range(AUTHOR_DEPTH):
            found = F.flatten(F.transform(found, lambda x: F.when(x.startswith("["), F.coalesce(F.from_json(x, F.lit("array<string>")), F.array(x))).otherwise(F.array(x))))
        return clean.texts(F.transform(found, lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.name")).otherwise(x)))

    def books(self, spark: SparkSession) -> DataFrame:
        rows = self.records(spark).select(
            F.concat(F.lit(WORK_PREFIX["amazon"]), "asin").alias("work_id"), "title", self.author_names(F.col("author")).alias("authors"), "asin",
            clean.double_or_null(F.col("average_rating")).alias("avg_rating"), clean.long_or_null(F.col("rating_number")).alias("ratings_count"),
            clean.texts(F.col("categories")).alias("subjects"),
        )
        return as_books(rows).dropDuplicates(["work_id"])

    def edges(self, spark: SparkSession) -> DataFrame:
        rows = self.records(spark)
        bought = ranked(rows, "asin", clean.first_list(F.col("also_buy"), F.col("bought_together")), "az_also_bought", self.name)
        viewed = ranked(rows, "asin", clean.first_list(F.col("also_view"), F.col("also_viewed")), "az_also_viewed", self.name)
        found = best_rank(bought.unionByName(viewed))
        return found.where(F.col("rank") <= self.max_rank) if self.max_rank else found


@dataclass(frozen=True)
class CorpusFile:
    """One JSON document with ``books`` and ``edges``; an unknown edge kind is an error."""

    path: str
    name: str = "demo"

    SCHEMA = (
        "books array<struct<id:string,title:string,authors:array<string>,year:int,subjects:array<string>>>, "
        "edges array<struct<src:string,similar:array<string>,kind:string>>"
    )

    def __post_init__(self) -> None:
        checked(self.path)

    def _read(self, spark: SparkSession, field: str) -> DataFrame:
        return spark.read.schema(self.SCHEMA).option("multiLine", True).json(self.path).select(F.explode(field).alias("x")).select("x.*")

    def books(self, spark: SparkSession) -> DataFrame:
        rows = self._read(spark, "books").select(
            clean.text_or_null(F.col("id")).alias("work_id"), clean.text_or_null(F.col("title")).alias("title"),
            clean.texts(F.col("authors")).alias("authors"), "year", clean.texts(F.col("subjects")).alias("subjects"),
        )
        return as_books(rows.where("work_id is not null and title is not null"))

    def edges(self, spark: SparkSession) -> DataFrame:
        kind = F.coalesce("kind", F.lit("gr_similar"))
        known = F.when(kind.isin(*KIND_ALPHA), kind).otherwise(F.raise_error(F.concat(F.lit("unknown edge kind: "), kind)))
        rows = self._read(spark, "edges").select(clean.text_or_null(F.col("src")).alias("src_id"), "similar", known.alias("edge_kind")).where("src_id is not null")
        lists = [ranked(rows.where(F.col("edge_kind") == k), "src_id", F.col("similar"), k, self.name) for k in KIND_ALPHA]
        out = lists[0]
        for more in lists[1:]:
            out = out.unionByName(more)
        # rows of an unknown kind pass no filter above, so they are asked for here
        wrong = rows.where(~F.col("edge_kind").isin(*KIND_ALPHA)).select(*(F.lit(None).cast(t).alias(c) for c, t in out.dtypes))
        return best_rank(out.unionByName(wrong))
