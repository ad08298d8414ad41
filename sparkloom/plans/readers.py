"""Registered queries that write the driver's tables as dumps and read them with the library's readers."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import identity
from sparkloom.lineage import shared_dir
from sparkloom.operators import layout
from sparkloom.sources import star
from sparkloom.sources.dumps import BlockDump, ProductDump, WorksDump

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return register


def written(df: DataFrame, form: str) -> str:
    path = f"{shared_dir(df.sparkSession)}/dump-{uuid.uuid4().hex}"
    getattr(df.write, form)(path)
    return path


def long_rank(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "kind", F.col("rank").cast("long").alias("rank"), "source")


def item(n: Column) -> Column:
    return F.concat(F.lit("P"), n.cast("string"))


def block_dump(spark: SparkSession, d: str) -> BlockDump:
    """Parts as blocks with CRLF line ends and blank lines that hold white space."""
    n = F.col("p_partkey")
    lines = [
        F.concat(F.lit("Id: "), n.cast("string")), F.concat(F.lit("ASIN: "), item(n)), F.concat(F.lit("  title: "), F.col("p_name"), F.lit(": "), F.col("p_type")),
        F.when(n % 3 == 0, F.lit("  group: DVD")).otherwise(F.lit("  group: Book")), F.concat(F.lit("  similar: 3  "), item(n + 1), F.lit(" "), item(n), F.lit("  "), item(n + 2)),
        F.concat(F.lit("  reviews: total: "), F.col("p_size").cast("string"), F.lit("  downloaded: 1  avg rating: 4.5")), F.when(n % 5 == 0, F.lit("  discontinued product")),
    ]
    blank = F.element_at(F.array(F.lit(""), F.lit("\r"), F.lit("  ")), (n % 3 + 1).cast("int"))
    text = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n"), blank)
    return BlockDump(written(star.table(spark, d, "part").select(text.alias("value")), "text"))


@query(
    """SELECT 'az-P' || p_partkey AS work_id, p_name || ': ' || p_type AS title, 'P' || p_partkey AS asin, CAST(4.5 AS DOUBLE) AS avg_rating, CAST(p_size AS BIGINT) AS ratings_count
    FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0"""
)
def block_dump_books(spark: SparkSession, d: str) -> DataFrame:
    return block_dump(spark, d).books(spark).select("work_id", "title", "asin", "avg_rating", "ratings_count")


@query(
    """SELECT 'amazon_meta:P' || p_partkey AS src, 'amazon_meta:P' || (p_partkey + gap) AS dst, 'az_also_bought' AS kind, CAST(rank AS BIGINT) AS rank, 'amazon_meta' AS source
    FROM part, (VALUES (1, 1), (2, 3)) AS gaps(gap, rank) WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0"""
)
def block_dump_edges(spark: SparkSession, d: str) -> DataFrame:
    return long_rank(block_dump(spark, d).edges(spark))


def works_dump(spark: SparkSession, d: str, max_rank: int | None = None) -> WorksDump:
    """Parts as editions of works, numbers as texts; every seventh has no title."""
    n = F.col("p_partkey")
    text = n.cast("string")
    rows = star.table(spark, d, "part").select(
        text.alias("book_id"), F.when(n % 11 > 0, (n % 700).cast("string")).otherwise(F.lit(" ")).alias("work_id"), F.when(n % 7 > 0, F.col("p_name")).otherwise(F.lit("")).alias("title"),
        F.when(n % 4 == 0, F.concat(F.col("p_name"), F.lit("!"))).otherwise(F.lit(" ")).alias("title_without_series"),
        F.array(F.struct(F.col("p_brand").alias("author_id"), F.lit("").alias("role")), F.struct(F.lit("nobody").alias("author_id"), F.lit("").alias("role")), F.struct(F.col("p_type").alias("author_id"), F.lit("x").alias("role"))).alias("authors"),
        F.when(n % 5 > 0, F.concat(F.col("p_size").cast("string"), F.lit(".0"))).otherwise(F.lit("")).alias("ratings_count"),
        F.array((n + 1).cast("string"), F.lit(""), text, (n + 1).cast("string"), (n + 3).cast("string")).alias("similar_books"),
    )
    names = star.table(spark, d, "part").select(F.explode(F.array("p_brand", "p_type")).alias("author_id")).distinct().withColumn("name", F.concat(F.lit("Name of "), F.col("author_id")))
    return WorksDump(written(rows, "json"), written(names, "json"), max_rank)


@query(
    """WITH editions AS (
        SELECT CASE WHEN p_partkey % 11 > 0 THEN 'gr-' || (p_partkey % 700) ELSE 'gr-' || p_partkey END AS work_id, CASE WHEN p_partkey % 4 = 0 THEN p_name || '!' ELSE p_name END AS title,
               'Name of ' || p_brand || ',Name of ' || p_type AS authors, CASE WHEN p_partkey % 5 > 0 THEN CAST(p_size AS BIGINT) END AS ratings_count, CAST(p_partkey AS VARCHAR) AS goodreads_id
        FROM part WHERE p_partkey % 7 > 0 OR p_partkey % 4 = 0)
    SELECT * FROM editions QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY coalesce(ratings_count, -1) DESC, goodreads_id) = 1"""
)
def works_dump_books(spark: SparkSession, d: str) -> DataFrame:
    return works_dump(spark, d).books(spark).select("work_id", "title", F.array_join("authors", ",").alias("authors"), "ratings_count", "goodreads_id")


@query(
    """SELECT 'goodreads_ucsd:' || p_partkey AS src, 'goodreads_ucsd:' || (p_partkey + 1) AS dst, 'gr_similar' AS kind, CAST(1 AS BIGINT) AS rank, 'goodreads_ucsd' AS source
    FROM part WHERE p_partkey % 7 > 0 OR p_partkey % 4 = 0"""
)
def works_dump_edges(spark: SparkSession, d: str) -> DataFrame:
    """The better rank of a repeated target, up to rank 3."""
    return long_rank(works_dump(spark, d, max_rank=3).edges(spark))


def product_dump(spark: SparkSession, d: str) -> ProductDump:
    """Parts as products; authors are a text, an object, a list, or lists in a list, by turns."""
    n = F.col("p_partkey")
    one, other = F.to_json(F.struct(F.col("p_brand").alias("name"))), F.concat(F.lit('"'), F.col("p_type"), F.lit('"'))
    author = F.element_at(F.array(other, one, F.concat(F.lit("["), one, F.lit(","), other, F.lit("]")), F.concat(F.lit("["), one, F.lit(",["), other, F.lit("]]"))), (n % 4 + 1).cast("int"))
    lists = F.concat(F.lit(',"also_buy":['), F.when(n % 2 == 0, F.concat(F.lit('"'), item(n + 2), F.lit('"'))).otherwise(F.lit("")), F.lit('],"bought_together":["'), item(n + 5), F.lit('"],"also_view":["'), item(n), F.lit('","'), item(n + 7), F.lit('"]}'))
    key = F.when(n % 6 == 0, F.lit('{"asin":"')).otherwise(F.lit('{"asin":"gone","parent_asin":"'))
    line = F.concat(key, item(n), F.lit('","title":"'), F.col("p_name"), F.lit('","average_rating":4.25,"rating_number":'), F.col("p_size").cast("string"), F.lit(',"author":'), author, lists)
    return ProductDump(written(star.table(spark, d, "part").select(line.alias("value")), "text"))


@query(
    """SELECT 'az-P' || p_partkey AS work_id, p_name AS title, CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN p_brand ELSE p_brand || ',' || p_type END AS authors,
              CAST(4.25 AS DOUBLE) AS avg_rating, CAST(p_size AS BIGINT) AS ratings_count FROM part"""
)
def product_dump_books(spark: SparkSession, d: str) -> DataFrame:
    return product_dump(spark, d).books(spark).select("work_id", "title", F.array_join("authors", ",").alias("authors"), "avg_rating", "ratings_count")


@query(
    """SELECT 'amazon_reviews_2023:P' || p_partkey AS src, 'amazon_reviews_2023:P' || (p_partkey + CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 5 END) AS dst, 'az_also_bought' AS kind,
              CAST(1 AS BIGINT) AS rank, 'amazon_reviews_2023' AS source FROM part
    UNION ALL SELECT 'amazon_reviews_2023:P' || p_partkey, 'amazon_reviews_2023:P' || (p_partkey + 7), 'az_also_viewed', 2, 'amazon_reviews_2023' FROM part"""
)
def product_dump_edges(spark: SparkSession, d: str) -> DataFrame:
    """The first list of a kind that isn't empty."""
    return long_rank(product_dump(spark, d).edges(spark))


@query(
    """WITH digits AS (SELECT p_partkey, '978' || lpad(CAST(p_partkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS body FROM part),
    summed AS (SELECT p_partkey, body, (SELECT sum(CAST(substr(body, CAST(i AS INTEGER), 1) AS INTEGER) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END) FROM range(1, 13) AS places(i)) AS total FROM digits)
    SELECT p_partkey, CASE WHEN p_partkey % 4 <> 3 THEN body || CAST((10 - total % 10) % 10 AS INTEGER) END AS isbn13 FROM summed"""
)
def isbn13_canonical(spark: SparkSession, d: str) -> DataFrame:
    """ISBN-13 made from part keys, hyphenated; every fourth has a wrong check digit."""
    body = F.concat(F.lit("978"), F.lpad((F.col("p_partkey") * 7919 % 1_000_000_000).cast("string"), 9, "0"))
    total = sum((F.substring(body, i, 1).cast("int") * (3 if i % 2 == 0 else 1) for i in range(2, 13)), F.substring(body, 1, 1).cast("int"))
    check = (10 - total % 10 + F.when(F.col("p_partkey") % 4 == 3, 1).otherwise(0)) % 10
    isbn = F.concat(F.substring(body, 1, 3), F.lit("-"), F.substring(body, 4, 4), F.lit(" "), F.substring(body, 8, 5), F.lit("-"), check.cast("string"))
    return star.table(spark, d, "part").select("p_partkey", identity.canonical_isbn(isbn).alias("isbn13"))


@query(
    """WITH box AS (SELECT min(s_acctbal) AS lx, max(s_acctbal) AS hx, min(s_suppkey % 17) AS ly, max(s_suppkey % 17) AS hy FROM supplier),
    fit AS (SELECT *, least(CASE WHEN hx > lx THEN 920 / (hx - lx) END, CASE WHEN hy > ly THEN CAST(520 AS DOUBLE) / (hy - ly) END) AS scale FROM box)
    SELECT CAST(s_suppkey AS VARCHAR) AS node, round((s_acctbal - (lx + hx) / 2) * scale + 500, 6) AS x, round((s_suppkey % 17 - CAST(ly + hy AS DOUBLE) / 2) * scale + 300, 6) AS y FROM supplier, fit"""
)
def viewport_fit(spark: SparkSession, d: str) -> DataFrame:
    points = star.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("node"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") % 17).cast("double").alias("y"))
    return layout.normalized_positions(points, 1000.0, 600.0, 40.0).select("node", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
