"""Registered queries over the driver's tables, and the SQL that gives the same rows.

Floats are rounded on both sides, counts are longs, and arrays are written as texts. Queries whose
result SQL can't express (greedy or randomized methods) have no SQL; tests hold them against small
references.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import clean, identity
from sparkloom.lineage import cut, shared_dir, stored
from sparkloom.operators import centrality, community, connect, fuse, graph, layout, paths, rank, refs, seeds, store, walk
from sparkloom.plans import oracles as sql
from sparkloom.plans import readers
from sparkloom.schemas import GraphConfig, RecommendConfig
from sparkloom.sources import dumps, star
from sparkloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Steps of walks that SQL repeats.
STEPS = 20
SEEDS = ["1", "2"]
TERMINALS = ["1", "2", "3"]


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def fused_rows(fused: DataFrame) -> DataFrame:
    return fused.select("src", "dst", F.round("weight", 9).alias("weight"), F.round("dir_asym", 9).alias("dir_asym"), F.array_join("kinds", ",").alias("kinds"))


def long_rank(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "kind", F.col("rank").cast("long").alias("rank"), "source")


# -- edges of the sources --------------------------------------------------------------------------


@query(f"WITH {sql.BOUGHT} SELECT src, dst, kind, rank, source FROM bought")
def edges_also_bought(spark: SparkSession, d: str) -> DataFrame:
    return long_rank(star.also_bought(spark, d))


@query(f"WITH {sql.VIEWED} SELECT src, dst, kind, rank, source FROM viewed")
def edges_also_viewed(spark: SparkSession, d: str) -> DataFrame:
    return long_rank(star.also_viewed(spark, d))


@query(f"WITH {sql.PRICED} SELECT src, dst, kind, rank, source FROM priced")
def edges_similar_by_price(spark: SparkSession, d: str) -> DataFrame:
    return long_rank(star.similar_by_price(spark, d))


@query(f"WITH {sql.SUBJECTS} SELECT src, dst, kind, rank, source FROM subject_pairs")
def subject_edges(spark: SparkSession, d: str) -> DataFrame:
    return long_rank(star.shared_subjects(spark, d))


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, role FROM conversations")
def list_position_rank(spark: SparkSession, d: str) -> DataFrame:
    turns = star.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    return turns.select("conv_id", F.posexplode("turns").alias("pos", "t")).select("conv_id", (F.col("pos") + 1).cast("long").alias("rank"), "t.role")


@query("SELECT conv_id, string_agg(role, ' > ' ORDER BY turn) AS roles, count(*) AS n FROM conversations GROUP BY 1")
def ordered_list_agg(spark: SparkSession, d: str) -> DataFrame:
    turns = star.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    return turns.select("conv_id", F.array_join(F.col("turns.role"), " > ").alias("roles"), F.size("turns").cast("long").alias("n"))


# -- fusion ----------------------------------------------------------------------------------------


@query(f"WITH {sql.BOUGHT}, {sql.fused('SELECT * FROM bought')} {sql.FUSED_ROWS}")
def fuse_single_kind(spark: SparkSession, d: str) -> DataFrame:
    return fused_rows(star.bought_graph(spark, d))


@query(f"WITH {sql.EVERY}, {sql.fused('SELECT * FROM every')} {sql.FUSED_ROWS}")
def fuse_multi_kind(spark: SparkSession, d: str) -> DataFrame:
    return fused_rows(fuse.fuse(star.all_edges(spark, d)))


@query(f"WITH {sql.BOUGHT}, {sql.fused('SELECT * FROM bought', max_rank=10)} {sql.FUSED_ROWS}")
def fuse_max_rank(spark: SparkSession, d: str) -> DataFrame:
    return fused_rows(fuse.fuse(star.also_bought(spark, d), GraphConfig(max_rank=10)))


@query(
    f"WITH {sql.BOUGHT}, {sql.BOOKS}, kept AS (SELECT work_id FROM books WHERE ratings_count IS NULL OR ratings_count >= 30), "
    f"{sql.fused('SELECT * FROM bought WHERE src IN (SELECT work_id FROM kept) AND dst IN (SELECT work_id FROM kept)')} {sql.FUSED_ROWS}"
)
def fuse_min_ratings(spark: SparkSession, d: str) -> DataFrame:
    return fused_rows(fuse.fuse(star.also_bought(spark, d), GraphConfig(min_ratings=30), star.books(spark, d)))


@query(
    f"""WITH {sql.GRAPH}, strong AS (SELECT * FROM fused WHERE weight >= 0.18),
    ends AS (SELECT src AS node FROM strong UNION ALL SELECT dst FROM strong), inner_ AS (SELECT node FROM ends GROUP BY 1 HAVING count(*) > 1)
    SELECT src, dst, round(weight, 9) AS weight FROM strong WHERE src IN (SELECT node FROM inner_) AND dst IN (SELECT node FROM inner_)"""
)
def prune_drop_leaves(spark: SparkSession, d: str) -> DataFrame:
    return fuse.prune(star.bought_graph(spark, d), 0.18, leaves=True).select("src", "dst", F.round("weight", 9).alias("weight"))


# -- walks -----------------------------------------------------------------------------------------


def walked(spark: SparkSession, d: str, weights: list[float] | None = None) -> tuple[DataFrame, DataFrame]:
    adj = stored(star.bought_adjacency(spark, d), "adjacency")
    return adj, walk.pagerank(adj, walk.restart_weights(SEEDS, weights), steps=STEPS)


EVEN = "VALUES ('1', 0.5::DOUBLE), ('2', 0.5::DOUBLE)"
DAMPED = """degree AS (SELECT src AS node, count(*) AS degree FROM adj WHERE weight <> 0 GROUP BY 1),
scored AS (SELECT node, ppr, degree, ppr / pow(degree, 0.25) AS score FROM ppr JOIN degree USING (node) WHERE ppr > 0 AND node NOT IN ('1', '2'))"""


@query(f"WITH RECURSIVE {sql.walk(EVEN, STEPS)} SELECT node, round(ppr, 9) AS ppr FROM ppr")
def ppr_fixed_k(spark: SparkSession, d: str) -> DataFrame:
    return walked(spark, d)[1].select("node", F.round("ppr", 9).alias("ppr"))


@query(f"WITH RECURSIVE {sql.walk(EVEN.replace('0.5', '0.75', 1).replace('0.5', '0.25'), STEPS)} SELECT node, round(ppr, 9) AS ppr FROM ppr")
def ppr_weighted_seeds(spark: SparkSession, d: str) -> DataFrame:
    return walked(spark, d, [3.0, 1.0])[1].select("node", F.round("ppr", 9).alias("ppr"))


@query(f"WITH RECURSIVE {sql.walk(EVEN, STEPS)}, {DAMPED} SELECT node, degree, round(score, 9) AS score FROM scored ORDER BY scored.score DESC, node LIMIT 100")
def hub_damped_topk(spark: SparkSession, d: str) -> DataFrame:
    adj, ppr = walked(spark, d)
    return walk.candidates(walk.damped_scores(adj, ppr), SEEDS, 100).select("node", "degree", F.round("score", 9).alias("score"))


@query(
    f"WITH RECURSIVE {sql.walk(EVEN, STEPS)}, {DAMPED}, top AS (SELECT * FROM scored ORDER BY score DESC, node LIMIT 20) "
    "SELECT node AS work_id, p_name AS title, round(ppr, 9) AS ppr, degree, round(score, 9) AS score FROM top JOIN part ON node = CAST(p_partkey AS VARCHAR)"
)
def item_recommend_topk(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: co-purchases to edges, fusion, a walk from two parts, damping, the first 20."""
    adj, ppr = walked(spark, d)
    top = walk.candidates(walk.damped_scores(adj, ppr), SEEDS, 20)
    names = star.table(spark, d, "part").select(star.key("p_partkey").alias("node"), F.col("p_name").alias("title"))
    return names.join(F.broadcast(top), "node").select(F.col("node").alias("work_id"), "title", F.round("ppr", 9).alias("ppr"), "degree", F.round("score", 9).alias("score"))  # of 20 rows


# -- graph basics ----------------------------------------------------------------------------------


@query(f"WITH {sql.GRAPH} SELECT src AS node, count(*) AS degree, round(sum(weight), 9) AS weighted_degree FROM adj WHERE weight <> 0 GROUP BY 1")
def degree_weighted(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(star.bought_adjacency(spark, d)).select("node", "degree", F.round("weighted_degree", 9).alias("weighted_degree"))


@query(
    f"WITH {sql.GRAPH}, deg AS (SELECT src, count(*) AS n FROM adj GROUP BY 1) "
    "SELECT round(avg(n), 9) AS mean, round(quantile_cont(n, 0.5), 9) AS median, round(quantile_cont(n, 0.95), 9) AS p95, max(n) AS max FROM deg"
)
def degree_stats(spark: SparkSession, d: str) -> DataFrame:
    found = graph.degree_stats(star.bought_adjacency(spark, d))
    return found.select(*(F.round(c, 9).alias(c) for c in ("mean", "median", "p95")), "max")


@query(f"WITH {sql.GRAPH} SELECT (SELECT count(DISTINCT src) FROM adj) AS n_nodes, (SELECT count(*) FROM fused) AS n_edges")
def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_counts(star.bought_graph(spark, d))


@query(f"WITH {sql.GRAPH} SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT DISTINCT src AS node FROM adj)")
def node_index(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_index(star.bought_graph(spark, d)).select("node", F.col("idx").cast("long").alias("idx"))


@query(f"WITH {sql.GRAPH} SELECT dst AS neighbour, round(weight, 9) AS weight FROM adj WHERE src = '1' AND weight <> 0 ORDER BY adj.weight DESC, dst LIMIT 25")
def neighbors_topk(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(star.bought_graph(spark, d), "1", 25).select("neighbour", F.round("weight", 9).alias("weight"))


@query(
    f"WITH {sql.GRAPH}, inside AS (SELECT CAST(p_partkey AS VARCHAR) AS node FROM part WHERE p_brand = 'Brand#11') "
    "SELECT src, dst, round(weight, 9) AS weight FROM fused WHERE src IN (SELECT node FROM inside) AND dst IN (SELECT node FROM inside)"
)
def subgraph_induced(spark: SparkSession, d: str) -> DataFrame:
    ids = star.table(spark, d, "part").where("p_brand = 'Brand#11'").select(star.key("p_partkey").alias("node"))
    return graph.subgraph(star.bought_graph(spark, d), ids).select("src", "dst", F.round("weight", 9).alias("weight"))


@query(f"WITH {sql.GRAPH} SELECT src, dst, round(weight / sum(weight) OVER (PARTITION BY src), 9) AS p FROM adj")
def transition_rows(spark: SparkSession, d: str) -> DataFrame:
    return graph.transition(star.bought_adjacency(spark, d)).select("src", "dst", F.round("p", 9).alias("p"))


@query(
    f"""WITH {sql.GRAPH}, chosen AS (SELECT dst AS node FROM adj WHERE src = '1' ORDER BY weight DESC, dst LIMIT 40),
    own AS (SELECT DISTINCT src, dst FROM adj WHERE weight <> 0 AND src IN (SELECT node FROM chosen)), sizes AS (SELECT src, count(*) AS n FROM own GROUP BY 1),
    both_ AS (SELECT x.src AS a, y.src AS b, count(*) AS n FROM own x JOIN own y ON x.dst = y.dst AND x.src < y.src GROUP BY 1, 2)
    SELECT a, b, round(CAST(both_.n AS DOUBLE) / (p.n + q.n - both_.n), 9) AS jaccard FROM both_ JOIN sizes p ON a = p.src JOIN sizes q ON b = q.src"""
)
def jaccard_neighbourhoods(spark: SparkSession, d: str) -> DataFrame:
    fused = cut(star.bought_graph(spark, d))
    chosen = graph.neighbours(fused, "1", 40).select(F.col("neighbour").alias("node"))
    return graph.jaccard_neighbourhoods(graph.adjacency(fused), chosen).select("a", "b", F.round("jaccard", 9).alias("jaccard"))


# -- identity --------------------------------------------------------------------------------------


@query(
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(trunc(value) AS BIGINT) AS whole,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'x' || event_id END AS tag, CAST(NULL AS BIGINT) AS none FROM events"""
)
def coerce_dirty(spark: SparkSession, d: str) -> DataFrame:
    rows = star.table(spark, d, "events")
    tag = F.when(F.col("event_id") % 3 == 0, F.lit(" \t ")).otherwise(F.concat(F.lit(" x"), F.col("event_id").cast("string"), F.lit("\n")))
    return rows.select(
        "event_id", clean.long_or_null(F.get_json_object("props", "$.k")).alias("k"), clean.long_or_null(F.format_string("%.6f", "value")).alias("whole"),
        clean.text_or_null(tag).alias("tag"), clean.long_or_null(F.lit("n/a")).alias("none"),
    )


ALIASES = """aliased AS (
    SELECT 'goodreads_id' AS id_type, CAST(p_partkey AS VARCHAR) AS id_value, 'w' || p_name AS work_id FROM part
    UNION ALL SELECT 'asin', 'B' || p_partkey, 'w' || p_name FROM part WHERE p_partkey % 2 = 0),
aliases AS (SELECT id_type, id_value, min(work_id) AS work_id FROM aliased GROUP BY 1, 2)"""


def editions(spark: SparkSession, d: str) -> DataFrame:
    """Parts as editions of the work that has their name."""
    asin = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("B"), star.key("p_partkey"))).otherwise(F.lit(" "))
    rows = star.table(spark, d, "part").join(star.books(spark, d).select(F.col("work_id").alias("id"), "ratings_count"), star.key("p_partkey") == F.col("id"))
    return dumps.as_books(rows.select(F.concat(F.lit("w"), "p_name").alias("work_id"), F.col("p_name").alias("title"), star.key("p_partkey").alias("goodreads_id"), asin.alias("asin"), "ratings_count", F.array("p_brand").alias("authors")))


@query(f"WITH {ALIASES} SELECT * FROM aliases")
def aliases_unpivot(spark: SparkSession, d: str) -> DataFrame:
    return store.aliases_of(editions(spark, d))


@query(
    f"WITH {sql.BOOKS} SELECT work_id, edition, ratings_count FROM (SELECT 'w' || title AS work_id, books.work_id AS edition, ratings_count, "
    "row_number() OVER (PARTITION BY title ORDER BY ratings_count DESC NULLS LAST, books.work_id) AS n FROM books) WHERE n = 1"
)
def editions_collapse(spark: SparkSession, d: str) -> DataFrame:
    return dumps.most_rated(editions(spark, d)).select("work_id", F.col("goodreads_id").alias("edition"), "ratings_count")


def namespaced(spark: SparkSession, d: str) -> DataFrame:
    """Co-purchases by reference; targets that end in 7 point beyond what is known."""
    target = F.when(F.endswith("dst", F.lit("7")), F.concat(F.lit("x"), "dst")).otherwise(F.col("dst"))
    source = F.lit("goodreads_ucsd")
    return star.also_bought(spark, d).select(F.concat_ws(":", source, "src").alias("src"), F.concat_ws(":", source, target).alias("dst"), "kind", "rank", source.alias("source"))


REFS = f"""{sql.BOUGHT}, {ALIASES},
named AS (SELECT 'goodreads_ucsd:' || src AS src, 'goodreads_ucsd:' || CASE WHEN dst LIKE '%7' THEN 'x' || dst ELSE dst END AS dst, kind, rank, 'goodreads_ucsd' AS source FROM bought),
ends AS (SELECT src AS ref FROM named UNION SELECT dst FROM named),
refs AS (SELECT ref, work_id FROM ends LEFT JOIN aliases ON id_type = 'goodreads_id' AND id_value = substr(ref, 16)),
moved AS (SELECT a.work_id AS src, b.work_id AS dst, kind, rank, source FROM named JOIN refs a ON src = a.ref JOIN refs b ON dst = b.ref)"""


@query(f"WITH {REFS} SELECT ref, work_id FROM refs")
def ref_map(spark: SparkSession, d: str) -> DataFrame:
    books = editions(spark, d)
    return refs.ref_map(namespaced(spark, d), store.aliases_of(books), books.select("work_id").distinct())


@query(f"WITH {REFS} SELECT src, dst, kind, min(rank) AS rank, source FROM moved WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst GROUP BY src, dst, kind, source")
def resolve_refs(spark: SparkSession, d: str) -> DataFrame:
    books = editions(spark, d)
    return long_rank(refs.resolve_refs(namespaced(spark, d), store.aliases_of(books), books.select("work_id").distinct())[0])


@query(f"WITH {REFS} SELECT count(*) AS dropped FROM moved WHERE src IS NULL OR dst IS NULL")
def resolve_refs_dropped(spark: SparkSession, d: str) -> DataFrame:
    books = editions(spark, d)
    return refs.resolve_refs(namespaced(spark, d), store.aliases_of(books), books.select("work_id").distinct())[1]


FOLD = r"trim(regexp_replace(regexp_replace({}, '[''’ʼ]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
TITLE_SQL = rf"""WITH lines AS (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS line FROM documents),
folded AS (SELECT doc_id, regexp_replace(strip_accents(lower(line)), '[(\[][^)\]]*[)\]]?', ' ', 'g') AS t FROM lines),
headed AS (SELECT doc_id, t, regexp_extract(t, '^(.*?)\s*(?::|\s[-–—]\s|--)', 1) AS head, regexp_matches(t, '\s*(?::|\s[-–—]\s|--)') AS has FROM folded),
chosen AS (SELECT doc_id, CASE WHEN has AND trim(head) <> '' THEN head ELSE t END AS t FROM headed),
cleaned AS (SELECT doc_id, {FOLD.format('t')} AS k FROM chosen)
SELECT doc_id, trim(regexp_replace(k, '^(a|an|the)( |$)', '')) AS key FROM cleaned"""


@query(TITLE_SQL)
def normalize_title(spark: SparkSession, d: str) -> DataFrame:
    line = F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1))
    return star.table(spark, d, "documents").select("doc_id", identity.normalize_title(line).alias("key"))


@query(
    """SELECT c_custkey, trim(regexp_replace(lower(split_part(c_name, '#', 2)) || ' ' || lower(split_part(c_name, '#', 1)), '[^a-z0-9]+', ' ', 'g')) AS key FROM customer"""
)
def normalize_author(spark: SparkSession, d: str) -> DataFrame:
    """Customer names turned round as "Last, First" are turned back."""
    name = F.regexp_replace("c_name", "#", ", ")
    return star.table(spark, d, "customer").select("c_custkey", identity.normalize_author(name).alias("key"))


ISBN_SQL = """WITH d AS (SELECT p_partkey, lpad(CAST(p_partkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS body FROM part),
s AS (SELECT *, (SELECT sum(CAST(substr(body, i, 1) AS INTEGER) * (11 - i)) FROM range(1, 10) t(i)) AS t10 FROM d),
c AS (SELECT *, CAST((11 - t10 % 11) % 11 AS INTEGER) AS c10, '978' || body AS f12 FROM s),
e AS (SELECT *, (SELECT sum(CAST(substr(f12, i, 1) AS INTEGER) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END) FROM range(1, 13) t(i)) AS t13 FROM c)
SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 OR body = '000000000' THEN NULL ELSE f12 || CAST((10 - t13 % 10) % 10 AS INTEGER) END AS isbn13 FROM e"""


@query(ISBN_SQL)
def isbn_canonical(spark: SparkSession, d: str) -> DataFrame:
    """ISBN-10 made from part keys, hyphenated; every fourth has a wrong check digit."""
    body = F.lpad((F.col("p_partkey") * 7919 % 1_000_000_000).cast("string"), 9, "0")
    total = sum((F.substring(body, i, 1).cast("int") * (11 - i) for i in range(2, 10)), F.substring(body, 1, 1).cast("int") * 10)
    check = (F.pmod(-total, F.lit(11)) + F.when(F.col("p_partkey") % 4 == 3, 1).otherwise(0)) % 11
    digit = F.when(check == 10, F.lit("X")).otherwise(check.cast("string"))
    isbn = F.concat(F.substring(body, 1, 1), F.lit("-"), F.substring(body, 2, 4), F.lit(" "), F.substring(body, 6, 4), F.lit("-"), digit)
    return star.table(spark, d, "part").select("p_partkey", identity.canonical_isbn(isbn).alias("isbn13"))


@query(
    """SELECT p_partkey, length(code) = 10 AND NOT regexp_matches(code, '^[0-9]{9}[0-9X]$') AS is_asin
    FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN lpad(CAST(p_partkey AS VARCHAR), 10, '0') WHEN 1 THEN 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') ELSE 'B' || p_partkey END AS code FROM part)"""
)
def asin_shape(spark: SparkSession, d: str) -> DataFrame:
    number = star.key("p_partkey")
    code = F.when(F.col("p_partkey") % 3 == 0, F.lpad(number, 10, "0")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" b"), F.lpad(number, 9, "0"))).otherwise(F.concat(F.lit("B"), number))
    return star.table(spark, d, "part").select("p_partkey", identity.looks_like_asin(code).alias("is_asin"))


@query(
    f"WITH {sql.BOOKS} SELECT work_id, title, ratings_count FROM books WHERE contains(lower(title), 'red') "
    "ORDER BY starts_with(lower(title), 'red') DESC, ratings_count DESC NULLS LAST, length(title), work_id LIMIT 50"
)
def search_titles(spark: SparkSession, d: str) -> DataFrame:
    return store.search_titles(star.books(spark, d).withColumn("title_norm", F.lower("title")), "Red", 50).select("work_id", "title", "ratings_count")


@query(f"WITH {sql.BOOKS} SELECT work_id FROM books WHERE author NOT IN (SELECT author FROM books WHERE work_id IN ('1', '2'))")
def exclude_same_author(spark: SparkSession, d: str) -> DataFrame:
    books = star.books(spark, d)
    return rank.without_shared_authors(books.select(F.col("work_id").alias("node")), books, SEEDS).select(F.col("node").alias("work_id"))


# -- paths -----------------------------------------------------------------------------------------


@query(
    f"""WITH RECURSIVE {sql.GRAPH}, aims(target) AS (VALUES ('10'), ('20'), ('30')),
    hop(k, target, node, cost) AS (
        SELECT 0, target, target, 0.0::DOUBLE FROM aims
        UNION ALL SELECT k + 1, target, dst, min(cost - ln(weight)) FROM hop JOIN adj ON node = src WHERE k < 4 GROUP BY k, target, dst),
    best AS (SELECT target, node, min(cost) AS cost FROM hop WHERE k > 0 GROUP BY 1, 2)
    SELECT target, node AS seed_id, round(exp(-cost), 9) AS strength FROM best WHERE node IN ('1', '2') AND node <> target"""
)
def explain_paths_4hop(spark: SparkSession, d: str) -> DataFrame:
    targets = spark.createDataFrame([("10",), ("20",), ("30",)], "target string")
    return paths.explain_paths(star.bought_adjacency(spark, d), targets, SEEDS).select("target", "seed_id", F.round("strength", 9).alias("strength"))


@query(
    f"""WITH RECURSIVE {sql.GRAPH}, aims(target) AS (VALUES ('10'), ('20'), ('30')),
    hop(k, target, node, cost) AS (
        SELECT 0, target, target, 0.0::DOUBLE FROM aims
        UNION ALL SELECT k + 1, target, dst, min(cost - ln(weight)) FROM hop JOIN adj ON node = src WHERE k < 4 GROUP BY k, target, dst),
    best AS (SELECT target, node, min(cost) AS cost FROM hop WHERE k > 0 AND node IN ('1', '2', '3', '4', '5', '6') AND node <> target GROUP BY 1, 2)
    SELECT target, node AS seed_id, round(exp(-cost), 9) AS strength, row_number() OVER (PARTITION BY target ORDER BY round(exp(-cost), 12) DESC, node) AS place FROM best
    QUALIFY place <= 3"""
)
def explain_top3_of_6(spark: SparkSession, d: str) -> DataFrame:
    """The strongest three of six seeds, with their places."""
    targets = spark.createDataFrame([("10",), ("20",), ("30",)], "target string")
    found = paths.explain_paths(star.bought_adjacency(spark, d), targets, ["1", "2", "3", "4", "5", "6"])
    return found.select("target", "seed_id", F.round("strength", 9).alias("strength"), F.col("place").cast("long").alias("place"))


ROUNDS = 9


def terminal_costs(spark: SparkSession, d: str, floor: float = 0.0) -> DataFrame:
    return paths.costs(star.bought_adjacency(spark, d), floor)


@query(f"WITH RECURSIVE {sql.closure(TERMINALS, ROUNDS)} SELECT source, node AS target, round(cost, 8) AS cost FROM best WHERE node IN (SELECT t FROM terminals) AND node <> source")
def metric_closure(spark: SparkSession, d: str) -> DataFrame:
    return paths.closure(terminal_costs(spark, d), TERMINALS).select("source", "target", F.round("cost", 8).alias("cost"))


@query(
    f"WITH RECURSIVE {sql.closure(TERMINALS, ROUNDS, 0.15)} SELECT a.t AS source, b.t AS target, round(coalesce(cost, 'inf'::DOUBLE), 8) AS cost "
    "FROM terminals a JOIN terminals b ON a.t <> b.t LEFT JOIN best ON source = a.t AND node = b.t"
)
def weight_floor_closure(spark: SparkSession, d: str) -> DataFrame:
    return paths.closure(terminal_costs(spark, d, 0.15), TERMINALS).select("source", "target", F.round("cost", 8).alias("cost"))


@query()
def hop_capped_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose cheapest path has more than one hop, refused by a cap of one."""
    found = paths.closure(terminal_costs(spark, d), TERMINALS).where("path is not null and source < target")
    return found.withColumn("hops", F.size("path") - 1).where("hops > 1").select("source", "target", "hops")


@query(
    f"""WITH RECURSIVE {sql.GRAPH}, wide(k, source, node, width) AS (
        SELECT 0, t, t, 'inf'::DOUBLE FROM (VALUES ('1'), ('2'), ('3')) x(t)
        UNION ALL SELECT k + 1, source, node, max(w) FROM (
            SELECT k, source, node, width AS w FROM wide WHERE k < 14 UNION ALL SELECT k, source, dst, least(width, weight) FROM wide JOIN adj ON node = src WHERE k < 14)
        GROUP BY k, source, node)
    SELECT source, node AS target, round(width, 9) AS width FROM wide WHERE k = 14 AND node IN ('1', '2', '3') AND node <> source"""
)
def widest_bottleneck(spark: SparkSession, d: str) -> DataFrame:
    found = paths.widest(terminal_costs(spark, d), TERMINALS).where(F.col("node").isin(*TERMINALS) & (F.col("node") != F.col("source")))
    return found.select("source", F.col("node").alias("target"), F.round("width", 9).alias("width"))


@query(
    f"""WITH RECURSIVE {sql.GRAPH}, strong AS (SELECT src, dst FROM adj WHERE weight >= 0.18),
    near(k, node, low) AS (
        SELECT 0, src, src FROM (SELECT DISTINCT src FROM strong)
        UNION ALL SELECT k + 1, node, min(x) FROM (
            SELECT k, node, low AS x FROM near WHERE k < 40 UNION ALL SELECT k, dst, low FROM near JOIN strong ON node = src WHERE k < 40) GROUP BY k, node)
    SELECT node, low AS component FROM near WHERE k = 40"""
)
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return paths.components(star.bought_graph(spark, d).where("weight >= 0.18"))


@query()
def steiner_skeleton(spark: SparkSession, d: str) -> DataFrame:
    found = connect.connect(cut(star.bought_adjacency(spark, d)), TERMINALS)
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in found.edges], "src string, dst string, weight double")


# -- ranking ---------------------------------------------------------------------------------------


@query()
def mmr_rerank(spark: SparkSession, d: str) -> DataFrame:
    adj, ppr = walked(spark, d)
    top = walk.candidates(walk.damped_scores(adj, ppr), SEEDS, walk.candidate_depth(10))
    return spark.createDataFrame([(i, w, v) for i, (w, v) in enumerate(rank.mmr_rerank(adj, top, 10))], "place int, work_id string, value double")


@query()
def recommend_explained(spark: SparkSession, d: str) -> DataFrame:
    adj = cut(star.bought_adjacency(spark, d))
    rows = cut(rank.recommend_ids(adj, SEEDS, 5, RecommendConfig(ppr_tol=1e-6)))
    told = paths.explain_paths(adj, rows.select(F.col("work_id").alias("target")), SEEDS).withColumnRenamed("place", "nth")
    return rows.join(told, F.col("work_id") == F.col("target")).select("place", "work_id", "score", "seed_id", "strength", "hops", F.array_join("path", " ").alias("path"))


@query()
def resolve_seed_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    books = store.with_title_norm(star.books(spark, d))
    first = books.orderBy("work_id").select("title").first()["title"]
    matches, _ = seeds.resolve_seeds([first, first[:-1]], books)
    return spark.createDataFrame([(m.query, m.work_id, m.title, float(m.confidence)) for m in matches], "query string, work_id string, title string, confidence double")


# -- communities -----------------------------------------------------------------------------------

LABELS = "labels AS (SELECT CAST(p_partkey AS VARCHAR) AS node, dense_rank() OVER (ORDER BY p_brand) - 1 AS c FROM part)"


@query(
    f"""WITH {sql.GRAPH}, {LABELS}, named AS (SELECT a.c AS c, b.c AS d, weight FROM adj JOIN labels a ON src = a.node JOIN labels b ON dst = b.node),
    parts AS (SELECT c, sum(CASE WHEN c = d THEN weight ELSE 0 END) AS inside, sum(weight) AS held FROM named GROUP BY 1)
    SELECT round(sum(inside / t - pow(held / t, 2)), 9) AS modularity FROM parts, (SELECT sum(held) AS t FROM parts)"""
)
def modularity_given_labels(spark: SparkSession, d: str) -> DataFrame:
    found = community.modularity(star.bought_adjacency(spark, d), star.brand_labels(spark, d))
    return found.select(F.round("modularity", 9).alias("modularity"))


@query(
    f"""WITH {sql.BOOKS}, m AS (SELECT dense_rank() OVER (ORDER BY p_brand) - 1 AS c, title FROM books),
    terms AS (SELECT c, unnest(regexp_extract_all(lower(title), '[a-z0-9'']+')) AS term FROM m),
    kept AS (SELECT * FROM terms WHERE length(term) > 1 AND term NOT IN ({", ".join("'" + w.replace("'", "''") + "'" for w in community.STOPWORDS)})),
    tf AS (SELECT c, term, count(*) AS tf FROM kept GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(DISTINCT c) AS n FROM m),
    scored AS (SELECT c, term, tf, df >= n AS common, CASE WHEN df >= n THEN tf ELSE tf * ln(n::DOUBLE / df) END AS score FROM tf JOIN df USING (term), n),
    usable AS (SELECT *, min(common::INT) OVER (PARTITION BY c) AS only_common FROM scored),
    placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY round(score, 12) DESC, term) AS place FROM usable WHERE NOT common OR only_common = 1)
    SELECT c AS community, string_agg(term, ' / ' ORDER BY place) AS label FROM placed WHERE place <= 3 GROUP BY 1"""
)
def community_labels_tfidf(spark: SparkSession, d: str) -> DataFrame:
    members = star.books(spark, d).join(star.brand_labels(spark, d).withColumnRenamed("node", "work_id"), "work_id")
    found = community.label_communities(members.select("community", "title", F.array().cast("array<string>").alias("subjects")))
    return found.select(F.col("community").cast("long").alias("community"), "label")


SIZES = "sizes AS (SELECT p_name, count(*) AS n, min(CAST(p_partkey AS VARCHAR)) AS low FROM part GROUP BY 1), ids AS (SELECT p_name, row_number() OVER (ORDER BY n DESC, low) - 1 AS community FROM sizes)"


@query(f"WITH {SIZES} SELECT CAST(p_partkey AS VARCHAR) AS node, community FROM part JOIN ids USING (p_name)")
def renumber_by_size(spark: SparkSession, d: str) -> DataFrame:
    named = star.table(spark, d, "part").select(star.key("p_partkey").alias("node"), F.col("p_name").alias("community"))
    return community.renumbered(named).select("node", F.col("community").cast("long").alias("community"))


@query(f"WITH {SIZES} SELECT community, count(*) AS size FROM part JOIN ids USING (p_name) GROUP BY 1 ORDER BY size DESC, community LIMIT 10")
def largest_communities(spark: SparkSession, d: str) -> DataFrame:
    named = star.table(spark, d, "part").select(star.key("p_partkey").alias("node"), F.col("p_name").alias("community"))
    sizes = community.community_sizes(community.renumbered(named))
    return sizes.orderBy(F.desc("size"), "community").limit(10).select(F.col("community").cast("long").alias("community"), "size")


BRIDGES = f"""{sql.GRAPH}, {LABELS}, named AS (SELECT src AS node, a.c AS c, b.c AS d, weight FROM adj JOIN labels a ON src = a.node JOIN labels b ON dst = b.node),
scored AS (SELECT node, sum(CASE WHEN c <> d THEN weight ELSE 0 END) / sum(weight) * len(list_distinct(list_concat(list(c), list(d)))) AS score,
    list_distinct(list_concat(list(c), list(d))) AS touched FROM named GROUP BY 1)"""


@query(f"WITH {BRIDGES} SELECT node, round(score, 9) AS score, CAST(len(touched) AS BIGINT) AS n_communities FROM scored WHERE score > 0")
def bridge_scores(spark: SparkSession, d: str) -> DataFrame:
    found = community.bridge_scores(star.bought_adjacency(spark, d), star.brand_labels(spark, d))
    return found.select("node", F.round("score", 9).alias("score"), F.size("communities").cast("long").alias("n_communities"))


@query(f"WITH {BRIDGES} SELECT node, round(score, 9) AS score FROM scored WHERE score > 0 AND len(touched) >= 2 AND list_contains(touched, 3) ORDER BY scored.score DESC, node LIMIT 20")
def bridges_for_seeds(spark: SparkSession, d: str) -> DataFrame:
    return community.bridges(star.bought_adjacency(spark, d), star.brand_labels(spark, d), 20, [3]).select("node", F.round("score", 9).alias("score"))


@query()
def detect_communities(spark: SparkSession, d: str) -> DataFrame:
    return community.detect_communities(star.bought_graph(spark, d))


# -- centrality ------------------------------------------------------------------------------------


@query()
def betweenness_sampled(spark: SparkSession, d: str) -> DataFrame:
    return centrality.betweenness(star.bought_adjacency(spark, d), k_samples=8)


# -- store -----------------------------------------------------------------------------------------


@query(
    f"""WITH {sql.BOUGHT}, again AS (SELECT src, dst, kind, 1 AS rank, source FROM bought WHERE rank > 40)
    SELECT src, dst, kind, CASE WHEN rank > 40 THEN 1 ELSE rank END AS rank, source FROM bought"""
)
def keyed_upsert_idempotent(spark: SparkSession, d: str) -> DataFrame:
    """The tail of each list is upserted with rank 1, twice."""
    edges = cut(long_rank(star.also_bought(spark, d)))
    new = edges.where("rank > 40").withColumn("rank", F.lit(1).cast("long"))
    keys = ["src", "dst", "kind", "source"]
    return store.upserted(store.upserted(edges, new, keys), new, keys)


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in ("part", "orders", "lineitem", "events", "documents")))
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    return store.table_counts({t: star.table(spark, d, t) for t in ("part", "orders", "lineitem", "events", "documents")})


@query("SELECT event_type AS source, CAST(user_id AS VARCHAR) AS artifact, count(*) AS rows_done, max(event_id) AS last_id FROM events GROUP BY 1, 2")
def ingest_state(spark: SparkSession, d: str) -> DataFrame:
    """Progress per source and artifact, kept by upserts of each half of the events."""
    rows = star.table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("artifact"), "event_id")
    keys = ["source", "artifact"]
    state = None
    for part in (rows.where("event_id % 2 = 0"), rows):
        new = part.groupBy(*keys).agg(F.count("*").alias("rows_done"), F.max("event_id").alias("last_id"))
        state = new if state is None else store.upserted(state, new, keys)
    return state


@query(f"WITH {sql.BOOKS} SELECT work_id, ratings_count FROM books ORDER BY ratings_count DESC NULLS LAST, work_id LIMIT 100")
def enrichment_queue(spark: SparkSession, d: str) -> DataFrame:
    """Works with gaps to enrich first: most rated, unknown counts last."""
    wanted = star.books(spark, d).where("year is null or size(subjects) = 0")
    return wanted.orderBy(F.desc_nulls_last("ratings_count"), "work_id").limit(100).select("work_id", "ratings_count")


# -- streaming and layout --------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows over the events as a stream, run until the input is used up.

    The watermark spans the data, as its rows are in no order of time."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    counted = ingest.windowed_counts(ingest.read_events(spark, f"{d}/events.parquet*"), lateness="3650 days")
    out = f"{root}/out"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    counted.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("window_start", "event_type", "n", F.round("total", 6).alias("total"))


@query()
def layout_normalized(spark: SparkSession, d: str) -> DataFrame:
    fused = cut(star.bought_graph(spark, d))
    near = [r["neighbour"] for r in graph.neighbours(fused, "1", 40).collect()]
    found = layout.layout(fused, ["1", *near])
    return spark.createDataFrame([(i, x, y) for i, (x, y) in found.items()], "node string, x double, y double")


QUERIES.update(readers.QUERIES)
ORACLES.update(readers.ORACLES)
