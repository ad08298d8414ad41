"""SQL building blocks that DuckDB runs on the same tables, for the registered queries."""

from __future__ import annotations

ITEMS = "items AS (SELECT DISTINCT l_orderkey, CAST(l_partkey AS VARCHAR) AS item FROM lineitem)"
BOUGHT = ITEMS + """,
co AS (SELECT a.item AS src, b.item AS dst, count(*) AS n FROM items a JOIN items b USING (l_orderkey) WHERE a.item <> b.item GROUP BY 1, 2),
bought AS (SELECT * FROM (SELECT src, dst, 'az_also_bought' AS kind, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS rank, 'amazon_meta' AS source FROM co) WHERE rank <= 50)"""
VIEWED = """owned AS (SELECT DISTINCT o_custkey, l_orderkey, CAST(l_partkey AS VARCHAR) AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
seen AS (SELECT a.item AS src, b.item AS dst, count(*) AS n FROM owned a JOIN owned b USING (o_custkey) WHERE a.l_orderkey <> b.l_orderkey AND a.item <> b.item GROUP BY 1, 2),
viewed AS (SELECT * FROM (SELECT src, dst, 'az_also_viewed' AS kind, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS rank, 'amazon_reviews_2023' AS source FROM seen) WHERE rank <= 50)"""
PRICED = """priced AS (SELECT * FROM (
    SELECT CAST(a.p_partkey AS VARCHAR) AS src, CAST(b.p_partkey AS VARCHAR) AS dst, 'gr_similar' AS kind,
           row_number() OVER (PARTITION BY a.p_partkey ORDER BY abs(a.p_retailprice - b.p_retailprice), CAST(b.p_partkey AS VARCHAR)) AS rank, 'goodreads_ucsd' AS source
    FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey) WHERE rank <= 50)"""
SUBJECTS = """subs AS (
    SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS id, unnest([p_brand, p_type, 'size ' || p_size, p_brand || '|' || p_type, p_type || '|size ' || p_size, p_brand || '|size ' || p_size]) AS subject FROM part),
sized AS (SELECT subject FROM subs GROUP BY 1 HAVING count(*) BETWEEN 2 AND 200),
subject_pairs AS (
    SELECT a.id AS src, b.id AS dst, 'ol_subject' AS kind, CAST(1 AS BIGINT) AS rank, 'openlibrary' AS source
    FROM subs a JOIN subs b USING (subject) WHERE subject IN (SELECT subject FROM sized) AND a.id < b.id GROUP BY 1, 2 HAVING count(*) >= 2)"""


def fused(edges: str, max_rank: int = 50, min_weight: float = 0.05, name: str = "fused") -> str:
    """CTEs that fuse the rows of ``edges`` into ``name``."""
    return f"""{name}_one AS (
    SELECT src, dst, sum(CASE kind WHEN 'gr_similar' THEN 0.6::DOUBLE WHEN 'az_also_bought' THEN 0.3::DOUBLE WHEN 'az_also_viewed' THEN 0.1::DOUBLE ELSE 0.05::DOUBLE END / log2(2 + rank)) AS s,
           list(DISTINCT kind) AS ks
    FROM ({edges}) WHERE rank <= {max_rank} AND src <> dst GROUP BY 1, 2),
{name}_pair AS (
    SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(CASE WHEN src < dst THEN s ELSE 0 END) AS f, sum(CASE WHEN src < dst THEN 0 ELSE s END) AS r,
           list_sort(list_distinct(flatten(list(ks)))) AS kinds
    FROM {name}_one GROUP BY 1, 2),
{name} AS (
    SELECT a AS src, b AS dst, greatest(f, r) AS weight, 1 - least(f, r) / greatest(f, r) AS dir_asym, kinds
    FROM {name}_pair WHERE greatest(f, r) > 0 AND greatest(f, r) >= {min_weight})"""


ADJ = "adj AS (SELECT src, dst, weight FROM fused UNION ALL SELECT dst, src, weight FROM fused)"
GRAPH = f"{BOUGHT},\n{fused('SELECT * FROM bought')},\n{ADJ}"
#: Raw edges of all kinds.
EVERY = f"{BOUGHT},\n{VIEWED},\n{PRICED},\n{SUBJECTS},\nevery AS (SELECT * FROM bought UNION ALL SELECT * FROM viewed UNION ALL SELECT * FROM priced UNION ALL SELECT * FROM subject_pairs)"
FUSED_ROWS = "SELECT src, dst, round(weight, 9) AS weight, round(dir_asym, 9) AS dir_asym, array_to_string(kinds, ',') AS kinds FROM fused"
BOOKS = """books AS (
    SELECT CAST(p_partkey AS VARCHAR) AS work_id, p_name AS title, p_brand AS author, p_brand, p_type, p_size,
           CASE WHEN p_size <> 7 THEN coalesce(n, 0) END AS ratings_count
    FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey)"""


def walk(restart: str, steps: int) -> str:
    """CTEs up to ``ppr``: ``steps`` steps from the rows (node, r) of ``restart``."""
    return f"""{GRAPH},
moves AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM adj),
restart(node, r) AS ({restart}),
steps(k, node, ppr) AS (
    SELECT 0, node, r FROM restart
    UNION ALL
    SELECT k + 1, node, sum(x) FROM (
        SELECT k, dst AS node, ppr * p * (1 - 0.15::DOUBLE) AS x FROM steps JOIN moves ON node = src WHERE k < {steps}
        UNION ALL SELECT k, restart.node, r * 0.15::DOUBLE FROM (SELECT DISTINCT k FROM steps WHERE k < {steps}), restart)
    GROUP BY k, node),
ppr AS (SELECT node, ppr FROM steps WHERE k = {steps})"""


def closure(terminals: list[str], rounds: int, floor: float = 0.0) -> str:
    """CTEs up to ``best`` (source, node, cost): relaxation from the terminals, enough rounds to settle."""
    starts = ", ".join(f"('{t}')" for t in terminals)
    return f"""{GRAPH},
costs AS (SELECT src, dst, greatest(-ln(weight), 1e-12) AS cost FROM adj WHERE weight > greatest(0, {floor} - 1e-12)),
terminals(t) AS (VALUES {starts}),
relax(k, source, node, cost) AS (
    SELECT 0, t, t, 0.0::DOUBLE FROM terminals
    UNION ALL
    SELECT k + 1, source, node, min(x) FROM (
        SELECT k, source, node, cost AS x FROM relax WHERE k < {rounds}
        UNION ALL SELECT k, source, dst, relax.cost + costs.cost FROM relax JOIN costs ON node = src WHERE k < {rounds})
    GROUP BY k, source, node),
best AS (SELECT source, node, cost FROM relax WHERE k = {rounds})"""
