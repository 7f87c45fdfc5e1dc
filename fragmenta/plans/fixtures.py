"""Deterministic projections of the driver's tables, valid in Spark SQL and DuckDB alike.

``view_sql`` gives the text for either engine; ``view`` gives the DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

READS = """SELECT CAST(l_orderkey AS BIGINT) AS qname, CAST(l_linenumber AS INT) AS mate,
 CASE l_returnflag WHEN 'N' THEN 'n001' WHEN 'A' THEN 't001' ELSE 't002' END AS sample,
 CAST(l_suppkey AS BIGINT) AS rg,
 CAST(l_suppkey % 24 AS INT) AS chr,
 CAST((l_partkey * 7919 + l_orderkey * 31) % 1000000 AS BIGINT) AS pos,
 CAST(l_partkey % 24 AS INT) AS mate_chr,
 CAST((l_orderkey * 104729 + l_suppkey * 13) % 1000000 AS BIGINT) AS mate_pos,
 CASE l_linestatus WHEN 'F' THEN '+' ELSE '-' END AS strand,
 CASE WHEN l_partkey % 2 = 0 THEN '-' ELSE '+' END AS mate_strand,
 CAST(floor(l_quantity) AS INT) AS mapq,
 CAST(floor(l_extendedprice / 100) AS BIGINT) AS isize,
 CAST(floor(l_discount * 100 + 0.5) AS INT) AS nm,
 CAST(floor(l_tax * 100 + 0.5) AS INT) AS clip,
 CAST(151 AS INT) AS readlen FROM lineitem"""

BPS = """SELECT CAST(o_orderkey AS BIGINT) AS bp_num,
 CAST(o_custkey % 30 AS INT) AS chr1, CAST((o_custkey * 17) % 500 AS BIGINT) AS pos1,
 CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand1,
 CAST((o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) % 30 AS INT) AS chr2,
 CAST((o_custkey * 17 + (o_orderkey % 7) * 40) % 500 AS BIGINT) AS pos2,
 CASE WHEN o_orderkey % 3 = 0 THEN '+' ELSE '-' END AS strand2,
 CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'LOWMAPQ' ELSE 'LOWLOD' END AS conf,
 CAST(floor(o_totalprice) AS BIGINT) % 50 - 10 AS somlod,
 CAST(floor(o_totalprice / 7) AS BIGINT) % 60 AS maxlod FROM orders"""

REGIONS = """SELECT CAST(p_partkey AS BIGINT) AS region_id, CAST(p_partkey % 24 AS INT) AS chr,
 CAST((p_partkey * 6151) % 1000000 AS BIGINT) AS start_pos,
 CAST((p_partkey * 6151) % 1000000 + p_size * 20 AS BIGINT) AS end_pos, p_brand AS label FROM part"""

BP_COUNTS = """SELECT CAST(l_partkey AS BIGINT) AS bp_num,
 CAST(sum(CASE WHEN l_returnflag = 'N' AND l_discount >= 0.095 THEN 1 ELSE 0 END) AS INT) AS alt_n,
 CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS INT) AS cov_n,
 CAST(sum(CASE WHEN l_returnflag <> 'N' AND l_discount >= 0.075 THEN 1 ELSE 0 END) AS INT) AS alt_t,
 CAST(sum(CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END) AS INT) AS cov_t,
 CAST(l_partkey % 13 AS INT) AS repeat_len FROM lineitem GROUP BY l_partkey"""

PAIRS = """SELECT CAST(conv_id AS BIGINT) AS qname, CAST(turn AS INT) AS mate, role,
 translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS seq FROM conversations"""

#: Name of each projection, its text, and the table it reads.
PROJECTIONS = {"v_reads": (READS, "lineitem"), "v_bps": (BPS, "orders"), "v_regions": (REGIONS, "part"), "v_bp_counts": (BP_COUNTS, "lineitem"), "v_pairs": (PAIRS, "conversations")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, source = PROJECTIONS[name]
    return spark.sql(text.replace(f"FROM {source}", "FROM {src}"), src=table(spark, sf_dir, source))


def with_views(body: str) -> str:
    """DuckDB text: the projections that ``body`` names, as common table expressions before it."""
    used = [k for k in PROJECTIONS if k in body]
    head = ", ".join(f"{k} AS ({PROJECTIONS[k][0]})" for k in used)
    body = body.strip()
    if not used:
        return body
    if body[:5].upper() == "WITH ":
        recursive = body[5:15].upper() == "RECURSIVE "
        return f"WITH {'RECURSIVE ' if recursive else ''}{head}, {body[15 if recursive else 5:]}"
    return f"WITH {head} {body}"
