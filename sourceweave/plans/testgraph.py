"""A graph of the relational test tables: records are nodes, keys are links.

Every node has an id, a label, the table-like "file" it is in, an order (seq) and a community; every file is a hub node
that contains its nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CODE, CONCEPT = "code", "concept"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str | Column) -> Column:
    return F.concat(F.lit(f"{kind}_"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def _rows(df: DataFrame, kind: int, name: str, key: str, label: Column, file: Column, community: Column, file_type: str = CODE) -> DataFrame:
    seq = F.lit(kind * 10**12) + F.col(key).cast("long")
    return df.select(seq.alias("seq"), _id(name, key).alias("id"), label.alias("label"), F.lit(file_type).alias("file_type"), file.alias("source_file"), community.cast("int").alias("community"))


def _file(kind: str, key: str) -> Column:
    return F.concat(_id(kind, key), F.lit(".tbl"))


def record_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: _table(spark, sf_dir, name)
    parts = [
        _rows(t("region"), 0, "region", "r_regionkey", F.col("r_name"), F.lit(""), F.col("r_regionkey"), CONCEPT),
        _rows(t("nation"), 1, "nation", "n_nationkey", F.col("n_name"), _file("region", "n_regionkey"), F.col("n_nationkey")),
        _rows(t("customer"), 2, "customer", "c_custkey", F.col("c_name"), _file("nation", "c_nationkey"), F.col("c_nationkey")),
        _rows(t("supplier"), 3, "supplier", "s_suppkey", F.col("s_name"), _file("nation", "s_nationkey"), F.col("s_nationkey")),
        _rows(t("part"), 4, "part", "p_partkey", F.concat("p_name", F.lit("()")), F.concat("p_brand", F.lit(".tbl")), F.col("p_partkey") % 25),
        _rows(t("orders"), 5, "order", "o_orderkey", _id("order", "o_orderkey"), _file("customer", "o_custkey"), F.col("o_custkey") % 25),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, id, label, file_type, source_file, community, norm_label."""
    own = record_nodes(spark, sf_dir)
    files = own.where("source_file <> ''").select("source_file").distinct()
    kind = F.when(F.col("source_file").startswith("region"), 0).when(F.col("source_file").startswith("nation"), 1).when(F.col("source_file").startswith("customer"), 2).otherwise(3)
    number = F.regexp_extract("source_file", "([0-9]+)", 1).cast("long")
    hubs = files.select(
        (F.lit(7 * 10**12) + kind * F.lit(10**10) + number).alias("seq"), F.concat(F.lit("file_"), "source_file").alias("id"), F.col("source_file").alias("label"), F.lit(CODE).alias("file_type"), "source_file", F.lit(None).cast("int").alias("community")
    )
    return own.unionByName(hubs).withColumn("norm_label", F.lower("label"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, relation, confidence."""
    t = lambda name: _table(spark, sf_dir, name)
    link = lambda df, s, d, relation, confidence: df.select(s.alias("source"), d.alias("target"), F.lit(relation).alias("relation"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence"))
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    supply = lines.groupBy("l_orderkey", "l_suppkey").agg(F.max(F.col("l_returnflag") == "R").alias("back"))
    parts = [
        link(t("nation"), _id("nation", "n_nationkey"), _id("region", "n_regionkey"), "references", "EXTRACTED"),
        link(t("customer"), _id("customer", "c_custkey"), _id("nation", "c_nationkey"), "references", "EXTRACTED"),
        link(t("supplier"), _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), "references", "EXTRACTED"),
        link(t("orders"), _id("order", "o_orderkey"), _id("customer", "o_custkey"), "depends_on", "EXTRACTED"),
        link(lines.select("l_orderkey", "l_partkey").distinct(), _id("order", "l_orderkey"), _id("part", "l_partkey"), "calls", "INFERRED"),
        link(supply, _id("order", "l_orderkey"), _id("supplier", "l_suppkey"), "imports", F.when(F.col("back"), "AMBIGUOUS").otherwise("EXTRACTED")),
        link(record_nodes(spark, sf_dir).where("source_file <> ''"), F.concat(F.lit("file_"), "source_file"), F.col("id"), "contains", "EXTRACTED"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).where("community IS NOT NULL").select("community", "id")


#: The same graph in SQL.
NODES_SQL = """
rec AS (
  SELECT CAST(r_regionkey AS BIGINT) AS seq, 'region_' || r_regionkey AS id, r_name AS label, 'concept' AS file_type, '' AS source_file, r_regionkey AS community FROM region
  UNION ALL SELECT 1000000000000 + n_nationkey, 'nation_' || n_nationkey, n_name, 'code', 'region_' || n_regionkey || '.tbl', n_nationkey FROM nation
  UNION ALL SELECT 2000000000000 + c_custkey, 'customer_' || c_custkey, c_name, 'code', 'nation_' || c_nationkey || '.tbl', c_nationkey FROM customer
  UNION ALL SELECT 3000000000000 + s_suppkey, 'supplier_' || s_suppkey, s_name, 'code', 'nation_' || s_nationkey || '.tbl', s_nationkey FROM supplier
  UNION ALL SELECT 4000000000000 + p_partkey, 'part_' || p_partkey, p_name || '()', 'code', p_brand || '.tbl', p_partkey % 25 FROM part
  UNION ALL SELECT 5000000000000 + o_orderkey, 'order_' || o_orderkey, 'order_' || o_orderkey, 'code', 'customer_' || o_custkey || '.tbl', o_custkey % 25 FROM orders
),
nodes AS (
  SELECT *, lower(label) AS norm_label FROM rec
  UNION ALL
  SELECT 7000000000000 + 10000000000 * (CASE WHEN source_file LIKE 'region%' THEN 0 WHEN source_file LIKE 'nation%' THEN 1 WHEN source_file LIKE 'customer%' THEN 2 ELSE 3 END)
         + CAST(regexp_extract(source_file, '([0-9]+)', 1) AS BIGINT), 'file_' || source_file, source_file, 'code', source_file, NULL, lower(source_file)
  FROM (SELECT DISTINCT source_file FROM rec WHERE source_file <> '')
)"""
EDGES_SQL = """
edges AS (
  SELECT 'nation_' || n_nationkey AS source, 'region_' || n_regionkey AS target, 'references' AS relation, 'EXTRACTED' AS confidence FROM nation
  UNION ALL SELECT 'customer_' || c_custkey, 'nation_' || c_nationkey, 'references', 'EXTRACTED' FROM customer
  UNION ALL SELECT 'supplier_' || s_suppkey, 'nation_' || s_nationkey, 'references', 'EXTRACTED' FROM supplier
  UNION ALL SELECT 'order_' || o_orderkey, 'customer_' || o_custkey, 'depends_on', 'EXTRACTED' FROM orders
  UNION ALL SELECT DISTINCT 'order_' || l_orderkey, 'part_' || l_partkey, 'calls', 'INFERRED' FROM lineitem
  UNION ALL SELECT 'order_' || l_orderkey, 'supplier_' || l_suppkey, 'imports', CASE WHEN bool_or(l_returnflag = 'R') THEN 'AMBIGUOUS' ELSE 'EXTRACTED' END FROM lineitem GROUP BY l_orderkey, l_suppkey
  UNION ALL SELECT 'file_' || source_file, id, 'contains', 'EXTRACTED' FROM rec WHERE source_file <> ''
),
adj AS (SELECT source AS id, target AS nbr FROM edges UNION SELECT target, source FROM edges),
deg AS (SELECT nodes.*, coalesce(d, 0) AS degree FROM nodes LEFT JOIN (SELECT id, count(*) AS d FROM adj GROUP BY id) USING (id)),
flag AS (SELECT *, regexp_replace(source_file, '^.*/', '') AS base,
  label <> '' AND ((source_file <> '' AND label = regexp_replace(source_file, '^.*/', '')) OR (label LIKE '.%' AND label LIKE '%()') OR (label LIKE '%()' AND degree <= 1)) AS hub,
  source_file = '' OR regexp_replace(source_file, '^.*/', '') NOT LIKE '%.%' AS concept FROM deg)"""
WITH = f"WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}"
