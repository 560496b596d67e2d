"""Finding and explaining symbols; comparing, merging and validating graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search(nodes: DataFrame, pattern: str) -> DataFrame:
    """Nodes whose label, id or search label match, case aside, by label and id."""
    p = "(?iu)" + pattern
    return nodes.where(F.col("label").rlike(p) | F.col("id").rlike(p) | F.col("norm_label").rlike(p)).orderBy("label", "id")


def loc(file: Column, location: Column) -> Column:
    line = F.ltrim(F.coalesce(location, F.lit("")), F.lit("L"))
    return F.when(line != "", F.concat(file, F.lit(":"), line)).otherwise(file)


def resolve_symbol(nodes: DataFrame, name: str) -> DataFrame:
    """The node meant by name, or no row: an exact id, else the first with that label, else the only one that has name within label or id."""
    low = name.lower()
    rank = F.when(F.col("id") == name, 0).when(F.lower("label") == low, 1).when(F.lower("label").contains(low) | F.lower("id").contains(low), 2)
    found = nodes.select(rank.alias("rank"), "seq", "id", "label").where("rank IS NOT NULL")
    best = found.groupBy("rank").agg(F.min_by(F.struct("id", "label"), "seq").alias("first"), F.count("*").alias("n")).orderBy("rank").limit(1)
    return best.where("rank < 2 OR n = 1").select("first.id", "first.label")


def explain(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """All links of a node: "->" out, "<-" in; a self-loop once, out."""
    out = edges.where(F.col("source") == node).select(F.lit("->").alias("dir"), "relation", F.col("target").alias("other"), "confidence")
    into = edges.where((F.col("target") == node) & (F.col("source") != node)).select(F.lit("<-").alias("dir"), "relation", F.col("source").alias("other"), "confidence")
    names = nodes.select(F.col("id").alias("other"), "label")
    return out.unionByName(into).join(names, "other", "left").select("dir", "relation", "other", F.coalesce("label", "other").alias("label"), "confidence").orderBy("relation", "label", "dir", "other")


def neighbours(nodes: DataFrame, edges: DataFrame, node: str, relation: str = "") -> DataFrame:
    """explain, with the relation holding a text, case aside."""
    return explain(nodes, edges, node).where(F.lower("relation").contains(relation.lower()))


def community(nodes: DataFrame, number: int) -> DataFrame:
    return nodes.where(F.col("community") == number).orderBy("id").select("id", "label", "source_file")


KEY = ["source", "target", "relation"]


def diff_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    name = F.coalesce(F.when(F.col("label") != "", F.col("label")), "id").alias("label")
    a = new.join(old, "id", "left_anti").select(F.lit("added").alias("change"), "id", name)
    return a.unionByName(old.join(new, "id", "left_anti").select(F.lit("removed").alias("change"), "id", name)).distinct()


def diff_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    a = new.select(KEY).distinct().join(old, KEY, "left_anti").withColumn("change", F.lit("added"))
    return a.unionByName(old.select(KEY).distinct().join(new, KEY, "left_anti").withColumn("change", F.lit("removed")))


def diff_summary(nodes: DataFrame, edges: DataFrame) -> str:
    n = {r.change: r["count"] for r in nodes.groupBy("change").count().collect()}
    e = {r.change: r["count"] for r in edges.groupBy("change").count().collect()}
    parts = [(n.get("added", 0), "new node", "s", ""), (e.get("added", 0), "new edge", "s", ""), (n.get("removed", 0), "node", "s", " removed"), (e.get("removed", 0), "edge", "s", " removed")]
    return ", ".join(f"{k} {word}{s if k != 1 else ''}{tail}" for k, word, s, tail in parts if k) or "no changes"


def merge(current: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both sides, one for each key: the current side's, and there the first by seq."""
    both = current.withColumn("side", F.lit(0)).unionByName(other.withColumn("side", F.lit(1)), allowMissingColumns=True)
    first = Window.partitionBy(*key).orderBy("side", "seq")
    return both.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "side")


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One message for each fault: empty and repeated ids, ends of links that no node has."""
    ids = nodes.select("id").where("id <> ''")
    empty = nodes.where("id = ''").select(F.lit("node has empty id").alias("issue"))
    twice = ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.concat(F.lit("duplicate node id: "), "id", F.lit(" ("), F.col("n").cast("string"), F.lit(" occurrences)")).alias("issue"))
    known = ids.distinct()
    link = F.concat(F.lit("edge "), "source", F.lit(" -> "), "target", F.lit(" ["), "relation", F.lit("]: "))
    lost = [edges.join(known.toDF(end), end, "left_anti").select(F.concat(link, F.lit(f"{end} missing")).alias("issue")) for end in ("source", "target")]
    return empty.unionByName(twice).unionByName(lost[0]).unionByName(lost[1]).orderBy("issue")
