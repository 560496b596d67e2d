"""From a source tree to a graph: list, extract, resolve, assemble, cluster, write.

Extraction runs where the files' partitions are; resolving and assembling are joins. Every fragment carries the place it
was found at (phase, file, position), which decides wherever the first or the last of several counts.
"""

from __future__ import annotations

import json
import os
import subprocess
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..extract import manifests
from ..extract.dispatch import extract_files, fragment_frame, rows
from ..extract.terraform import complete_labels
from ..functions.ids import norm_label_of, normalize_id_of
from ..operators import cluster, graph, resolve
from ..operators.traverse import level
from ..schema import FRAGMENT, SCORES
from ..sources import listing

#: Bits of a fragment's place in its file, and with those of the file's number, in an order key of 63 bits.
PLACE_BITS, FILE_BITS = 28, 59


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    communities: DataFrame | None = None


def read_files(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """path, idx, content of files below root; executors read them, a few at a time."""
    names = spark.createDataFrame([(p, i) for i, p in enumerate(paths)] or [], "path string, idx int")
    base = os.path.abspath(root)
    if not paths:
        return names.withColumn("content", F.lit(b""))
    found = spark.read.format("binaryFile").load([f"file://{base}/{p}" for p in paths])
    path = F.expr(f"substring(path, length(path) - length(substring_index(path, '{base}/', -1)) + 1)")
    return found.select(path.alias("path"), "content").join(F.broadcast(names), "path")


def _ord(phase: int):
    return F.lit(phase << FILE_BITS) + F.col("file_idx").cast("long") * (1 << PLACE_BITS) + F.col("pos")


def fragments(spark: SparkSession, root: str, paths: list[str], with_manifests: bool = True, with_cargo: bool = False) -> DataFrame:
    found = extract_files(read_files(spark, root, paths))
    extra = []
    if with_cargo and os.path.isfile(os.path.join(root, "Cargo.toml")):
        extra += rows(manifests.cargo(root), len(paths))
    if with_manifests:
        texts = {}
        for p in listing.collect_manifests(root):
            with open(os.path.join(root, p), errors="replace") as f:
                texts[p] = f.read()
        extra += rows(manifests.packages(texts), len(paths) + 1)
    return found.unionByName(spark.createDataFrame(fragment_frame(extra), FRAGMENT)) if extra else found


def resolve_all(found: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all fragments, with those that need the whole corpus. found: FRAGMENT rows; files: path, idx."""
    kind = lambda k: found.where(F.col("kind") == k)
    x = lambda name: F.get_json_object("extra", f"$.{name}")
    defs = kind("def").select("id", "name", "file", _ord(0).alias("ord"))
    calls = kind("call").select(x("caller_id").alias("caller_id"), x("callee").alias("callee"), "file", "loc", "is_member", _ord(0).alias("ord"))
    imports = kind("import").select(x("file_id").alias("file_id"), "file", x("spec").alias("spec"), "loc", _ord(0).alias("ord"))
    aliases = kind("alias").select("file", x("local").alias("local"), x("imported").alias("imported"), x("module_stem").alias("module_stem"), _ord(0).alias("ord"))
    mod_refs = kind("mod_ref").select(x("from_id").alias("from_id"), "source", "file", "loc", _ord(0).alias("ord"))
    md_refs = kind("md_ref").select(x("from_id").alias("from_id"), "target", "file", "loc", _ord(0).alias("ord"))

    targets = resolve.relative_imports(imports, files)
    imported = targets.where("target IS NOT NULL").select("file", "target").distinct()
    guided = resolve.import_guided_calls(calls, defs, aliases)
    plain = resolve.resolve_calls(resolve.suppress(calls, guided), defs, imported)
    import_edges, import_nodes = resolve.import_links(imports, files)
    module_edges, module_nodes = resolve.module_links(mod_refs, files)
    docs = resolve.markdown_links(md_refs, files, defs)
    index = resolve.index_links(files)

    own = kind("node").select("id", "label", "file_type", "source_file", F.col("loc").alias("source_location"), "computed_name", _ord(0).alias("ord"))
    shift = lambda df, phase: df.withColumn("ord", F.col("ord") + F.lit(phase << FILE_BITS))
    nodes = own.unionByName(shift(import_nodes, 1), allowMissingColumns=True).unionByName(shift(module_nodes, 2), allowMissingColumns=True)
    edges = kind("edge").select("source", "target", "relation", "confidence", "source_file", F.col("loc").alias("source_location"), "weight", "confidence_score", _ord(0).alias("ord"))
    for phase, part in enumerate([guided.drop("callee"), plain, import_edges, module_edges, docs, index], 1):
        edges = edges.unionByName(shift(part, phase), allowMissingColumns=True)
    return _with_labels(nodes, edges, kind("label"), kind("invoke")), edges


def _with_labels(nodes: DataFrame, edges: DataFrame, labels: DataFrame, invokes: DataFrame) -> DataFrame:
    """Completes the names of label modules from the blocks that call their folders. Label modules alone come to the driver, with the module blocks: a few for each folder of infrastructure code."""
    own = [json.loads(r.extra) | {"id": r.id} for r in labels.select("id", "extra").collect()]
    if not own:
        return nodes
    calls = [json.loads(r.extra) | {"id": r.id} for r in invokes.select("id", "extra").collect()]
    dirs = nodes.where(F.col("id").startswith("tfmodule_")).select("id", "label")
    callers: dict[str, list[str]] = {}
    for r in edges.where("relation = 'references'").join(dirs, edges.target == dirs.id).select("source", "label").collect():
        callers.setdefault(r.label, []).append(r.source)
    better = complete_labels(own, calls, callers)
    if not better:
        return nodes
    names = nodes.sparkSession.createDataFrame(list(better.items()), "id string, better string")
    return nodes.join(F.broadcast(names), "id", "left").withColumn("computed_name", F.coalesce("better", "computed_name")).drop("better")


def assemble(nodes: DataFrame, edges: DataFrame) -> Graph:
    """One row a node, in order (seq); links between them, cleaned and in order (seq)."""
    clean = nodes.select("id", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("file_type", F.lit("")).alias("file_type"), F.coalesce("source_file", F.lit("")).alias("source_file"), "source_location", F.coalesce("computed_name", F.lit("")).alias("computed_name"), F.col("ord").alias("seq"))
    one = graph.upsert_nodes(clean)
    links = graph.reconcile_edges(one, edges, normalize_id_of)
    links = links.withColumn("seq", F.row_number().over(Window.partitionBy("source").orderBy("target", "relation", "ord")).cast("long"))
    return Graph(one, links.drop("ord"))


def finish(g: Graph, with_clusters: bool = True) -> Graph:
    """Adds search labels, scores and communities."""
    extra = F.when(F.col("computed_name") != "", F.concat(F.lit(" "), norm_label_of("computed_name"))).otherwise("")
    nodes = g.nodes.withColumn("norm_label", F.concat(norm_label_of("label"), extra))
    base = F.create_map(*[F.lit(x) for kv in SCORES.items() for x in kv])[F.col("confidence")]
    edges = g.edges.withColumn("confidence_score", F.when(F.coalesce("confidence_score", F.lit(0.0)) != 0, F.col("confidence_score")).otherwise(F.coalesce(base, F.lit(0.0))))
    if not with_clusters:
        return Graph(nodes.withColumn("community", F.lit(None).cast("int")), edges)
    found = cluster.cluster(nodes, edges)
    return Graph(nodes.join(found, "id", "left"), edges, found)


def build(spark: SparkSession, root: str, with_manifests: bool = True, with_cargo: bool = False, with_clusters: bool = True, enrich=None) -> Graph:
    """The whole graph of the tree below root."""
    paths = listing.collect(root).files
    files = spark.createDataFrame([(p, i) for i, p in enumerate(paths)] or [], "path string, idx int")
    return from_fragments(fragments(spark, root, paths, with_manifests, with_cargo), files, with_clusters, enrich)


def from_fragments(found: DataFrame, files: DataFrame, with_clusters: bool = True, enrich=None) -> Graph:
    """What is joined many times is written once: fragments, then nodes and edges before and after they are assembled."""
    nodes, edges = map(level, resolve_all(level(found), level(files)))
    if enrich:
        nodes, edges = enrich(nodes, edges)
    g = assemble(nodes, edges)
    return finish(Graph(level(g.nodes), level(g.edges)), with_clusters)


def git_head(root: str) -> str:
    done = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True)
    return done.stdout.strip() if done.returncode == 0 else ""


def git_changed(root: str) -> list[str]:
    done = subprocess.run(["git", "-C", root, "diff", "--name-only", "HEAD"], capture_output=True, text=True)
    return done.stdout.split("\n")[:-1] if done.returncode == 0 else []
