"""Enrichment of prose notes by a pluggable reader, additive and cached by content.

A backend is a callable: note (id, file, content) -> (nodes, edges), both lists of dicts. What it says is cleaned: nodes
become concepts without a file, edges leave the note, are of three relations and never certain. Nodes of the graph win.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values
NOTE_BYTES = 200 * 1024
RELATIONS = ["cites", "conceptually_related_to", "semantically_similar_to"]
NOTE_TYPES = ["document", "heading", "concept", "note", "skill"]
Backend = Callable[[str, str, str], tuple[list[dict], list[dict]]]


def clean(note_id: str, nodes: list[dict], edges: list[dict]) -> tuple[list[dict], list[dict]]:
    keep = [{**n, "file_type": "rationale" if n.get("file_type") == "rationale" else "semantic_concept", "source_file": "", "source_location": ""} for n in nodes if n.get("id")]
    out = [{**e, "confidence": "AMBIGUOUS" if e.get("confidence") == "AMBIGUOUS" else "INFERRED", "source_file": "", "source_location": ""} for e in edges if e.get("relation") in RELATIONS and e.get("source") == note_id]
    return keep, out


def read_notes(notes: DataFrame, backend: Backend, cache: DataFrame | None = None) -> DataFrame:
    """notes: id, file, content, seq. Returns the new cache: id, hash, seq, found (JSON of nodes and edges). Notes with a known hash are not read again; one that fails gives nothing."""
    hashed = notes.where(F.octet_length("content") <= NOTE_BYTES).withColumn("hash", F.sha2("content", 256))
    known = cache.select("id", "hash", "found") if cache is not None else None
    todo = hashed.join(known, ["id", "hash"], "left_anti") if known is not None else hashed

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples():
                try:
                    nodes, edges = clean(r.id, *backend(r.id, r.file, r.content))
                except Exception:  # noqa: BLE001  a note that can't be read adds nothing
                    nodes, edges = [], []
                out.append((r.id, r.hash, r.seq, json.dumps({"nodes": nodes, "edges": edges})))
            yield pd.DataFrame(out, columns=["id", "hash", "seq", "found"])

    fresh = todo.mapInPandas(run, "id string, hash string, seq long, found string")
    return fresh if known is None else fresh.unionByName(hashed.join(known, ["id", "hash"]).select("id", "hash", "seq", "found"))


def collect(cache: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New nodes, each once and none that the graph has, and edges whose target is in the graph or was named by this note or one before it."""
    node = "array<struct<id:string,label:string,file_type:string,computed_name:string>>"
    edge = "array<struct<source:string,target:string,relation:string,confidence:string,confidence_score:double>>"
    read = cache.select("seq", F.from_json("found", f"struct<nodes:{node},edges:{edge}>").alias("x"))
    named = read.select("seq", F.posexplode("x.nodes").alias("pos", "n")).select("seq", "pos", "n.*")
    first = named.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("seq", "pos"))).where("k = 1").join(nodes.select("id"), "id", "left_anti")
    known = nodes.select(F.col("id").alias("target"), F.lit(-1).cast("long").alias("from_seq")).unionByName(first.select(F.col("id").alias("target"), F.col("seq").alias("from_seq")))
    links = read.select("seq", F.explode("x.edges").alias("e")).select("seq", "e.*").join(known, "target").where("from_seq <= seq")
    return first.select("id", "label", "file_type", F.lit("").alias("source_file"), "computed_name", "seq", "pos"), links.drop("from_seq")


def content_hash(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()
